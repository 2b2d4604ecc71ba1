"""When a failed call may run again: retry hints, rate-limit headers, durations, spent accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as tx

# Ceilings, the share of jitter, markers of a spent account, and the headers of each limit in the order in which they count.
CEILING_MS, CAPACITY_MS = 5 * 60 * 1000, 6 * 60 * 60 * 1000
JITTER = 0.25
SPENT = ("insufficient_quota", "insufficient quota", "billing", "balance", "余额不足", "充值", "credit", "payment_required", "payment required", "exceeded your current quota", "no enough balance", "account inactive")
NUMBERS = {
    "remaining_requests": ("x-ratelimit-remaining-requests", "anthropic-ratelimit-requests-remaining", "x-ratelimit-remaining"),
    "remaining_tokens": ("x-ratelimit-remaining-tokens", "anthropic-ratelimit-tokens-remaining"),
    "limit_requests": ("x-ratelimit-limit-requests", "anthropic-ratelimit-requests-limit", "x-ratelimit-limit"),
    "limit_tokens": ("x-ratelimit-limit-tokens", "anthropic-ratelimit-tokens-limit"),
}
DURATIONS = {
    "reset_requests_ms": ("x-ratelimit-reset-requests", "anthropic-ratelimit-requests-reset", "x-ratelimit-reset"),
    "reset_tokens_ms": ("x-ratelimit-reset-tokens", "anthropic-ratelimit-tokens-reset"),
}
UNITS = {"ms": 1.0, "s": 1000.0, "m": 60_000.0, "h": 3_600_000.0, "d": 86_400_000.0}


def retry_after_ms(header: Column, now: Column, capacity: bool = False) -> Column:
    """Milliseconds of a hint in seconds or as an HTTP date, at most the ceiling; a date that is past is 0, anything else null."""
    t = F.trim(header)
    most = F.lit(CAPACITY_MS if capacity else CEILING_MS).cast("long")
    seconds = F.least(t.try_cast("decimal(38,0)") * 1000, most.cast("decimal(38,0)")).cast("long")
    date = F.try_to_timestamp(F.regexp_extract(t, r"^(?:[A-Za-z]+, *)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT)$", 1), F.lit("d MMM yyyy HH:mm:ss z"))
    wait = F.greatest(F.lit(0).cast("long"), F.least(F.unix_millis(date) - F.unix_millis(now), most))
    return F.when(t.rlike(r"^\d{39,}$"), most).when(t.rlike(r"^\d+$"), seconds).when(date.isNotNull(), wait)


def backoff_ms(header: Column, remaining: Column, now: Column, jitter: Column, capacity: bool = False) -> Column:
    """The hint, else 2, 4 or 8 seconds for 3, 2 or 1 attempts left; a quarter of it up or down by jitter (-1 to 1)."""
    grown = F.pow(F.lit(2.0), 4 - F.greatest(F.lit(1), F.least(remaining, F.lit(3)))) * 1000
    base = F.coalesce(retry_after_ms(header, now, capacity).cast("double"), F.least(grown, F.lit(float(CEILING_MS))))
    return F.greatest(F.lit(0).cast("long"), F.floor(base + base * JITTER * jitter + 0.5))


def duration_ms(raw: Column) -> Column:
    """Plain seconds, or terms such as 1h2m3s, 1m20s, 500ms; null if there is no term."""
    t = F.lower(F.trim(raw))
    terms = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?\s*(?:ms|s|m|h|d)(?=\d|$))"), F.lit(1))
    unit = F.lit(0.0)
    worth = lambda x: unit_of(F.regexp_extract(x, "([a-z]+)$", 1)) * F.regexp_extract(x, r"^(\d+(?:\.\d+)?)", 1).cast("double")
    total = F.aggregate(F.transform(terms, worth), unit, lambda a, b: a + b)
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), tx.round_half_up(t.try_cast("double") * 1000, 0).cast("long")).when(F.size(terms) > 0, tx.round_half_up(total, 0).cast("long"))


def unit_of(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in UNITS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def rate_limits(headers: Column, now: Column) -> dict[str, Column]:
    """What the headers (a map, names in any case) say of limits: for each field, the first header that is there."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    first = lambda names: F.coalesce(*[F.try_element_at(low, F.lit(n)) for n in names])

    def number(names: tuple[str, ...]) -> Column:
        n = F.trim(first(names)).try_cast("double")
        return F.when((n >= 0) & (n < float("inf")), n)

    return {k: number(n) for k, n in NUMBERS.items()} | {k: duration_ms(first(n)) for k, n in DURATIONS.items()} | {"retry_after_ms": retry_after_ms(first(("retry-after",)), now, True)}


def account_spent(status: Column, body: Column) -> Column:
    """Whether an answer says that the account has nothing left, so that no waiting helps."""
    low, hit = F.lower(F.coalesce(body, F.lit(""))), F.lit(False)
    for m in SPENT:
        hit = hit | F.contains(low, F.lit(m))
    return F.coalesce(status.isin(402, 403, 429) & hit, F.lit(False))

"""Scalar functions over columns: everything here stays in the JVM.

String lengths are code points. "Tokens" is the estimate of one token for 1.5 characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and patterns.
CJK = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}"
WORD_CHAR = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{N}_]"
TOKEN = rf"[{CJK}]|{WORD_CHAR}+"
TITLE_TOKEN = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]|[a-z0-9]{2,}"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 1.5)).cast("long")


def count_words(text: Column) -> Column:
    """Runs of Latin letters and digits, plus single CJK characters."""
    return (F.regexp_count(text, F.lit("[a-zA-Z0-9]+")) + F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))).cast("long")


def whitespace_words(text: Column) -> Column:
    """Pieces between white space; an empty text has one, and outer white space adds empty pieces."""
    return F.size(F.split(text, r"\s+", -1)).cast("long")


def tokens(text: Column) -> Column:
    return all_matches(F.lower(text), TOKEN)


def title_tokens(title: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(F.trim(title)), TITLE_TOKEN))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def search_terms(query: Column, most: int = 20) -> Column:
    """Pieces of two characters or more, each once whatever its case, the first ones."""
    pieces = F.filter(F.split(query, r"[\s,;:.!?\x{3001}\x{3002}\x{FF0C}\x{FF1B}\x{FF1A}\x{FF01}\x{FF1F}]+", -1), lambda p: F.length(p) >= 2)
    lower = F.transform(pieces, F.lower)
    first = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: F.array_position(lower, F.lower(s["p"])) == s["i"] + 1)
    return F.slice(F.transform(first, lambda s: s["p"]), 1, most)


def slugify(title: Column) -> Column:
    """ASCII letters (lower-cased), digits, CJK, kana and Hangul; all else becomes single inner hyphens."""
    return F.lower(F.regexp_replace(F.regexp_replace(title, r"[^a-zA-Z0-9\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+", "-"), "^-+|-+$", ""))


def normalise_query(query: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")


def format_file_size(size: Column) -> Column:
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", size / 1024.0**power))
    return out.otherwise(F.format_string("%.1fGB", size / 1024.0**3))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, "</?mark>", "")


def strip_number(title: Column) -> Column:
    """A title without its leading section number."""
    return F.trim(F.regexp_replace(F.trim(title), r"^\d+(\.\d+)*[.\x{3001}]?\s*", ""))


def document_of_chunk(chunk_id: Column) -> Column:
    """What stands before the first slash; empty without one or when it leads."""
    return F.when(F.instr(chunk_id, "/") > 1, F.substring_index(chunk_id, "/", 1)).otherwise("")


def relevance(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def round_half_up(x: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def badge(score: Column, vector_score: Column, keyword: Column) -> Column:
    """(percent, level) shown beside a hit: a keyword hit by its score, any other by its vector score where it has one.

    Percents are whole and from 0 to 100; no score and NaN show 0. From 80 on a match is high, from 60 on medium.
    """
    shown = F.nanvl(F.coalesce(F.when(keyword, score).otherwise(F.coalesce(vector_score, score)).cast("double"), F.lit(0.0)), F.lit(0.0))
    percent = F.floor(clamp(shown) * 100 + 0.5).cast("int")
    level = F.when(keyword, "hit").when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low")
    return F.struct(percent.alias("percent"), level.alias("level"))


def truncate(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def triples(words: Column) -> Column:
    """Sliding groups of three."""
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.slice(words, i, 3))).otherwise(F.array().cast("array<array<string>>"))


def query_terms(query: Column) -> Column:
    """The query itself, its ASCII words and its CJK runs (cut in pairs if over four characters), longest first."""
    whole = F.trim(query)
    ascii_words = F.filter(all_matches(whole, "[A-Za-z0-9_-]+"), lambda t: F.length(t) >= 2)
    runs = all_matches(whole, r"[\x{4E00}-\x{9FFF}]{2,}")
    cut = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1, F.lit(2)), lambda i: F.substring(r, i, F.lit(2))))))
    terms = F.array_distinct(F.filter(F.concat(F.array(whole), ascii_words, cut), lambda t: F.length(t) > 0))
    ranked = F.array_sort(F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(ranked, lambda x: x["t"])


def excerpt(content: Column, query: Column, most: int = 1200) -> Column:
    """A window of `most` characters around the first term that is found, as written or in any case; "..." where it is cut."""
    text = F.trim(F.coalesce(content, F.lit("")))
    terms = query_terms(query)
    exact = F.filter(F.transform(terms, lambda t: F.instr(text, t)), lambda p: p > 0)
    loose = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), F.lower(t))), lambda p: p > 0)
    at = F.coalesce(F.get(exact, F.lit(0)), F.get(loose, F.lit(0)))
    start = F.greatest(F.lit(0), at - 1 - most // 2)
    window = F.trim(F.substring(text, start + 1, F.lit(most)))
    around = F.concat(F.when(start > 0, "...").otherwise(""), window, F.when(start + most < F.length(text), "...").otherwise(""))
    head = F.concat(F.trim(F.substring(text, 1, most)), F.lit("..."))
    plain = (F.trim(F.coalesce(query, F.lit(""))) == "") | (F.length(text) <= most)
    return F.when(plain, text).when(at.isNull(), head).otherwise(around)


def rewrite_image_urls(markdown: Column, base: str) -> Column:
    return F.regexp_replace(markdown, r"!\[([^\]]*)\]\((?:\./)?images/([^)\s]+)\)", rf"![$1]({base}/$2)")


def api_base(url: Column) -> Column:
    """Without trailing slashes and endpoint names."""
    out = F.regexp_replace(F.trim(url), "/+$", "")
    for tail in ("/chat/completions", "/completions", "/embeddings", "/rerank"):
        out = F.regexp_replace(out, tail + "$", "")
    return F.regexp_replace(out, "/+$", "")


def classify(text: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The label of the first rule with a substring in the lower-cased text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for needles, label in rules:
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def retry_after_seconds(header: Column, most: int = 3600) -> Column:
    """Delta seconds, clamped; null if it is no number."""
    return F.when(F.trim(header).rlike(r"^\d+$"), F.least(F.try_to_number(F.trim(header), F.lit("9" * 9)).cast("long"), F.lit(most)))


# Tiers of the processing-time estimate (megabytes below, minutes), factors by mode, minutes for further files.
TIERS = ((5, "fast", 0.5, 2.0), (20, "medium", 2.0, 8.0), (50, "slow", 8.0, 20.0), (None, "heavy", 20.0, 45.0))
MODES = {"standard": (1.0, 1.0), "graph": (1.5, 2.0), "wiki": (2.0, 2.25), "full": (2.5, 3.25)}
MORE_FILES = ((9, 0.5, 1.0), (90, 0.1, 0.25))


def processing_estimate(total_bytes: Column, files: Column, mode: str = "standard") -> Column:
    """struct<level, min_minutes, max_minutes> for a batch of uploads."""
    size = F.greatest(F.coalesce(total_bytes, F.lit(0)), F.lit(0))

    def pick(at: int) -> Column:
        out = None
        for tier in TIERS[:-1]:
            value = F.lit(tier[at])
            out = F.when(size < tier[0] << 20, value) if out is None else out.when(size < tier[0] << 20, value)
        return out.otherwise(F.lit(TIERS[-1][at]))

    left, more_low, more_high = F.greatest(F.least(files, F.lit(100)) - 1, F.lit(0)), F.lit(0.0), F.lit(0.0)
    for count, low, high in MORE_FILES:
        here = F.least(left, F.lit(count))
        more_low, more_high, left = more_low + here * low, more_high + here * high, left - here
    low = F.greatest(F.lit(1), F.floor(pick(2) * MODES[mode][0] + more_low + 0.5)).cast("long")
    high = F.greatest(low, F.floor(pick(3) * MODES[mode][1] + more_high + 0.5)).cast("long")
    return F.struct(pick(1).alias("level"), low.alias("min_minutes"), high.alias("max_minutes"))


# Substrings of graph errors, in order, with their type and whether a retry may help.
GRAPH_ERRORS = (
    (("429", "rate limit", "rate_limit", "too many requests", "quota"), "rate_limit", True),
    (("timeout", "timed out", "deadline exceeded", "<timeout after"), "timeout", True),
    (("econnreset", "etimedout", "enotfound", "eai_again", "econnrefused", "socket hang up", "network", "connection aborted", "connection reset"), "network", True),
    (("500", "502", "503", "504", "bad gateway", "service unavailable", "gateway timeout", "internal server error", "overloaded"), "server_error", True),
    (("401", "unauthorized", "not authenticated"), "auth", False),
    (("403", "forbidden", "permission denied"), "auth", False),
    (("404", "model not found", "model_not_found", "no such model"), "config", False),
    (("invalid api_base", "invalid_api_base", "invalid api key", "api key", "missing api"), "config", False),
    (("embedding dimension", "embedding_dim", "dim mismatch", "dimension mismatch"), "data", False),
)


def graph_error(message: Column) -> Column:
    """struct<type, retryable, backoff_ms of a first and a second retry>."""
    kind = classify(message, [(needles, label) for needles, label, _ in GRAPH_ERRORS], "unknown")
    again = classify(message, [(needles, str(retry).lower()) for needles, _, retry in GRAPH_ERRORS], "false") == "true"
    return F.struct(kind.alias("type"), again.alias("retryable"), F.when(again, F.array(F.lit(120_000), F.lit(600_000))).alias("backoff_ms"))

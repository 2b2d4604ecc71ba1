"""Task tables: latest rows, queue positions, lineage, durations, pipeline views, retries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx
from tessella.storage import written

TERMINAL = ("completed", "failed", "cancelled")


def latest(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """The newest task of each key; of graph tasks the one with most attempts comes first."""
    attempt = F.when(F.col("type") == "rag_index", F.coalesce("attempt", F.lit(0))).otherwise(0) if "attempt" in tasks.columns else F.lit(0)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(attempt.desc(), F.desc("created_at"), F.desc("id")))
    return tasks.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def queue_positions(tasks: DataFrame, kind: str | None = None, user: str = "user_id") -> DataFrame:
    """(user, id, place, total) of waiting and running tasks: running ones first, then the oldest."""
    live = tasks.where(F.col("status").isin("pending", "running"))
    if kind:
        live = live.where(F.col("type") == kind)
    per = W.partitionBy(user)
    place = F.row_number().over(per.orderBy((F.col("status") != "running").cast("int"), "created_at", "id"))
    return live.select(user, "id", place.alias("place"), F.count("*").over(per).alias("total"))


def task_list(tasks: DataFrame, statuses: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    out = tasks.where(F.col("status").isin([s.strip() for s in statuses.split(",")])) if statuses else tasks
    if kind:
        out = out.where(F.col("type") == kind)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), 200))


def identity(column: str, raw: str, field: str) -> Column:
    """A relational column, else the field of the task's JSON input."""
    return F.coalesce(F.col(column).cast("string"), F.get_json_object(raw, f"$.{field}"))


def descendants(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of the tasks below each root (root), at any depth; a cycle ends where it began.

    Pointer jumping: a round doubles how far each task points up and adds the roots that the task
    there has found, so that the rounds are the logarithm of the depth. A round that finds no new pair
    is the last one: a pair farther away would have given its nearer half in that round.
    """
    up = tasks.where("parent_id IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max("parent_id").alias("up"))
    jump = written(up)
    wanted = roots.select(F.col("root")).where("root IS NOT NULL").distinct()
    found = written(jump.join(wanted, F.col("up") == F.col("root"), "left_semi").select(F.col("up").alias("root"), "id"))
    many, before = found.count(), -1
    while many != before:
        before = many
        far = found.select(F.col("id").alias("at"), "root")
        found = written(found.union(jump.join(far, F.col("up") == F.col("at")).select("root", "id")).distinct())
        above = jump.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"))
        jump = written(jump.join(above, F.col("up") == F.col("a_id")).select("id", F.col("a_up").alias("up")))
        many = found.count()
    return found.where("root <> id")


def latest_round(tasks: DataFrame) -> DataFrame:
    """Tasks of each document's newest processing round: its operation, else what followed its newest conversion and hangs below it or nothing."""
    convert = latest(tasks.where("type = 'document_convert'"), ["document_id"]).select(F.col("document_id").alias("c_doc"), F.col("id").alias("c_id"), F.col("operation_id").alias("c_op"), F.col("created_at").alias("c_at"))
    below = descendants(tasks, convert.where("c_op IS NULL").select(F.col("c_id").alias("root"))).select(F.col("root").alias("b_root"), F.col("id").alias("b_id"))
    joined = tasks.join(convert, F.col("document_id") == F.col("c_doc")).join(below, (F.col("c_id") == F.col("b_root")) & (F.col("id") == F.col("b_id")), "left")
    same = F.col("operation_id") == F.col("c_op")
    after = (F.col("type") != "document_convert") & F.col("operation_id").isNull() & (F.col("created_at") >= F.col("c_at")) & (F.col("parent_id").isNull() | F.col("b_id").isNotNull())
    return joined.where(F.when(F.col("c_op").isNotNull(), same).otherwise((F.col("id") == F.col("c_id")) | after)).select(*tasks.columns)


def durations(tasks: DataFrame, required: list[str]) -> DataFrame:
    """(document_id, duration_ms) from the conversion's start to the last end of the required tasks; null while one is missing or runs."""
    last = latest(tasks, ["document_id", "type"])
    ended = F.col("status").isin(*TERMINAL) & F.col("finished_at").isNotNull()
    start = F.max(F.when(F.col("type") == "document_convert", F.coalesce("started_at", F.when(F.col("status").isin(*TERMINAL), F.col("created_at")))))
    got = last.where(F.col("type").isin(*required, "document_convert")).groupBy("document_id").agg(start.alias("start"), F.count_if(F.col("type").isin(*required) & ended).alias("done"), F.max(F.when(F.col("type").isin(*required), F.col("finished_at"))).alias("end"))
    ms = F.unix_millis(F.col("end").cast("timestamp")) - F.unix_millis(F.col("start").cast("timestamp"))
    return got.select("document_id", F.when((F.col("done") == len(required)) & (ms >= 0), ms).alias("duration_ms"))


# -- pipeline view -----------------------------------------------------------


def _stage(status: Column, active: Column) -> Column:
    return F.when(status == "failed", "failed").when(status == "completed", "done").when(status.isin("pending", "running"), active).otherwise("pending")


def pipeline(docs: DataFrame) -> DataFrame:
    """Stage columns, basic_ready, ready, failed, percent and display status of documents.

    docs: doc_id, status, uploaded, converted (booleans), convert, embed, graph, wiki (statuses of
    the latest tasks, null for none), convert_progress, embed_progress, graph_progress,
    wiki_progress. The linear stages go forward only: behind a pending one all are pending, and a
    failed one does not stop the line. The graph and wiki branches are active after the index only.
    """
    past = F.coalesce("embed_progress", F.lit(0)) >= 70
    raw = [
        F.when(F.col("uploaded"), "done").otherwise("active"),
        _stage(F.col("convert"), F.when(F.col("converted"), "done").otherwise("active")),
        _stage(F.col("convert"), F.when(F.col("converted"), "active").otherwise("pending")),
        _stage(F.col("embed"), F.when(past, "done").otherwise("active")),
        _stage(F.col("embed"), F.when(past, "active").otherwise("pending")),
    ]
    names = ["upload_stage", "convert_stage", "split_stage", "embed_stage", "index_stage"]
    shown, pending = {}, F.lit(False)
    for name, r in zip(names, raw, strict=True):
        shown[name] = F.when(pending, "pending").otherwise(r)
        pending = pending | (r == "pending")
    out = docs.withColumns(shown)
    end = F.col("index_stage")
    for b in ("graph", "wiki"):
        branch = _stage(F.col(b), F.when(end == "done", "active").otherwise("pending"))
        out = out.withColumn(f"{b}_stage", F.when(end == "failed", "pending").otherwise(branch))
    names += ["graph_stage", "wiki_stage"]
    progress = {"convert_stage": "convert_progress", "split_stage": "convert_progress", "embed_stage": "embed_progress", "index_stage": "embed_progress", "graph_stage": "graph_progress", "wiki_stage": "wiki_progress"}
    done = sum((F.when(F.col(n) == "done", 1.0).when((F.col(n) == "active") & F.lit(n in progress), tx.clamp(F.coalesce(F.col(progress.get(n, "embed_progress")), F.lit(0)) / 100)).otherwise(0.0) for n in names), F.lit(0.0))
    idle = F.col("convert").isNull() & F.col("embed").isNull() & F.col("graph").isNull() & F.col("wiki").isNull()
    every = lambda some: F.forall(F.array(*[F.col(n) for n in some]), lambda s: s == "done")
    fallen = F.exists(F.array(*[F.col(n) for n in names]), lambda s: s == "failed")
    out = out.withColumns({"ready": (idle & (F.col("status") == "ready")) | every(names), "basic_ready": (idle & (F.col("status") == "ready")) | every(names[:5]), "failed": (idle & (F.col("status") == "failed")) | fallen, "percent": F.when(idle & (F.col("status") == "ready"), 100).otherwise(F.floor(done / len(names) * 100 + 0.5)).cast("int")})
    display = F.when(F.col("ready"), "ready").when(F.col("failed"), "failed").when(F.col("basic_ready"), "enhancing").when(F.col("status").isin("pending", "uploading"), "pending").otherwise("processing")
    return out.withColumn("display", display)


# -- queue rules as tables ---------------------------------------------------


def claimable(tasks: DataFrame, as_of: str, caps: dict[str, int], total: int = 4) -> DataFrame:
    """Pending tasks that would be claimed now: due, oldest first, within the caps by type and in total, after those that run."""
    now = F.lit(as_of).cast("timestamp")
    running = tasks.where("status = 'running'").groupBy("type").agg(F.count("*").alias("busy"))
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("type")), F.lit(1))
    due = tasks.where("status = 'pending'").where(F.col("not_before").isNull() | (F.col("not_before") <= now))
    nth = F.row_number().over(W.partitionBy("type").orderBy("created_at", "id"))
    fits = due.withColumn("nth", nth).where(F.col("nth") <= total).join(running, "type", "left").where(F.col("nth") + F.coalesce("busy", F.lit(0)) <= cap)
    used = F.broadcast(running.agg(F.coalesce(F.sum("busy"), F.lit(0)).alias("used")))  # one row
    overall = F.row_number().over(W.orderBy("created_at", "id"))  # at most `total` of each type
    return fits.withColumn("place", overall).crossJoin(used).where(F.col("place") + F.col("used") <= total).select(*tasks.columns)


def stalled(tasks: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Running tasks without a heartbeat for so long; they fail."""
    beat = F.coalesce("heartbeat_at", "started_at", "created_at")
    return tasks.where("status = 'running'").where(beat < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(minutes)))


def expired_leases(tasks: DataFrame, as_of: str) -> DataFrame:
    """Running tasks with a lease that is over: back to pending, or cancelled if that was asked for."""
    over = tasks.where("status = 'running'").where(F.col("lease_until") < F.lit(as_of).cast("timestamp"))
    return over.withColumn("status", F.when(F.coalesce("cancel_requested", F.lit(False)), "cancelled").otherwise("pending"))


def fenced(updates: DataFrame) -> DataFrame:
    """The valid update of each task: of its highest generation, the first terminal one, else the last."""
    top = W.partitionBy("task_id")
    newest = updates.withColumn("_g", F.max("generation").over(top)).where(F.col("generation") == F.col("_g"))
    final = F.col("status").isin(*TERMINAL)
    rank = F.row_number().over(top.orderBy(final.desc(), F.when(final, F.unix_micros(F.col("at").cast("timestamp"))).asc_nulls_last(), F.desc("at")))
    return newest.withColumn("_n", rank).where("_n = 1").drop("_n", "_g")


def retries(tasks: DataFrame, most: int = 2, backoff_minutes: tuple[int, ...] = (2, 10)) -> DataFrame:
    """Failed tasks that may run again, with not_before."""
    again = tasks.where("status = 'failed'").where((F.col("attempt") < most) & tx.graph_error(F.col("error"))["retryable"])
    wait = F.element_at(F.array(*[F.lit(m) for m in backoff_minutes]), F.least(F.col("attempt") + 1, F.lit(len(backoff_minutes))).cast("int"))
    return again.withColumns({"not_before": F.col("finished_at") + F.make_interval(mins=wait), "attempt": F.col("attempt") + 1})  # both of the attempt that failed


def completed_prefix(items: DataFrame, keys: list[str]) -> DataFrame:
    """How many items of each key are done before the first that is not."""
    return items.groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("idx"))), F.count("*")).alias("prefix"))


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done, key, "left_anti")


@dataclass
class FailureWindow:
    """The failures of one key since a first one, and until when they lock; times in microseconds."""

    started: int
    failures: int = 0
    locked_until: int = 0

    def over(self, now: int, window: int) -> bool:
        return now >= self.locked_until and now - self.started >= window

    def fail(self, now: int, most: int, lock: int) -> None:
        self.failures += 1
        if self.failures >= most:
            self.locked_until = now + lock


LOCKED = "window_start timestamp, failures long, locked_until timestamp"


def lockouts(failures: DataFrame, most: int = 5, minutes: int = 15, lock_minutes: int | None = None) -> DataFrame:
    """(key, window_start, failures, locked_until) of the windows that locked a key, from failures (key, ts).

    A window opens with a key's first failure. From the most-th failure on, each one locks the key for
    lock_minutes (the window's length, if not given). The window ends with the first failure that comes
    neither within `minutes` of its start nor under a lock; that one opens the next window. Failures
    stream past by key and time, so that a key with very many of them is never held in memory. Rows
    with a null key or time are left out.
    """
    window, lock = minutes * 60_000_000, (minutes if lock_minutes is None else lock_minutes) * 60_000_000
    kind = failures.schema["key"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, at = None, None
        for batch in batches:
            done = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                if at is None or k != key or at.over(t, window):
                    if at is not None and at.locked_until:
                        done.append((key, at.started, at.failures, at.locked_until))
                    key, at = k, FailureWindow(t)
                at.fail(t, most, lock)
            yield pd.DataFrame(done, columns=["key", "started", "failures", "until"])
        if at is not None and at.locked_until:
            yield pd.DataFrame([(key, at.started, at.failures, at.locked_until)], columns=["key", "started", "failures", "until"])

    timed = failures.where("key IS NOT NULL AND ts IS NOT NULL").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rows = timed.repartition("key").sortWithinPartitions("key", "t").mapInPandas(fold, f"key {kind}, started long, failures long, until long")
    return rows.select("key", F.timestamp_micros("started").alias("window_start"), "failures", F.timestamp_micros("until").alias("locked_until"))


# Patterns of length requirements and markers of brainstorming replies.
_ZH_LENGTH = r"篇幅|字数|页数|文档长度|报告长度|格式要求|简版|标准版|完整版|[0-9０-９一二三四五六七八九十百千万]+\s*(字|页)"
_EN_LENGTH = r"word count|page count|document length|report length|format requirement|\b\d[\d,.]*\s*(words?|pages?|pp\.)\b|\b(brief|standard|full)\s+(version|length|document|report)\b"
_ASKS = r"篇幅|字数|页数|大致篇幅|word count|approximate length|page count|document length|report length"
_OPTION = r"^[ABCD](?:[\s,，.。:：]|$)"
MARKERS = ("GENERATE_DIRECT", "ALL_SECTIONS_CONFIRMED", "NEEDS_GATHERED", "DIRECTION_CONFIRMED", "SECTION_BY_SECTION")


def states_length(role: Column, text: Column, previous_role: Column, previous_text: Column, assistant: str = "assistant") -> Column:
    """Whether a user's message states a length, or picks an option where the assistant asked for one."""
    mine = role.isNull() | (role == "user")
    picks = (previous_role == assistant) & F.trim(text).rlike(f"(?i){_OPTION}") & previous_text.rlike(f"(?i){_ASKS}")
    return F.coalesce(mine & (text.rlike(f"(?i){_ZH_LENGTH}|{_EN_LENGTH}") | F.coalesce(picks, F.lit(False))), F.lit(False))


def marker(text: Column) -> Column:
    """The first marker in a reply; those that end the talk win."""
    out = None
    for m in MARKERS:
        out = F.when(F.contains(text, F.lit(m)), m) if out is None else out.when(F.contains(text, F.lit(m)), m)
    return out

"""Exact dedup: 128-bit content hash, smallest stable id, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._base import WHITE, fresh, sieve, sifted, text_or_empty, with_groups, written


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    1. A narrow pass computes the hash and SHA-256 of each normalised text; it is written.
    2. Hashes are counted with map-side sums. Those that occur twice fill a sieve of bounded
       size, which is broadcast: only texts that pass it are shuffled.
    3. Those texts are grouped by hash *and* text, so equality is decided on bytes and a hash
       collision splits into its true groups. The partial aggregate leaves one row per text and
       task, so a group with a third of all rows is never gathered in one task.
    4. Ids are given back by a join on (hash, SHA-256); hot groups are broadcast.

    Null text counts as empty; an empty table gives no rows. Null ids rank after all others (a
    group of null ids only has keep_id null and keeps one row). Rows repeated with the same id
    and equal text are copies like any other: one of them is kept. Other columns are ignored.
    """
    return _decided(docs, id_col, text_col, content_hash).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _decided(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(id, key, sha, keep_id, group_size, kept); key is a short hash of the normalised text."""
    norm = F.col("norm")
    fp = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).select("id", F.xxhash64("norm").alias("key"), content_hash(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    # The written rows carry a stable row id, so repeated rows can be told apart.
    fp = written(fp.withColumn("uid", F.monotonically_increasing_id()))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    groups = written(fp.groupBy("h", "sha").agg(F.min(rank).alias("first"), F.first("key").alias("key"), F.count("*").alias("n")).where("n > 1"))
    texts = sifted(docs.select(normalised(text_col).alias("norm")), F.xxhash64("norm"), sieve(groups.select("key")), "twice").where("twice").select("norm")
    classes = texts.groupBy(content_hash(norm).alias("h"), "norm").agg(F.count("*").alias("class_n")).where("class_n > 1").select("h", F.unhex(F.sha2(norm, 256)).alias("sha"), "class_n")
    found = written(groups.join(classes, ["h", "sha"]).select(F.col("h").alias("c_h"), F.col("sha").alias("c_sha"), F.col("first.id").alias("first_id"), F.col("first.uid").alias("first_uid"), "class_n"))
    out = with_groups(fp, found, {"h": "c_h", "sha": "c_sha"}, "class_n", fp.count(), "left")
    own = F.col("class_n").isNull()
    return out.select(
        "id",
        "key",
        "sha",
        F.when(own, F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("class_n", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("first_uid") == F.col("uid"))).alias("kept"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of repeated rows with one id and text, one.

    Only rows that are dropped or repeated (a sieve tells) are shuffled; all others stay where they are.
    """
    copies = _decided(docs, id_col, text_col).where("group_size > 1")
    marks = copies.groupBy("id", "key", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marks = written(marks.where("NOT kept OR n > 1").withColumn("at", F.xxhash64("id", "key")))
    sha, maybe, g_id, g_sha = fresh(docs, "own_sha", "maybe", "gone_id", "gone_sha")
    norm = normalised(text_col)
    rows = sifted(docs, F.xxhash64(F.col(id_col), F.xxhash64(norm)), sieve(marks.select("at")), maybe)
    gone = marks.where("NOT kept").select(F.col("id").alias(g_id), F.col("sha").alias(g_sha))
    told = rows.where(F.col(maybe)).drop(maybe).withColumn(sha, F.unhex(F.sha2(norm, 256)))
    told = told.join(gone, F.col(id_col).eqNullSafe(F.col(g_id)) & (F.col(sha) == F.col(g_sha)), "left_anti")
    return rows.where(~F.col(maybe)).drop(maybe).unionByName(told.dropDuplicates([id_col, sha]).drop(sha))

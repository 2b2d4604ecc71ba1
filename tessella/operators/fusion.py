"""Weighted reciprocal-rank fusion of the retrieval branches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx

K = 20
#: Branches in the order in which they are merged, with their weights.
WEIGHTS = {"direct": 1.0, "keyword": 1.35, "graph": 0.85}


def phrase_boost(title: Column, content: Column, query: str) -> Column:
    """Where the whole query stands as written: in the title, early, or somewhere; or all of its words."""
    q = query.strip()
    if not q:
        return F.lit(0.0)
    name = F.coalesce(title, F.lit(""))
    text = F.concat(name, F.lit("\n"), F.coalesce(content, F.lit("")))
    at = F.instr(text, F.lit(q))
    terms = re.findall("[\u4e00-\u9fff]{2,}|[A-Za-z0-9_-]+", q)
    every = F.lit(bool(terms))
    for term in terms:
        every = every & F.contains(text, F.lit(term))
    return F.when(F.contains(name, F.lit(q)), 0.14).when((at > 0) & (at <= 121), 0.12).when((at > 0) & (at <= 301), 0.08).when((at > 0) | every, 0.03).otherwise(0.0)


def fuse(branches: dict[str, DataFrame], query: str, limit: int = 20, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """Hits (keys, title, content, score) of each branch -> fused rows in order.

    A hit adds w / (K + rank) + 0.01 * score + boost to the fusion score. The visible score of a
    vector branch is score + boost, of the keyword branch its score; the merged one is the largest,
    but a keyword hit does not change that of a chunk which an earlier branch has. Rows are
    ordered by visible score, then fusion score; the first branch that has a chunk describes it.
    """
    order = {name: k for k, name in enumerate(WEIGHTS)}
    parts = []
    for name, df in branches.items():
        place = F.row_number().over(W.orderBy(F.desc("score"), *keys))  # a branch is a top-k
        boost = phrase_boost(F.col("title"), F.col("content"), query)
        clamped = tx.clamp(F.col("score"))
        seen = F.col("score") if name == "keyword" else tx.clamp(F.col("score") + boost)
        parts.append(df.select(*keys, "title", "content", F.lit(name).alias("branch"), F.lit(order[name]).alias("nth"), (F.lit(WEIGHTS[name]) / (K + place) + 0.01 * clamped + boost).alias("gain"), seen.alias("seen")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = F.min(F.struct("nth", "branch", "title", "content")).alias("first")
    got = rows.groupBy(*keys).agg(first, F.sum("gain").alias("fusion"), F.count("*").alias("n"), F.max(F.when(F.col("branch") != "keyword", F.col("seen"))).alias("vector"), F.max(F.when(F.col("branch") == "keyword", F.col("seen"))).alias("keyword"))
    visible = F.when(F.col("first.branch") == "keyword", F.greatest("keyword", F.coalesce("vector", F.lit(0.0)))).otherwise(F.col("vector"))
    out = got.select(*keys, F.col("first.title").alias("title"), F.col("first.content").alias("content"), F.when(F.col("n") > 1, "fused").otherwise(F.col("first.branch")).alias("source"), visible.alias("score"), F.col("fusion").alias("raw_fusion"))
    best = out.orderBy(F.desc("score"), F.desc("raw_fusion"), *keys).limit(limit)
    rank = F.row_number().over(W.orderBy(F.desc("score"), F.desc("raw_fusion"), *keys))  # at most `limit` rows
    return best.select(*keys, "title", "content", "source", tx.round_half_up(F.col("score"), 3).alias("score"), tx.round_half_up(F.col("raw_fusion"), 3).alias("fusion"), tx.relevance(F.col("score")).alias("label"), rank.alias("rank"))


def graph_branch_score(vector_score: Column, place: Column, total: Column) -> Column:
    """The clamped vector score, else one by rank from 0.75 down to 0.25; never over 0.75."""
    by_rank = F.greatest(F.lit(0.25), 0.75 - 0.35 * (place - 1) / F.greatest(total - 1, F.lit(1)))
    return F.least(F.lit(0.75), F.when(vector_score.isNotNull(), tx.clamp(vector_score)).otherwise(by_rank))


def attach_images(hits: DataFrame, images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each hit with the list of its document's images."""
    mine = images.join(F.broadcast(hits.select(doc).distinct()), doc, "left_semi")  # hits are a top-k
    lists = mine.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(*[c for c in images.columns if c != doc]))).alias("images"))
    return hits.join(lists, doc, "left").withColumn("images", F.coalesce("images", F.filter(F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in images.dtypes if c != doc])), lambda x: F.lit(False))))


def distinct_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")

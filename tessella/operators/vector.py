"""Exact vector search: cosine in the JVM, bounded top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx
from tessella.storage import written

LEAST_SCORE = 0.25
GRAPH_DIMENSIONS = 1536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or of no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def search(rows: DataFrame, query: list[float], limit: int = 20, least: float = LEAST_SCORE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score, label) of the rows nearest to the query: TakeOrderedAndProject over two columns."""
    q = F.lit([float(x) for x in query]) if query else F.array().cast("array<double>")
    hit = rows.select(id_col, cosine(F.col(vector_col), q).alias("s")).where(F.col("s") >= least)
    best = hit.orderBy(F.desc("s"), id_col).limit(limit)
    return best.select(id_col, tx.round_half_up(F.col("s"), 3).alias("score"), tx.relevance(F.col("s")).alias("label"))


def with_content(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Large columns for the few rows that were found."""
    return rows.join(F.broadcast(hits), key)  # hits are a top-k


def adjacent_similarity(rows: DataFrame, group: str, order: str, vector_col: str = "embedding") -> DataFrame:
    """(group, order, similarity) of each row with the next one of its group.

    Rows are range partitioned by group and order, so that a hot group is not one task; the last
    row of a part meets the first one of the group's next part.
    """
    dealt = written(written(rows.select(group, order, F.col(vector_col).alias("v"))).repartitionByRange(group, order).withColumn("part", F.spark_partition_id()))
    inner = dealt.withColumn("next", F.lead("v").over(W.partitionBy(group, "part").orderBy(order)))
    firsts = dealt.groupBy(group, "part").agg(F.min_by("v", order).alias("first"))
    follows = firsts.select(F.col(group).alias("f_group"), F.col("part").alias("f_part"), F.lead("first").over(W.partitionBy(group).orderBy("part")).alias("after"))
    met = inner.join(follows, F.col(group).eqNullSafe(F.col("f_group")) & (F.col("part") == F.col("f_part")))
    return met.withColumn("next", F.coalesce("next", "after")).where("next IS NOT NULL").select(group, order, dot(F.col("v"), F.col("next")).alias("similarity"))


def graph_allowed(dimensions: Column) -> Column:
    """Graph indexing wants wide embeddings; narrower ones fall back to the basic mode."""
    return F.when(dimensions >= GRAPH_DIMENSIONS, "graph").otherwise("basic")

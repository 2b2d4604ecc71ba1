"""Retrieval over an entity graph at two levels: entities and their neighbourhoods, relations and their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import fusion, vector

MODES = ("local", "global", "hybrid", "mix", "naive", "bypass")
TOP_K = 60
LEAST_COSINE = 0.2
#: Lists of each mode in the order in which they take turns.
LISTS = {"local": ("local",), "global": ("global",), "hybrid": ("local", "global"), "mix": ("vector", "local", "global"), "naive": ("vector",), "bypass": ()}


def chunk_top_k(limit: int) -> int:
    return max(5 * limit, 80)


def _nearest(rows: DataFrame, query: list[float], most: int, *keys: str) -> DataFrame:
    """The rows nearest to the query by cosine, with `nth` and `cosine`."""
    q = F.lit([float(x) for x in query])
    near = rows.withColumn("cosine", vector.cosine(F.col("embedding"), q)).where(F.col("cosine") >= LEAST_COSINE).orderBy(F.desc("cosine"), *keys).limit(most)
    return near.withColumn("nth", F.row_number().over(W.orderBy(F.desc("cosine"), *keys)))  # at most `most` rows


def _once(rows: DataFrame, order: list, most: int) -> DataFrame:
    """(chunk, nth): each chunk at its first place, the first `most`."""
    first = rows.groupBy("chunk").agg(F.min(F.struct(*order)).alias("o")).orderBy("o", "chunk").limit(most)
    return first.select("chunk", F.row_number().over(W.orderBy("o", "chunk")).alias("nth"))  # at most `most` rows


def local_chunks(entities: DataFrame, relations: DataFrame, query: list[float], most: int, top_k: int = TOP_K) -> DataFrame:
    """Chunks of the entities nearest to the query: by entity, then those that more of its neighbours share, then as listed."""
    best = _nearest(entities, query, top_k, "name").select("name", "nth", "chunk_ids")
    own = best.select("name", "nth", F.posexplode("chunk_ids").alias("at", "chunk"))
    ways = relations.select(F.col("source").alias("name"), F.col("target").alias("other")).union(relations.select("target", "source")).where("name <> other")
    near = ways.join(best.select("name"), "name", "left_semi").distinct()
    held = near.join(entities.select(F.col("name").alias("other"), "chunk_ids"), "other").select("name", "other", F.explode(F.array_distinct("chunk_ids")).alias("chunk"))
    shared = held.join(own.select("name", "chunk").distinct(), ["name", "chunk"], "left_semi").groupBy("name", "chunk").agg(F.count("*").alias("shared"))
    placed = own.join(shared, ["name", "chunk"], "left").select("chunk", "nth", (-F.coalesce("shared", F.lit(0))).alias("shared"), "at")
    return _once(placed, ["nth", "shared", "at"], most)


def global_chunks(relations: DataFrame, query: list[float], most: int, top_k: int = TOP_K) -> DataFrame:
    """Chunks of the relations nearest to the query: by relation, then as listed."""
    best = _nearest(relations, query, top_k, "source", "target")
    return _once(best.select("nth", F.posexplode("chunk_ids").alias("at", "chunk")), ["nth", "at"], most)


def vector_chunks(chunks: DataFrame, query: list[float], most: int) -> DataFrame:
    """Chunks nearest to the query, with their cosine."""
    return _nearest(chunks.select("chunk", "embedding"), query, most, "chunk").select("chunk", "nth", "cosine")


def graph_retrieve(mode: str, chunks: DataFrame, entities: DataFrame, relations: DataFrame, low: list[float], high: list[float] | None = None, limit: int = 20, budget: int | None = None) -> DataFrame:
    """(chunk, nth, score, origin) of a mode; an unknown mode is hybrid, bypass gives no rows.

    chunks: chunk, embedding, tokens; entities: name, embedding, chunk_ids; relations: source, target,
    embedding, chunk_ids. `low` is the vector of what is asked for by name, `high` that of its theme
    (`low`, if not given). The lists of a mode take turns, each chunk counts once, at most
    max(5 * limit, 80) are kept, and of those the first that fit into a budget of tokens together.
    A chunk of the vector list has its cosine as score, all others one by their place among those kept.
    """
    mode = mode if mode in MODES else "hybrid"
    most = chunk_top_k(limit)
    lists = {
        "vector": lambda: vector_chunks(chunks, low, most),
        "local": lambda: local_chunks(entities, relations, low, most).withColumn("cosine", F.lit(None).cast("double")),
        "global": lambda: global_chunks(relations, high or low, most).withColumn("cosine", F.lit(None).cast("double")),
    }
    parts = [lists[name]().select("chunk", "nth", "cosine", F.lit(k).alias("turn"), F.lit(name).alias("origin")) for k, name in enumerate(LISTS[mode])]
    if not parts:
        return chunks.select("chunk", F.lit(0).alias("nth"), F.lit(0.0).alias("score"), F.lit("").alias("origin")).limit(0)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.groupBy("chunk").agg(F.min(F.struct("nth", "turn", "origin")).alias("f"), F.max("cosine").alias("cosine")).orderBy("f.nth", "f.turn").limit(most)
    kept = first.select("chunk", "cosine", F.col("f.origin").alias("origin"), F.col("f.nth").alias("n"), F.col("f.turn").alias("t"))
    order = W.orderBy("n", "t")  # at most `most` rows from here on
    if budget is not None:
        sized = kept.join(chunks.select("chunk", "tokens"), "chunk", "left")
        used = F.sum(F.coalesce("tokens", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
        kept = sized.withColumn("used", used).where(F.col("used") <= budget).drop("used", "tokens")
    placed = kept.withColumns({"nth": F.row_number().over(order), "total": F.count("*").over(W.partitionBy(F.lit(0)))})
    return placed.select("chunk", "nth", branch_score(F.col("cosine"), F.col("nth"), F.col("total")).alias("score"), "origin")


def branch_score(cosine: Column, nth: Column, total: Column) -> Column:
    return fusion.graph_branch_score(cosine, nth, total)

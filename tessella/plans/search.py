"""The search API: keyword, semantic (hybrid) and entity evidence over chunk tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import fulltext, fusion, graph, retrieval, vector
from tessella.storage import written

MODES = retrieval.MODES


def keyword(chunks: DataFrame, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """chunks: doc_id, chunk_id, title, content. Late columns are fetched for the hits only."""
    keyed = chunks.withColumn("_k", F.struct("doc_id", "chunk_id"))
    hits = fulltext.keyword_search(keyed.select("_k", "title", "content"), query, limit, offset, "_k", ["title", "content"])
    return hits.select("_k.doc_id", "_k.chunk_id", "score").join(chunks, ["doc_id", "chunk_id"])


def semantic(chunks: DataFrame, query: str, query_vector: list[float] | None, limit: int = 20, mode: str = "mix", nodes: DataFrame | None = None, relations: DataFrame | None = None, theme_vector: list[float] | None = None, rerank: Callable[[DataFrame, str], DataFrame] | None = None, images: DataFrame | None = None) -> DataFrame:
    """Fused hits of the vector, keyword and graph branches, each asked for twice the limit; unknown modes are hybrid.

    chunks: doc_id, chunk_id, title, content, embedding. With nodes (name, embedding, chunk_ids) and
    relations (source, target, embedding, chunk_ids), the graph branch retrieves by mode
    (`retrieval.graph_retrieve`; theme_vector is that of the relations' level); chunk ids there are
    "<doc_id>/<chunk_id>". With nodes (name, chunk_ids) alone it takes the chunks of entities that the
    query names. Without a vector, the vector branch is left out and the graph goes by names.
    """
    mode = mode if mode in MODES else "hybrid"
    cols = ["doc_id", "chunk_id", "title", "content"]
    full = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string"))
    branches: dict[str, DataFrame] = {}
    if query_vector:
        keyed = chunks.withColumn("_k", F.struct("doc_id", "chunk_id"))
        best = vector.search(keyed, query_vector, 2 * limit, id_col="_k").select("_k.doc_id", "_k.chunk_id", "score")
        branches["direct"] = best.join(chunks.select(*cols), ["doc_id", "chunk_id"])
    if mode != "bypass":
        branches["keyword"] = keyword(chunks.select(*cols), query, 2 * limit)
    hit = None
    if nodes is not None and relations is not None and query_vector and mode != "bypass":
        sized = chunks.select(full.alias("chunk"), "embedding", F.lit(0).alias("tokens"))
        hit = retrieval.graph_retrieve(mode, sized, nodes, relations, query_vector, theme_vector, limit).where(F.col("nth") <= 2 * limit)
    elif nodes is not None and mode not in ("naive", "bypass"):
        wanted = nodes.sparkSession.createDataFrame([(t,) for t in dict.fromkeys([query, *query.split()])], "entity string")
        found = graph.evidence(nodes, wanted, retrieval.chunk_top_k(limit)).groupBy(F.col("chunk_id").alias("chunk")).agg(F.min("nth").alias("n")).orderBy("n", "chunk").limit(2 * limit)
        placed = found.withColumns({"nth": F.row_number().over(W.orderBy("n", "chunk")), "total": F.count("*").over(W.partitionBy(F.lit(0)))})  # a top-k
        hit = placed.select("chunk", fusion.graph_branch_score(F.lit(None).cast("double"), F.col("nth"), F.col("total")).alias("score"))
    if hit is not None:
        branches["graph"] = hit.join(chunks.select(*cols, full.alias("chunk")), "chunk").select(*cols, "score")
    branches = {k: v.select(*cols, "score") for k, v in branches.items()}
    if rerank:
        branches = {k: rerank(v, query) for k, v in branches.items()}
    out = fusion.fuse(branches, query, limit)
    return fusion.attach_images(out, images) if images is not None else out


def entity_evidence(nodes: DataFrame, chunks: DataFrame, documents: DataFrame, entity: str, limit: int = 8) -> DataFrame:
    """The chunks of an entity with their documents' names, in order, each with score 1."""
    found = graph.evidence(nodes, nodes.sparkSession.createDataFrame([(entity,)], "entity string"), limit)
    full = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string")).alias("full_id")
    texts = chunks.select(full, "content").join(F.broadcast(found.select(F.col("chunk_id").alias("f_id"))), F.col("full_id") == F.col("f_id"), "left_semi")  # at most `limit` rows
    named = documents.select(F.col("doc_id").cast("string").alias("d_id"), "name")
    doc = F.when(F.instr("chunk_id", "/") > 1, F.substring_index("chunk_id", "/", 1)).otherwise("")
    out = found.withColumn("document_id", doc).join(texts, F.col("chunk_id") == F.col("full_id"), "left").join(named, F.col("document_id") == F.col("d_id"), "left")
    return out.select("nth", "chunk_id", "document_id", F.coalesce("name", F.lit("")).alias("document_name"), F.coalesce("content", F.lit("")).alias("content"), F.lit(1.0).alias("score"), F.lit("entity_lookup").alias("source"))


def entity_or_semantic(nodes: DataFrame, chunks: DataFrame, documents: DataFrame, entity: str, query_vector: list[float] | None = None, limit: int = 8, relations: DataFrame | None = None) -> DataFrame:
    """The evidence of an entity; if the graph doesn't know it, what a semantic search for its name finds (source "semantic")."""
    known = written(entity_evidence(nodes, chunks, documents, entity, limit))
    if not known.isEmpty():
        return known
    full = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string"))
    found = semantic(chunks, entity, query_vector, limit, "mix", nodes, relations)
    named = documents.select(F.col("doc_id").cast("string").alias("d_id"), "name")
    out = found.withColumn("document_id", F.col("doc_id").cast("string")).join(named, F.col("document_id") == F.col("d_id"), "left")
    return out.select(F.col("rank").alias("nth"), full.alias("chunk_id"), "document_id", F.coalesce("name", F.lit("")).alias("document_name"), F.coalesce("content", F.lit("")).alias("content"), "score", F.lit("semantic").alias("source"))

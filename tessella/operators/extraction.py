"""Entities and relations out of chunks, by an extractor that is given, into graph tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessella.operators.graph import SEPARATOR

#: A function from texts to results, one for each: {"entities": [{name, type, description}], "relations": [{source, target, description, weight}]}.
Extractor = Callable[[list[str]], list[dict]]
ENTITY = "struct<name:string,type:string,description:string>"
RELATION = "struct<source:string,target:string,description:string,weight:double>"
# The types that an extractor is asked for.
TYPES = (
    "technology", "framework", "architecture", "protocol",
    "pattern", "concept", "algorithm", "component",
    "service", "platform", "module", "interface",
    "strategy", "mechanism", "pipeline", "workflow",
    "organization", "person", "location", "document",
)
_STORED = f"hash string, entities array<{ENTITY}>, relations array<{RELATION}>, error string"


def text_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def stored(chunks: DataFrame, store: str) -> DataFrame | None:
    try:
        return chunks.sparkSession.read.schema(_STORED).parquet(store)
    except AnalysisException:
        return None


def extract(chunks: DataFrame, extractor: Extractor, store: str, types: tuple[str, ...] | None = TYPES, batch: int = 16) -> DataFrame:
    """The store (hash, entities, relations, error) after the chunks (chunk_id, content) have been extracted.

    Results are kept by the hash of the text, so each distinct text is handed over once, in lists of
    `batch`, and a rerun hands over new ones only, and those that failed. A text that the extractor
    raises on is kept with its error and has no results; its list is then tried one by one. Names are
    trimmed, those without one are left out, and so are relations of an end to itself; a type that is
    not among `types` counts as "other". An aborted run leaves the store as it was.
    """
    texts = chunks.select(text_hash(F.col("content")).alias("hash"), F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["hash"])
    known = stored(chunks, store)
    if known is not None:
        texts = texts.join(known.where("error IS NULL").select("hash"), "hash", "left_anti")

    def clean(found: dict) -> tuple[list[dict], list[dict]]:
        entities, relations = [], []
        for e in found.get("entities") or ():
            name = str(e.get("name") or "").strip()
            kind = str(e.get("type") or "other").strip().lower()
            if name:
                entities.append({"name": name, "type": kind if types is None or kind in types else "other", "description": str(e.get("description") or "")})
        for r in found.get("relations") or ():
            a, b = (str(r.get(k) or "").strip() for k in ("source", "target"))
            if a and b and a != b:
                relations.append({"source": a, "target": b, "description": str(r.get("description") or ""), "weight": float(r.get("weight") or 1.0)})
        return entities, relations

    def ask(some: list[str]) -> list[tuple[dict | None, str | None]]:
        try:
            found = extractor(some)
            if len(found) != len(some):
                raise ValueError("the extractor gives one result for each text")
            return [(f, None) for f in found]
        except Exception as e:  # whatever an extractor raises is kept beside its text
            return [(None, f"{type(e).__name__}: {e}")] if len(some) == 1 else [r for t in some for r in ask([t])]

    shape = to_arrow_schema(_parse_datatype_string(_STORED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):  # only so many texts are Python's at once
                hashes, texts = (c.to_pylist() for c in b.slice(at, batch).columns)
                out = []
                for h, (found, error) in zip(hashes, ask(texts), strict=True):
                    entities, relations = clean(found) if found is not None else ([], [])
                    out.append({"hash": h, "entities": entities, "relations": relations, "error": error})
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    texts.mapInArrow(run, _STORED).write.mode("append").parquet(store)
    return stored(chunks, store)


def mentions(chunks: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each chunk (chunk_id "<document>/...", content) says: (chunk_id, name, type, description) and (chunk_id, source, target, description, weight).

    Edges are undirected: the smaller end is the source.
    """
    good = results.where("error IS NULL").dropDuplicates(["hash"])
    said = chunks.select("chunk_id", text_hash(F.col("content")).alias("hash")).join(good, "hash")
    entities = said.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", "e.*")
    relations = said.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", F.least("r.source", "r.target").alias("source"), F.greatest("r.source", "r.target").alias("target"), "r.description", "r.weight")
    return entities, relations


def _listed(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(column), F.lit("")))), SEPARATOR)


def merge_mentions(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, entity_type, description, source_id) and edges (source, target, weight, description, source_id).

    A node's type is the one that most mentions give it (ties: the first by name), descriptions and sources
    are united, weights summed over chunks. Ends of relations that no chunk names are nodes of type "other".
    """
    kinds = entities.groupBy("name", "type").agg(F.count("*").alias("n"))
    kind = kinds.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("k")).select(F.col("name").alias("k_name"), F.col("k.type").alias("entity_type"))
    ends = relations.select("chunk_id", F.explode(F.array("source", "target")).alias("name"), F.lit("").alias("description"))
    every = entities.select("chunk_id", "name", "description").unionByName(ends)
    nodes = every.groupBy("name").agg(_listed("description").alias("description"), _listed("chunk_id").alias("source_id"))
    nodes = nodes.join(kind, F.col("name") == F.col("k_name"), "left").select(F.col("name").alias("id"), F.coalesce("entity_type", F.lit("other")).alias("entity_type"), "description", "source_id")
    edges = relations.groupBy("source", "target").agg(F.sum("weight").alias("weight"), _listed("description").alias("description"), _listed("chunk_id").alias("source_id"))
    return nodes, edges


def purge(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what the documents (doc_id) said; only those that they touched are merged again from the other mentions."""
    doc = F.substring_index("chunk_id", "/", 1)
    dead = gone.select(F.col("doc_id").cast("string").alias("g")).distinct()
    of_gone = lambda d: d.join(dead, doc == F.col("g"), "left_semi")
    left = lambda d: d.join(dead, doc == F.col("g"), "left_anti")
    names = of_gone(entities).select("name").union(of_gone(relations).select(F.explode(F.array("source", "target")))).distinct().select(F.col("name").alias("t_name"))
    pairs = of_gone(relations).select(F.col("source").alias("t_source"), F.col("target").alias("t_target")).distinct()
    on_pair = lambda d: (d["source"] == F.col("t_source")) & (d["target"] == F.col("t_target"))
    some_e = left(entities).join(names, F.col("name") == F.col("t_name"), "left_semi")
    rest = left(relations)
    some_r = rest.join(names, F.col("source") == F.col("t_name"), "left_semi").unionByName(rest.join(names, F.col("target") == F.col("t_name"), "left_semi").join(names, F.col("source") == F.col("t_name"), "left_anti"))
    new_nodes, _ = merge_mentions(some_e, some_r)
    _, new_edges = merge_mentions(some_e, rest.join(pairs, on_pair(rest), "left_semi"))
    new_nodes = new_nodes.join(names, F.col("id") == F.col("t_name"), "left_semi")
    return nodes.join(names, F.col("id") == F.col("t_name"), "left_anti").unionByName(new_nodes), edges.join(pairs, on_pair(edges), "left_anti").unionByName(new_edges)

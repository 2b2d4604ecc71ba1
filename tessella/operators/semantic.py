"""Semantic chunks and chunks along a structure table, over all documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessella.operators import chunking, macro, vector
from tessella.storage import written


def embedded(sentences: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """Sentences (sentence) with their embedding; lists of `batch` go across documents."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sentences.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield part.assign(embedding=list(np.asarray(embed(list(part["sentence"])), dtype=float)))

    return sentences.mapInPandas(run, f"{columns}, embedding array<double>")


def semantic_numbers(sentences: DataFrame, most: int, threshold: float = 0.55, jump: int = 1) -> DataFrame:
    """(doc_id, idx, chunk) of sentences (doc_id, idx, tokens, embedding): the chunk that each one belongs to, from 0.

    A chunk ends at a valley (a similarity to the next sentence under the threshold), unless the last
    valley that counted is at most `jump` sentences before and what lies between is under 1.2 * most
    tokens; and wherever `most` tokens are full. Neighbours meet by the two-level lead of
    `vector.adjacent_similarity`; the rest is one pass over narrow rows in order, which holds a few
    numbers, so that a very long document is never in memory. A vector of no length is like nothing.
    """
    norm = F.sqrt(vector.dot(F.col("embedding"), F.col("embedding")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))
    known = written(sentences.select("doc_id", "idx", F.col("tokens").cast("long").alias("tokens"), unit.alias("unit")))
    alike = vector.adjacent_similarity(known.select("doc_id", "idx", "unit"), "doc_id", "idx", "unit")
    alike = alike.select(F.col("doc_id").alias("a_doc"), F.col("idx").alias("a_idx"), (F.col("similarity") < threshold).alias("valley"))
    rows = known.join(alike, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("idx") == F.col("a_idx")), "left").select("doc_id", "idx", "tokens", F.coalesce("valley", F.lit(False)).alias("valley"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc: object = fold  # no document is this one
        at = number = last = since = total = 0
        after = counted = False
        for b in batches:
            out = np.zeros(len(b), np.int64)
            docs = [None if pd.isna(d) else d for d in b["doc_id"]]
            for k, (d, size, valley) in enumerate(zip(docs, b["tokens"].to_numpy(), b["valley"].to_numpy(), strict=True)):
                if d != doc:
                    doc, at, number, since, total, after, counted = d, 0, 0, 0, 0, False, False
                if after and not (counted and at - last <= jump and since < int(most * 1.2)):
                    number, last, since, total, counted = number + 1, at, 0, 0, True
                elif total and total + size > most:
                    number, total = number + 1, 0
                out[k] = number
                at, since, total, after = at + 1, since + size, total + size, valley
            yield pd.DataFrame({"doc_id": b["doc_id"], "idx": b["idx"], "chunk": out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "idx").mapInPandas(fold, f"doc_id {kinds['doc_id']}, idx {kinds['idx']}, chunk long")


def semantic_chunks(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], most: int, threshold: float = 0.55, jump: int = 1) -> DataFrame:
    """(doc_id, chunk, content) of documents (doc_id, text), cut at semantic boundaries of their sentences."""
    each = chunking.sentences(docs)
    each = written(embedded(each.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("sentence") / 2))), embed))
    placed = semantic_numbers(each, most, threshold, jump).withColumnsRenamed({"doc_id": "n_doc", "idx": "n_idx"})
    met = each.join(placed, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("idx") == F.col("n_idx")))
    lists = met.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("s"))  # of at most `most` tokens, or one sentence
    return lists.select("doc_id", "chunk", F.array_join(F.transform("s", lambda x: x["sentence"]), "").alias("content"))


def structure_chunks(texts: DataFrame, sections: DataFrame, most: int) -> DataFrame:
    """(doc_id, idx, path, content, tokens): texts (doc_id, text) cut along their sections (doc_id, idx, text, level) in order.

    Text and sections of a document meet in one row; headings are looked for from where the last one
    was found on. A document without sections, or none of whose sections is found, gives no rows.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    lists = sections.groupBy(F.col("doc_id").alias("s_doc")).agg(F.sort_array(F.collect_list(F.struct("idx", "text", "level"))).alias("s"))
    met = texts.select("doc_id", "text").join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("s_doc")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    named = [{"text": s["text"], "level": s["level"]} for s in row["s"]]
                    out += [(row["doc_id"], k, m.path, m.content, m.tokens) for k, m in enumerate(macro.structure_split(row["text"] or "", named, most))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, shape, strict=True)], schema=shape)

    shape = to_arrow_schema(_parse_datatype_string(f"doc_id {kind}, idx int, path string, content string, tokens long"))
    return met.select("doc_id", "text", "s").mapInArrow(cut, f"doc_id {kind}, idx int, path string, content string, tokens long")

"""Files in and out: uploads, conversion checks, manifests, packed vectors, text sinks, event streams."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FORMATS = ("pdf", "docx", "pptx", "html", "epub", "txt", "md")
MOST_BYTES = 100 << 20


def uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, format, size, hash, content, accepted): files of a folder; empty, large and unknown ones are not accepted."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    fmt = F.lower(F.element_at(F.split(name, r"\."), -1))
    return raw.select("path", name.alias("name"), fmt.alias("format"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content", (fmt.isin(*FORMATS) & (F.col("length") > 0) & (F.col("length") <= MOST_BYTES)).alias("accepted"))


def convert_text(files: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Adds markdown: text and Markdown as they are, HTML by the page converter; other formats by injected converters, else null."""
    from tessella.sources.html_markdown import to_markdown

    plain = lambda b: b.decode("utf-8", "replace")
    known = {"txt": plain, "md": plain, "html": lambda b: to_markdown(plain(b))} | (converters or {})

    @F.pandas_udf("string")
    def run(fmt: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([known[f](c) if f in known and c is not None else None for f, c in zip(fmt, content, strict=True)], dtype=object)

    return files.withColumn("markdown", run("format", "content"))


def text_layer(pages: DataFrame, sampled: int = 200) -> DataFrame:
    """(doc_id, pages, ratio): the share of pages with over 50 characters; of long documents, of evenly spaced pages.

    pages: doc_id, page (from 0), text. Probing a sample is the feature: it decides a route only.
    """
    n = F.count("*").over(W.partitionBy("doc_id"))
    step = F.greatest(F.lit(1.0), F.col("n") / sampled)
    seen = pages.withColumn("n", n).where((F.col("n") <= sampled) | (F.floor(F.col("page") / step) != F.floor((F.col("page") - 1) / step)))
    return seen.groupBy("doc_id").agg(F.max("n").alias("pages"), F.avg((F.length(F.trim("text")) > 50).cast("int")).alias("ratio"))


def takes_bypass(pages: Column, ratio: Column) -> Column:
    return (pages >= 80) & (ratio >= 0.5)


def synthesize_headings(lines: DataFrame) -> DataFrame:
    """Short numbered lines of a text layer become headings by the depth of their number."""
    number = F.regexp_extract("line", r"^\s*(\d+(?:\.\d+){0,3})[.\s]\s*\S", 1)
    depth = F.size(F.split(number, r"\.")) + 1
    chapter = F.col("line").rlike(r"^\s*(第[一二三四五六七八九十百\d]+[章节]|Chapter\s+\d+)")
    short = F.length(F.trim("line")) <= 60
    head = F.when(chapter & short, F.lit("## ")).when((number != "") & short & ~F.col("line").rlike(r"[.。；;,，]\s*$"), F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "))).otherwise("")
    return lines.withColumn("line", F.concat(head, F.when(head != "", F.trim("line")).otherwise(F.col("line"))))


def poor_coverage(pages_seen: Column, pages: Column, chars: Column, expected_chars: Column) -> Column:
    """A conversion that lost pages or text: the other route is tried."""
    return (pages_seen / pages < 0.6) | ((expected_chars > 500) & (chars / expected_chars < 0.4))


def structure(items: DataFrame) -> DataFrame:
    """(doc_id, sections, texts, tables, pictures) from labelled items (doc_id, idx, label, text, level, page)."""
    bucket = F.when(F.col("label").isin("section_header", "title"), "sections").when(F.col("label") == "table", "tables").when(F.col("label").isin("picture", "figure"), "pictures").otherwise("texts")
    entry = F.struct("idx", F.substring("text", 1, 5000).alias("text"), "level", "page")
    rows = items.select("doc_id", bucket.alias("bucket"), entry.alias("e"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.col("e")))).alias(b) for b in ("sections", "texts", "tables", "pictures")]
    return rows.groupBy("doc_id").agg(*lists)


def image_manifest(images: DataFrame) -> DataFrame:
    """(doc_id, filename, bytes) of images (doc_id, idx, content); specks are skipped, equal ones named alike."""
    kept = images.where(F.length("content") >= 100)
    return kept.select("doc_id", F.concat(F.lit("img_"), F.substring(F.md5("content"), 1, 8), F.lit(".png")).alias("filename"), F.length("content").alias("bytes")).dropDuplicates(["doc_id", "filename"])


def conversion_misses(files: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Files without a finished conversion under (hash, size, version)."""
    good = done.where((F.col("version") == version) & F.col("complete")).select("hash", "size")
    return files.join(good, ["hash", "size"], "left_anti")


def pack_vectors(vectors: list[list[float]]) -> bytes:
    """int32 count, int32 dimension, float32 values, all little-endian."""
    dim = len(vectors[0]) if vectors else 0
    return struct.pack("<ii", len(vectors), dim) + b"".join(struct.pack(f"<{dim}f", *v) for v in vectors)


def read_packed_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, embedding) of packed vector files; a file of another size than its head says gives no rows."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                n, dim = struct.unpack_from("<ii", c) if len(c) >= 8 else (0, 0)
                ok = n > 0 and dim > 0 and len(c) == 8 + 4 * n * dim
                rows = [struct.unpack_from(f"<{dim}f", c, 8 + 4 * dim * k) for k in range(n)] if ok else []
                if rows:
                    yield pd.DataFrame({"path": p, "offset": range(len(rows)), "embedding": [list(r) for r in rows]})

    return raw.mapInPandas(run, "path string, offset int, embedding array<float>")


def embedding_manifest(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, offset): where each chunk's vector stands in its document's file."""
    return chunks.select("doc_id", "chunk_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("idx")) - 1).alias("offset"))


def order_chunk_files(files: DataFrame) -> DataFrame:
    """By the number in the name, names without one last."""
    number = F.try_to_number(F.nullif(F.regexp_extract("name", r"chunk_(\d+)\.md$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    return files.orderBy(number.asc_nulls_last(), "name")


def kv_store(spark: SparkSession, text: str | None) -> DataFrame:
    """(name, chunk_ids) of a JSON store {name: {chunk_ids: [...]}}; missing or malformed is empty."""
    schema = "name string, chunk_ids array<string>"
    raw = spark.createDataFrame([(text,)], "raw string")
    got = raw.select(F.explode(F.from_json("raw", "map<string,struct<chunk_ids:array<string>>>")).alias("name", "v"))
    return got.select("name", F.coalesce("v.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")).to(spark.createDataFrame([], schema).schema)


def write_text(rows: DataFrame, path: str, key: str, text: str) -> None:
    """One folder of text files for each key."""
    rows.select(F.col(key).cast("string").alias(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def okf_entries(entries: DataFrame) -> DataFrame:
    """(slug, text): an entry with its front matter."""
    head = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct("title")), F.lit("\ntype: "), F.col("type"), F.lit("\nconfidence: "), F.col("confidence").cast("string"), F.lit("\nsources: "), F.to_json("refs"), F.lit("\n---\n\n"))
    return entries.select("slug", F.concat(head, F.col("content")).alias("text"))


def sse_encode(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def sse_parse(stream: DataFrame, schema: str) -> DataFrame:
    """(event, data) of raw event streams (raw); malformed data is null."""
    one = stream.select(F.explode(F.split("raw", "\n\n")).alias("e")).where("trim(e) <> ''")
    return one.select(F.coalesce(F.nullif(F.regexp_extract("e", r"(?m)^event: ?(.*)$", 1), F.lit("")), F.lit("message")).alias("event"), F.from_json(F.regexp_extract("e", r"(?m)^data: ?(.*)$", 1), schema).alias("data"))


def valid_checkpoint(raw: str, input_hash: str, version: int = 1) -> dict | None:
    """A checkpoint written for the same input and version, else None."""
    try:
        got = json.loads(raw)
    except ValueError:
        return None
    good = isinstance(got, dict) and got.get("version") == version and got.get("inputHash") == input_hash and isinstance(got.get("completed"), list)
    return got if good else None


def orphans(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Folders of documents that do not exist; they are reported, not deleted."""
    return folders.join(documents.select("doc_id"), "doc_id", "left_anti")

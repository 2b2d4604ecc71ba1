"""Joins that put a document's parts together, and small rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.matching import holding
from tessella.storage import written


def backfill_pages(atoms: DataFrame, sections: DataFrame) -> DataFrame:
    """Atoms with the page of the last heading that the converter's structure (doc_id, pos, text, page) has a page for.

    Headings meet sections by lower-cased, trimmed text; of equal sections the last one counts.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    pages = sections.where("page IS NOT NULL").groupBy("doc_id", key("text").alias("h")).agg(F.max_by("page", "pos").alias("found"))
    own = F.when(F.col("kind") == "heading", key("content"))
    joined = atoms.withColumn("h", own).join(pages, ["doc_id", "h"], "left").drop("h")
    above = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn("page", F.last("found", ignorenulls=True).over(above)).drop("found")


def document_detail(documents: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Each document with its parent's name, its children, the number of its chunks and its tags."""
    kids = documents.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("id"), "name"))).alias("children"))
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    t = tags.groupBy("doc_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    up = documents.select(F.col("doc_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return documents.join(up, "parent_id", "left").join(kids, "doc_id", "left").join(n, "doc_id", "left").join(t, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def cross_references(entries: DataFrame, references: DataFrame) -> DataFrame:
    """Typed links (from_id, to_id, relation) of references (from_title, to_title, relation) to entries whose titles hold them.

    Of several entries the one of least id; a reference to itself or to nothing is dropped.
    """
    asked = references.select(F.explode(F.array("from_title", "to_title")).alias("asked")).distinct().withColumn("low", F.lower("asked"))
    named = entries.groupBy(F.lower("title").alias("title")).agg(F.min("id").alias("id"))  # of equal titles only the least id can be asked for
    found = written(holding(named, asked, "title", "low").groupBy("asked").agg(F.min("id").alias("id")))
    a, b = found.select(F.col("asked").alias("from_title"), F.col("id").alias("from_id")), found.select(F.col("asked").alias("to_title"), F.col("id").alias("to_id"))
    return references.join(a, "from_title").join(b, "to_title").where("from_id <> to_id").select("from_id", "to_id", "relation").distinct()


def update_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with new vectors (chunk_id, embedding) where there are some; vectors without a chunk are passed over."""
    new = vectors.select("chunk_id", F.col("embedding").alias("_new"))
    return chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def domain_context(hits: DataFrame, most: int = 5, each: int = 500) -> DataFrame:
    """(context): the first hits, numbered and cut."""
    top = hits.orderBy("rank").limit(most)
    lines = top.agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, each)).alias("line")))).alias("l"))
    return lines.select(F.nullif(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"), F.lit("")).alias("context"))


def cleanup_retries(tasks: DataFrame, most: int, delay_ms: int) -> DataFrame:
    """Failed clean-ups that are tried again: transient messages only, with the next attempt and when it may start."""
    again = tasks.where((F.col("status") == "failed") & (F.col("attempt") < most) & F.col("error").rlike(r"(?i)timeout|busy|locked|transient|ECONNRESET|ETIMEDOUT"))
    return again.withColumn("attempt", F.col("attempt") + 1).withColumn("not_before", F.timestamp_millis(F.unix_millis(F.col("finished_at").cast("timestamp")) + delay_ms))


def document_locale(title: Column) -> Column:
    return F.when(title.rlike(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"), "zh-CN").otherwise("en")


def strip_leading_title(content: Column, title: Column) -> Column:
    """Content without its first line, if that line says no more than the section's title."""

    def plain(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s{0,3}#{1,6}\s*", ""), r"^\s*[-*+]\s+", ""), r"^\s*\d+(\.\d+)*\.?\s*", "")
        return F.regexp_replace(bare, r"[*_`~#：:，,。.\s]", "")

    body = F.regexp_replace(content, r"^(\s*\r?\n)+", "")
    first = F.substring_index(body, "\n", 1)
    rest = F.regexp_replace(F.substring(body, F.length(first) + 2, F.length(body)), r"^\s+", "")
    same = (plain(first) == plain(title)) & (plain(title) != "") & (F.trim(content) != "")
    return F.when(F.coalesce(same, F.lit(False)), rest).otherwise(content)


def delete_documents(documents: DataFrame, asked: DataFrame, user, children: dict[str, DataFrame], index: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame, DataFrame]:
    """Documents, child tables and full-text index after a user's documents are deleted, and (doc_id, outcome) of each one asked for.

    documents: doc_id, user_id; asked: doc_id; children: tables with doc_id, "chunks" among them
    with chunk_id; index: rows with chunk_id. Another user's document is not found. The index
    keeps only rows of chunks that are left, so orphans of earlier deletes go too.
    """
    wanted = asked.select("doc_id").where("doc_id IS NOT NULL").distinct()
    gone = documents.where(F.col("user_id") == user).join(wanted, "doc_id", "left_semi").select("doc_id").distinct()
    kept = {name: rows.join(gone, "doc_id", "left_anti") for name, rows in children.items()}
    outcome = wanted.join(gone.withColumn("outcome", F.lit("deleted")), "doc_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("not found")))
    return documents.join(gone, "doc_id", "left_anti"), kept, index.join(kept["chunks"].select("chunk_id"), "chunk_id", "left_semi"), outcome

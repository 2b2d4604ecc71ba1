"""The synthetic tables as the tables that the operators work on. Every mapping uses all rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.index import StoredIndex
from tessella.storage import shared_dir

AS_OF = "2024-01-30 12:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The stored index of documents, built where there is none for the files as they are.

    Its name is a digest of the files' paths, sizes and times; a group of documents is some 32 MB of
    files. It counts as built once its statistics are there, which are written last.
    """
    meta = read(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    got = meta.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("name"), F.sum("file_size").alias("bytes")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(got["bytes"] or 0) >> 25))
    index = StoredIndex(spark, f"{shared_dir(spark)}/index/{got['name'] or 0}-{parts}", parts)
    try:
        index.statistics()
    except AnalysisException:
        index.build(read(spark, sf_dir, "documents"))
    return index


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as token usage: the type is the module; one user in seven has no model."""
    e = read(spark, sf_dir, "events")
    model = F.col("user_id") % 7
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("module"), F.when(model > 0, model).alias("model_id"), F.floor("value").cast("long").alias("tokens_in"), (F.col("event_id") % 50).cast("long").alias("tokens_out"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations 1 to 5 as models, their regions as providers; model 6 is unknown."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.where("n_nationkey BETWEEN 1 AND 5").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("model_id"), F.col("n_name").alias("model"), F.col("r_name").alias("provider"))  # fixed dimensions of 25 and 5 rows


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tasks: F is done, O waits, P runs; the customer is the document."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_custkey").alias("document_id"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as section references: the order is the section, the customer's hundred the draft, the supplier the document."""
    li = read(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 100).alias("draft_id"), F.col("l_orderkey").alias("section_id"), F.col("l_suppkey").alias("document_id"), F.concat(F.lit("doc-"), F.col("l_suppkey").cast("string")).alias("document_name"), F.col("l_discount").alias("relevance"), F.when(F.col("l_returnflag") == "R", "wiki").otherwise("rag_chunk").alias("source_type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-supplier pairs of lineitem as a graph, weighted by their lines."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).agg(F.count("*").alias("weight"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as sections of drafts (the customer)."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "revising").otherwise("pending")
    return o.select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("section_id"), status.alias("status"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("words"))

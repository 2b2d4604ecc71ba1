"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every operator of this subpackage understands them.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A group of over one in SHARE of all rows is hot; there are at most SHARE of them, so that they can be broadcast.
SHARE = 1000
#: log2 of the slots of a sieve: its bits are broadcast in at most 2^(SIEVE_BITS - 6) rows of 16 bytes.
SIEVE_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it as long as df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder: rows (and row ids) stay as they are if an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A narrow intermediate as a Parquet table in the shared folder; its file size lets Spark choose the join."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, then what it has freed goes back to the system: workers stay for later stages and would hold it."""

    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass

    return go


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of Arrow batches of Python stages, unless the session did; Spark bounds their bytes itself."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))


def sieve(wanted: DataFrame) -> DataFrame:
    """A bitmap of the keys in wanted (one long column), of bounded size whatever their number; to be used by `sifted`."""
    slot = F.pmod(F.col(wanted.columns[0]), F.lit(1 << SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    return written(wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")))


def sifted(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: false where the key is surely not in the sieve. No row is shuffled for that."""
    word, held = fresh(rows, "sieve_word", "sieve_bits")
    slot = F.pmod(key, F.lit(1 << SIEVE_BITS))
    small = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(held)))  # at most 2^(SIEVE_BITS - 6) rows
    hit = F.call_function("shiftright", F.col(held), (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(small, F.shiftright(slot, 6) == F.col(word), "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, held)


def with_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to their groups (row column -> group column), of which `size` counts the rows.

    Hot groups are at most SHARE and are broadcast, so that none is gathered in one task; the
    others meet their rows by a shuffle. Both inputs are read more than once: pass written tables.
    """
    same = lambda g: [rows[r] == g[k] for r, k in on.items()]
    hot = groups.where(F.col(size) * SHARE > total)
    names = F.broadcast(hot.select(*on.values()))
    cold = groups.where(F.col(size) * SHARE <= total)
    rest = rows.join(names, same(names), "left_anti").join(cold, same(cold), how)
    hot = F.broadcast(hot)
    return rows.join(hot, same(hot)).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: one row (node, component) for each node of an edge; component is the smallest node.

    Each round, every node points at the neighbour (or itself) of least random priority, the
    edges are contracted along those pointers, and the rounds end when no edge is left. The
    minimum is a partial aggregate, so a hub is summed up before it is shuffled; priorities are
    hashes, so that chains shrink by a constant factor whatever their ids. Only row counts reach
    the driver. Empty edges give an empty result; edges with a null end are ignored, and so are
    self-loops, except that a self-loop's node is reported.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    where = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("at", F.col("node"))
    live = checkpointed(links.where("a <> b").distinct())
    rank = lambda c: F.struct(F.xxhash64(F.col(c)).alias("r"), F.col(c).alias("v"))
    while not live.isEmpty():  # the edges at each node of least rank are contracted, so that every round leaves fewer
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("p_from"), F.least(F.col("m"), rank("a"))["v"].alias("p_to"))
        to = checkpointed(to)
        where = where.join(to, F.col("at") == F.col("p_from"), "left").select("node", F.coalesce("p_to", "at").alias("at"))
        first, second = to.select(F.col("p_from").alias("a"), F.col("p_to").alias("pa")), to.select(F.col("p_from").alias("b"), F.col("p_to").alias("pb"))
        live = checkpointed(live.join(first, "a").join(second, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    where = checkpointed(where)
    least = checkpointed(where.groupBy("at").agg(F.min("node").alias("component"), F.count("*").alias("size")).withColumnRenamed("at", "root"))
    return with_groups(where, least, {"at": "root"}, "size", where.count()).select("node", "component")

"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm._base import WORD, checkpointed, fresh, text_or_empty, written


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: float = 3.0, total: float | None = None) -> DataFrame:
    """(source, source_size) -> adds weight and target.

    Weights repeat over the sources in code point order, null last. Targets share `total` (by
    default all sizes) by weight, stop at max_copies times the source's size, and the excess is
    shared again by weight until none is above. Each turn of that water-filling is one aggregate
    that returns two sums; the driver never holds the sources. A source of size 0 has target 0.
    """
    dealt = checkpointed(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    held = checkpointed(dealt.join(offsets, "part").withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_copies)))
    every = held.agg(F.sum("source_size")).first()[0] or 0
    want = float(every) if total is None else float(total)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.col("weight") * level
        got = held.agg(F.sum(F.when(full, F.col("cap"))).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        new = (want - (got["c"] or 0.0)) / got["w"] if got["w"] else float("inf")
        if level is not None and new <= level:
            break
        level = new
        if level == float("inf"):
            break
    share = F.col("cap") if level == float("inf") else F.least("cap", F.col("weight") * level)
    return held.select("source", "source_size", "weight", share.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    Each document of a source is expected target / source_size times. Documents of a source are
    ordered by (size, id): sampling systematically along that order spreads the takes over all
    sizes, so the words taken stay within about one longest document of the target. The prefix
    sum of expected copies is rank x rate; adding one offset in [0, 1), drawn for the source
    from `seed`, a document is emitted once for each integer that its step crosses.

    The rank is found in two levels, so that no source is gathered in one task: rows are range
    partitioned by (source, size, id) and ranked inside their partition, and the small table of
    row counts by (partition, source) gives each partition its offset.

    Null text has size 0 and may be emitted, taking no words; null sources are one source, put
    last. Ties and repeated rows take adjacent ranks. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    base = written(base)  # texts are read once; range partitioning samples its input first
    dealt = base.repartitionByRange(F.col("source").asc_nulls_last(), "size", "id").withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)  # the bounds are sampled: both uses below must see the same partitions
    counts = dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = checkpointed(counts)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("o_part"), F.col("source").alias("o_source"), before.alias("before"))
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rates = offsets.join(targets, F.col("o_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    inside = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "id"))
    rows = dealt.withColumn("inside", inside).join(rates, (F.col("part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\0")))), 1, 5), 16, 10).cast("double") / F.lit(float(16**5))
    rank = F.col("before") + F.col("inside")
    crossed = F.floor(rank * rate + draw) - F.floor((rank - 1) * rate + draw)
    copies = F.least(crossed, F.lit(int(max_copies))).cast("int")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as mix_sources takes it, with their own columns only."""
    plan = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # Rows with one id, source and size are alike to the sampler: their copies are pooled and dealt out evenly.
    p_id, p_source, p_size, copies, n, words, each, nth, copy = fresh(docs, "p_id", "p_source", "p_size", "p_copies", "p_n", "p_words", "p_each", "p_nth", "p_copy")
    plan = plan.groupBy(F.col(id_col).alias(p_id), F.col("source").alias(p_source), F.col("size").alias(p_size)).agg(F.sum("copies").alias(copies), F.count("*").alias(n))
    keyed = docs.withColumn(words, word_count(text_or_empty(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(p_id)) & F.col(source_col).cast("string").eqNullSafe(F.col(p_source)) & (F.col(words) == F.col(p_size))
    joined = keyed.join(plan.where(F.col(copies) > 0), on)
    single = joined.where(F.col(n) == 1).withColumn(each, F.col(copies))
    place = F.row_number().over(Window.partitionBy(p_id, p_source, p_size).orderBy(F.xxhash64(F.col(text_col)))) - 1
    pooled = joined.where(F.col(n) > 1).withColumn(nth, place)
    pooled = pooled.withColumn(each, F.floor((F.col(nth) + 1) * F.col(copies) / F.col(n)) - F.floor(F.col(nth) * F.col(copies) / F.col(n))).drop(nth)
    out = single.unionByName(pooled).where(F.col(each) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Joins on one text standing inside another, by equality of short grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import written

GRAM = 3
SMALL = 4_000_000  # bytes of inner texts that are broadcast


def holding(outer: DataFrame, inner: DataFrame, outer_col: str, inner_col: str) -> DataFrame:
    """Rows of both where outer's text holds inner's, any number of rows on either side; empty texts stand in nothing.

    An inner text stands in another only if its first three characters (or all, of a shorter one)
    do: outer texts are joined on their grams, and what meets is looked at in full. Each distinct
    inner text is looked for once. Grams are many times what the tables' sizes tell, so they are
    never the side that is broadcast; the inner texts are only after they were measured.
    """
    o, i = F.col(outer_col), F.col("_inner")
    size = F.length(o)
    cut = lambda k: lambda at: F.substring(o, at, F.lit(k))
    each = [F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), cut(k))).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)]
    grams = F.array_distinct(F.flatten(F.array(*each)))
    led = written(inner.select(F.col(inner_col).alias("_inner")).where(F.length("_inner") > 0).distinct().withColumn("_lead", F.substring("_inner", 1, GRAM)))
    weight = led.agg(F.sum(F.octet_length("_inner") + 64)).first()[0] or 0
    led = F.broadcast(led) if weight <= SMALL else led.hint("merge")
    pairs = outer.withColumn("_gram", F.explode(grams)).join(led, F.col("_gram") == F.col("_lead")).where(F.contains(o, i)).drop("_gram", "_lead")
    if inner.columns == [inner_col]:
        return pairs.withColumnRenamed("_inner", inner_col)
    return pairs.join(inner.hint("merge"), i == F.col(inner_col)).drop("_inner")

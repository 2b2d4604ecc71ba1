"""Small dimension lookups: models, catalogs, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def model_catalog(raw: DataFrame) -> DataFrame:
    """(model, context) of JSON rows (model, context): entries without a positive context are skipped."""
    return raw.where(F.col("context") > 0).select(F.trim("model").alias("model"), F.col("context").cast("long").alias("context")).dropDuplicates(["model"])


def can(capabilities: Column, wanted: str) -> Column:
    """Chat and writing models stand for each other."""
    names = ["chat", "writing"] if wanted in ("chat", "writing") else [wanted]
    return F.arrays_overlap(capabilities, F.array(*[F.lit(n) for n in names]))


def resolve_model(models: DataFrame, slot: str, wanted: str, user: str = "user_id") -> DataFrame:
    """One model for each user: the default of the slot, else an old-style default, else the first that can do it.

    models: user, id, capabilities, default_for (array), is_default.
    """
    able = models.where(can(F.col("capabilities"), wanted))
    rank = F.when(F.array_contains("default_for", slot), 0).when(F.col("is_default"), 1).otherwise(2)
    nth = F.row_number().over(W.partitionBy(user).orderBy(rank, "id"))
    return able.withColumn("_n", nth).where("_n = 1").drop("_n")

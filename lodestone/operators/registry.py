"""A registry of frequent signatures, and entries rewritten to its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 3


def registry(df: DataFrame, signature: str, order: str, least: int = LEAST) -> DataFrame:
    """(key, signature, n): signatures that come ``least`` times or more, as m0, m1, ... by count, then first seen.

    Only the frequent ones are ranked; the counts are pre-aggregated.
    """
    counts = df.groupBy(signature).agg(F.count("*").alias("n"), F.min(order).alias("__first")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "__first")) - 1
    return counts.select(F.concat(F.lit("m"), rank).alias("key"), signature, "n")


def rewrite(df: DataFrame, known: DataFrame, signature: str) -> DataFrame:
    """``df`` with each signature replaced by its key, where it has one."""
    return df.join(known.select(signature, F.col("key").alias("__key")), signature, "left").withColumn(signature, F.coalesce("__key", signature)).drop("__key")

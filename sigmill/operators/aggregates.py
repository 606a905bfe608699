"""Aggregates by place in an order, and others that Spark has no function for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick_by_place(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key, the values at zero-based places of the sorted column; places may use ``n``, the count.

    Equal values are counted first, so a hot key costs its distinct values, which are then summed in order.
    """
    kinds = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    t = kinds.withColumns({"_upto": upto, "n": F.sum("_c").over(w)})
    hit = {k: F.max(F.when((F.col("_upto") - F.col("_c") <= p) & (p < F.col("_upto")), F.col(value))).alias(k) for k, p in places.items()}
    return t.groupBy(*keys).agg(F.max("n").alias("n"), *hit.values())


def index_p90(n: Column | str = "n") -> Column:
    """Place of the 90th percentile by index: whole part of 0.9 n."""
    return F.floor(F.col("n") * 9 / 10)


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of (2 i - n - 1) x over n times the sum of x, x in order and i from 1; 0 if all are 0.

    Equal values are counted first, so a hot key costs its distinct values; nulls count for nothing.
    """
    kinds = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    t = kinds.withColumns({"_before": F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c"), "_n": F.sum("_c").over(w)})
    total, x = F.sum(F.col(value) * F.col("_c")), F.col(value) * F.col("_c")
    return t.groupBy(*keys).agg(F.when(total > 0, F.sum((2 * F.col("_before") + F.col("_c") - F.col("_n")) * x) / (F.max("_n") * total)).otherwise(0.0).alias("gini"))


def calibration_bins(df: DataFrame, confidence: str, actual: str) -> DataFrame:
    """Ten equal bins of confidence, the last closed at 1: count, mean confidence, accuracy."""
    b = df.groupBy(F.least(F.floor(F.col(confidence) * 10), F.lit(9)).cast("int").alias("bin"))
    return b.agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(actual).cast("int")).alias("accuracy"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)

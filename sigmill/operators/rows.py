"""Row operators: latest rows, top-k, merges, filters with a fallback, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``by``, of the table or of each key; partial sums, no sort."""
    row = F.max_by(F.struct(*df.columns), F.col(by)).alias("r")
    return df.groupBy(*keys).agg(row).select("r.*")


def top_k(df: DataFrame, k: int, *order: Column, keys: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows in an order, of the table or of each key."""
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def page(df: DataFrame, offset: int, limit: int, *order: Column, most: int | None = None) -> DataFrame:
    """``limit`` rows behind ``offset`` in an order; a service that allows no more than ``most`` rows a page says so."""
    return df.orderBy(*order).offset(offset).limit(limit if most is None else min(limit, most))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, the first of each key, behind ``old``."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def update_by_key(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null values of ``changes`` replace those of matching rows."""
    new = changes.columns
    c = changes.withColumnsRenamed({x: f"_new_{x}" for x in new if x not in keys})
    out = df.join(c, list(keys), "left")
    return out.select(*[F.coalesce(f"_new_{x}", x).alias(x) if f"_new_{x}" in out.columns else F.col(x) for x in df.columns])


def with_history(df: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Versions of a row with the value before and whether it still holds."""
    w = W.partitionBy(key).orderBy(version)
    return df.withColumns({"old_value": F.lag(value).over(w), "version": F.row_number().over(w), "is_current": F.lead(version).over(w).isNull()})


def filter_or_all(df: DataFrame, keep: Column, keys: Sequence[str]) -> DataFrame:
    """Rows that pass; all rows of a key in which none does."""
    some = F.max(keep.cast("int")).over(W.partitionBy(*keys)) == 1
    return df.withColumn("_some", some).filter(keep | ~F.col("_some")).drop("_some")


def identity_lookup(df: DataFrame, of: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """``of`` replaced by what the mapping says, itself where it says nothing."""
    m = mapping.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    return df.join(m, F.col(of) == F.col("_s"), "left").withColumn(of, F.coalesce("_t", of)).drop("_s", "_t")

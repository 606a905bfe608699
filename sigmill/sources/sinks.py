"""Sinks: Parquet tables in the folder that the cluster shares, appended to. Tables with a key are in ``buckets``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the cluster names it; only a local session makes its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sigmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def append(df: DataFrame, path: str) -> DataFrame:
    """Adds the rows; what is there stays."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def violations(df: DataFrame, keys: Sequence[str], parents: DataFrame, on: str) -> DataFrame:
    """(rule, rows): rows beyond the first of a key, and rows without a parent, as a table with constraints would refuse them."""
    again = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit("unique").alias("rule"), "rows")
    orphans = df.join(parents.select(on).distinct(), on, "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("foreign key").alias("rule"), "rows")
    return again.unionByName(orphans)

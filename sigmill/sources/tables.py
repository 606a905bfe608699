"""Domain tables as projections of the given ones, in Spark and, for the checks, in SQL.

Amounts are carried as whole cents, so sums are exact in any order and any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for now() in every query.
AS_OF = "2024-01-31 00:00:00"

TITLES = [
    "Show HN: Fast-Grid 2.1, an open source table",
    "Ask HN: Who is hiring? (March 2024)",
    "How to migrate a database without downtime",
    "Looking for a better tool to test API clients",
    "My journey from manager to maker",
    "Unpopular opinion: monoliths are underrated",
    "Salary negotiation and burnout",
    "Ethics of surveillance in schools",
    "Launching Quillbase v1.4 for small teams",
    "Benchmark of Rust and Python runtimes",
    "Weekly Thread: what are you reading",
    "Too expensive: our vendor lock-in regret",
    "The queue library that is buggy and unreliable",
    "I built a note app in a weekend",
    "Kubernetes pipeline for machine learning",
    "Self-hosted alternative to cloud notes",
    "Struggling with slow queries in production",
    "AI Agents meet the API gateway",
    "Ask HN: Who is hiring? (April 2024)",
    "A calm walk in the hills",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, score, cents, comments, created_at, trend_id, title."""
    e = table(spark, sf_dir, "events")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("event_id") % len(TITLES) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source"),
        F.col("value").alias("score"),
        cents(F.col("value")).alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("comments"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("trend_id"),
        title.alias("title"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot items: a row for each trend and day, momentum between 0 and 1."""
    s = signals(spark, sf_dir)
    return s.groupBy("trend_id", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.least("cents", F.lit(10000))) / (F.count(F.lit(1)) * 10000)).alias("momentum"),
        F.max("cents").alias("top"),
        F.count_distinct("source").alias("n_sources"),
        F.count_if(F.col("source").isin("purchase", "signup")).alias("demand"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SIG = f"""sig as (select event_id as id, event_type as source, value as score, round(value * 100)::bigint as cents,
  json_extract_string(props, '$.k')::int as comments, ts as created_at, user_id as trend_id,
  [{", ".join(map(_quoted, TITLES))}][event_id % {len(TITLES)} + 1] as title from events)"""
_ITEMS = """items as (select trend_id, created_at::date as day, count(*) as n, sum(least(cents, 10000)) / (count(*) * 10000) as momentum,
  max(cents) as top, count(distinct source) as n_sources, count_if(source in ('purchase', 'signup')) as demand from sig group by 1, 2)"""


def sql(body: str, *ctes: str) -> str:
    """SQL over the projections: sig and items, then ``ctes``, then ``body``."""
    return "with " + ",\n".join([_SIG, _ITEMS, *ctes]) + "\n" + body

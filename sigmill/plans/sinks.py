"""Sinks that write: append, merge in batches, full replace; and a source behind a function with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import rows
from sigmill.registry import query
from sigmill.sources import buckets, sinks
from sigmill.sources.tables import AS_OF, signals, sql, table


@query("k01_append_insert", sql("select id, source, cents from sig"))
def k01(spark, d):
    s, path = signals(spark, d).select("id", "source", "cents"), sinks.new_path(spark, "appended")
    sinks.append(s.filter("id % 2 = 0"), path)
    return sinks.append(s.filter("id % 2 <> 0"), path)


@query("k04_batched_merge", sql("select id, case when id % 2 = 0 then cents + 2 else cents + id % 3 end as cents from sig"))
def k04(spark, d):
    s, path = signals(spark, d).select("id", "cents"), sinks.new_path(spark, "merged")
    out = buckets.replace(s.limit(0), path, ["id"])
    for k in range(3):
        out = buckets.merge(s.filter(f"id % 3 = {k} or id % 2 = 0").withColumn("cents", F.col("cents") + k), path)
    return out


@query("k05_full_replace", sql("select trend_id, count(*) as n, min(id) as canonical from sig group by trend_id"))
def k05(spark, d):
    path, t = sinks.new_path(spark, "replaced"), signals(spark, d).groupBy("trend_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("canonical"))
    buckets.replace(t.withColumn("n", F.col("n") + 1), path, ["trend_id"])
    return buckets.replace(t, path, ["trend_id"])


def signals_without_vectors(spark: SparkSession, sf_dir: str, lookback_days: int = 14, limit: int = 1000) -> DataFrame:
    """Newest signals of the last days that have no vector yet, ``limit`` at most: a source with parameters."""
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {lookback_days} DAYS")
    s = signals(spark, sf_dir).filter(F.col("created_at") >= since).select("id", "source", "created_at")
    s = s.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")
    return rows.top_k(s, limit, F.desc("created_at"), F.asc("id")).select("id", "source")


@query("s16_function_scan", sql(f"select id, source from sig where created_at >= timestamp '{AS_OF}' - interval 14 day and id not in (select vec_id from embeddings) order by created_at desc, id limit 1000"))
def s16(spark, d):
    return signals_without_vectors(spark, d)


@query("s01_scan_all_newest_first", sql("select id, source, cents, trend_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as at from sig"))
def s01(spark, d):
    s = signals(spark, d).orderBy(F.desc("created_at"), "id")
    return s.select("id", "source", "cents", "trend_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def started(spark, d, name: str, *columns: str):
    """Path of a new table that holds the signals of even ids."""
    path = sinks.new_path(spark, name)
    buckets.replace(signals(spark, d).select(*columns).filter("id % 2 = 0"), path, ["id"])
    return path


@query("k02_append_missing_written", sql("select id, source from sig"))
def k02(spark, d):
    path = started(spark, d, "k02", "id", "source")
    return buckets.append_missing(signals(spark, d).select("id", "source"), path)


@query("k03_merge_written", sql("select id, case when id % 2 = 0 and id % 5 > 0 then cents else cents + 1 end as cents from sig"))
def k03(spark, d):
    path = started(spark, d, "k03", "id", "cents")
    new = signals(spark, d).filter("id % 2 = 1 or id % 5 = 0").select("id", (F.col("cents") + 1).alias("cents"))
    return buckets.merge(new, path)


@query("k06_update_written", sql("select id, source, case when source = 'error' then 0 else cents end as cents from sig"))
def k06(spark, d):
    s, path = signals(spark, d).select("id", "source", "cents"), sinks.new_path(spark, "k06")
    buckets.replace(s, path, ["id"])
    return buckets.update(s.filter("source = 'error'").select("id", F.lit(0).cast("long").alias("cents")), path)


@query("k07_delete_written", sql("select id, source, comments from sig where not (source = 'error' and comments < 50)"))
def k07(spark, d):
    path = sinks.new_path(spark, "k07")
    buckets.replace(signals(spark, d).select("id", "source", "comments"), path, ["id"])
    return buckets.delete(spark, path, (F.col("source") == "error") & (F.col("comments") < 50))


@query("k09_history_written", sql("select id, cents as old_cents, cents + 1 as new_cents, 1 as version from sig where source = 'purchase'"))
def k09(spark, d):
    """What a merge is about to change goes to a history table first."""
    s, path = signals(spark, d).select("id", "source", "cents"), sinks.new_path(spark, "k09")
    old = buckets.replace(s, path, ["id"])
    new = s.filter("source = 'purchase'").withColumn("cents", F.col("cents") + 1)
    both = old.select("id", F.col("cents").alias("old_cents")).join(new.select("id", F.col("cents").alias("new_cents")), "id")
    past = sinks.append(both.withColumn("version", F.lit(1)), f"{path}-history")
    buckets.merge(new, path)
    return past


@query("k10_run_log_written", sql("select source as stage, count(*) as rows_seen, 'done' as status from sig group by source"))
def k10(spark, d):
    """A row for each stage, running and then done; the log keeps the last."""
    path, t = sinks.new_path(spark, "k10"), signals(spark, d).groupBy(F.col("source").alias("stage")).agg(F.count(F.lit(1)).alias("rows_seen"))
    buckets.replace(t.select("stage", F.lit(0).cast("long").alias("rows_seen"), F.lit("running").alias("status")), path, ["stage"], 4)
    return buckets.merge(t.withColumn("status", F.lit("done")), path)


@query("k11_gate_log_written", sql("select trend_id, k as place, name as gate from (select trend_id, count(*) as n, count(distinct source) as s from sig group by 1), (select * from (values (0, 'signals'), (1, 'sources')) v(k, name)) where k = 0 or n >= 2"))
def k11(spark, d):
    """Gate decisions appended gate by gate; the second is asked where the first is passed."""
    path, t = sinks.new_path(spark, "k11"), signals(spark, d).groupBy("trend_id").agg(F.count(F.lit(1)).alias("n"))
    sinks.append(t.select("trend_id", F.lit(0).alias("place"), F.lit("signals").alias("gate")), path)
    return sinks.append(t.filter("n >= 2").select("trend_id", F.lit(1).alias("place"), F.lit("sources").alias("gate")), path)


@query("k12_integrity_violations", """select 'unique' as rule, (select coalesce(sum(n - 1), 0) from (select count(*) as n from lineitem group by l_orderkey, l_suppkey))::bigint as rows union all
  select 'foreign key', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def k12(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return sinks.violations(li, ["o_orderkey", "l_suppkey"], table(spark, d, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey")

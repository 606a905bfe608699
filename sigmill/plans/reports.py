"""Reports, health checks, briefs and dashboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import rows
from sigmill.operators import windows as O
from sigmill.plans.aggregates import PRED, predictions
from sigmill.plans.windows import LIFE, D
from sigmill.registry import query
from sigmill.sources.tables import items, signals, sql, table


def N():  # noqa: N802
    """Count of the rows of a group."""
    return F.count(F.lit(1))



@query("a29_trust_report", sql("""select count(*) as trends, count_if(d >= 2) as persistent, count_if(d >= 2 and p > 0) as qualified, round(count_if(d >= 2 and p > 0) / count(*), 6) as rate,
  sum(saved)::bigint as saved, sum(dropped)::bigint as dropped from (select trend_id, count(distinct created_at::date) as d, count_if(source = 'purchase') as p, count_if(source = 'signup') as saved, count_if(source = 'error') as dropped from sig group by trend_id)"""))
def a29(spark, d):
    of = lambda s: F.count_if(F.col("source") == s)
    t = signals(spark, d).groupBy("trend_id").agg(F.count_distinct(F.to_date("created_at")).alias("d"), of("purchase").alias("p"), of("signup").alias("saved"), of("error").alias("dropped"))
    t = t.withColumn("q", (F.col("d") >= 2) & (F.col("p") > 0))
    return t.agg(N().alias("trends"), F.count_if(F.col("d") >= 2).alias("persistent"), F.count_if(F.col("q")).alias("qualified"), F.round(F.count_if(F.col("q")) / N(), 6).alias("rate"), F.sum("saved").alias("saved"), F.sum("dropped").alias("dropped"))


@query("k10_run_log", sql("select day::varchar as day, '{\"signals\":' || sum(n)::bigint || ',\"trends\":' || count(*) || '}' as report from items group by items.day"))
def k10(spark, d):
    t = items(spark, d).groupBy("day").agg(F.sum("n").alias("signals"), N().alias("trends"))
    return t.select(D(), F.to_json(F.struct("signals", "trends")).alias("report"))


@query("d37_health_checks", sql("""select unnest(['has_signals', 'has_trends', 'momentum_positive', 'demand_share']) as check_name, unnest([s > 0, t > 0, m > 0, dm >= 0.1]) as ok from
  (select sum(n) as s, count(distinct trend_id) as t, max(momentum) as m, sum(demand) / sum(n) as dm from items)"""))
def d37(spark, d):
    t = items(spark, d).agg(F.sum("n").alias("s"), F.count_distinct("trend_id").alias("t"), F.max("momentum").alias("m"), (F.sum("demand") / F.sum("n")).alias("dm"))
    checks = {"has_signals": F.col("s") > 0, "has_trends": F.col("t") > 0, "momentum_positive": F.col("m") > 0, "demand_share": F.col("dm") >= 0.1}
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("ok")) for k, v in checks.items()])).alias("c")).select("c.*")


UNSURE = "list_filter([case when n < 3 then 'few_signals' end, case when n_sources < 2 then 'one_source' end, case when demand = 0 then 'no_demand' end, case when momentum < 0.3 then 'weak' end], lambda x: x is not null)"


@query("d39_uncertainty_factors", sql(f"select trend_id, day::varchar as day, array_to_string({UNSURE}, ',') as factors, len({UNSURE})::int as n_factors from items"))
def d39(spark, d):
    f = F.array_compact(F.array(F.when(F.col("n") < 3, "few_signals"), F.when(F.col("n_sources") < 2, "one_source"), F.when(F.col("demand") == 0, "no_demand"), F.when(F.col("momentum") < 0.3, "weak")))
    return items(spark, d).select("trend_id", D(), F.array_join(f, ",").alias("factors"), F.size(f).alias("n_factors"))


@query("d40_brief_completeness", sql("""select trend_id, (has_demand::int + has_volume::int + has_sources::int + has_top::int) / 4 as completeness, case when (has_demand::int + has_volume::int + has_sources::int + has_top::int) / 4 < 0.5 then 'draft' else 'ready' end as status
  from (select trend_id, sum(demand) > 0 as has_demand, sum(n) >= 10 as has_volume, max(n_sources) >= 3 as has_sources, max(top) >= 10000 as has_top from items group by trend_id)"""))
def d40(spark, d):
    t = items(spark, d).groupBy("trend_id").agg(F.array(F.sum("demand") > 0, F.sum("n") >= 10, F.max("n_sources") >= 3, F.max("top") >= 10000).alias("has"))
    c = F.size(F.filter("has", lambda x: x)) / 4
    return t.select("trend_id", c.alias("completeness"), F.when(c < 0.5, "draft").otherwise("ready").alias("status"))


@query("d42_watch_list_reasons", sql("""select trend_id, day::varchar as day, array_to_string(list_filter([case when momentum < 0.3 then 'momentum ' || floor(momentum * 100)::int || ' of 30' end, case when demand = 0 then 'no demand' end], lambda x: x is not null), '; ') as reasons from items where momentum < 0.3 or demand = 0"""))
def d42(spark, d):
    r = F.array_compact(F.array(F.when(F.col("momentum") < 0.3, F.format_string("momentum %d of 30", F.floor(F.col("momentum") * 100))), F.when(F.col("demand") == 0, "no demand")))
    return items(spark, d).filter("momentum < 0.3 or demand = 0").select("trend_id", D(), F.array_join(r, "; ").alias("reasons"))


@query("d51_alert_inbox", sql("select trend_id, id, count_if(id % 3 <> 0) over (partition by trend_id) as unseen from sig where source <> 'view' qualify row_number() over (partition by trend_id order by created_at desc, id desc) <= 50"))
def d51(spark, d):
    s = signals(spark, d).filter("source <> 'view'").withColumn("unseen", F.count_if(F.col("id") % 3 != 0).over(W.partitionBy("trend_id")))
    return rows.top_k(s, 50, F.desc("created_at"), F.desc("id"), keys=["trend_id"]).select("trend_id", "id", "unseen")


@query("d52_calibration_report", f"with {PRED} select count(*) as n, count_if(actual) as hits, round(avg((c - actual::int) ** 2), 6) as brier, count(distinct least(floor(c * 10), 9)) as bins from pred")
def d52(spark, d):
    c = F.col("c")
    return predictions(spark, d).agg(N().alias("n"), F.count_if(F.col("actual")).alias("hits"), F.round(F.avg(F.pow(c - F.col("actual").cast("int"), 2)), 6).alias("brier"), F.count_distinct(F.least(F.floor(c * 10), F.lit(9))).alias("bins"))


@query("d55_explore_list", sql("""select l.trend_id, l.momentum, l.stage, s.sources from (select * from life qualify row_number() over (partition by trend_id order by day desc) = 1) l left join (select trend_id, count(distinct source) as sources from sig group by trend_id) s using (trend_id)
  where l.stage <> 'stable' order by l.momentum desc, l.trend_id limit 100""", LIFE))
def d55(spark, d):
    last = rows.latest(O.lifecycle(items(spark, d)).select("trend_id", "day", "momentum", "stage"), "day", ["trend_id"])
    k = signals(spark, d).groupBy("trend_id").agg(F.count_distinct("source").alias("sources"))
    t = last.filter("stage <> 'stable'").join(k, "trend_id", "left").select("trend_id", "momentum", "stage", "sources")
    return rows.top_k(t, 100, F.desc("momentum"), F.asc("trend_id"))


@query("d56_overview", sql("select stage, count(*) as trends, max(momentum) as best from (select * from life qualify row_number() over (partition by trend_id order by day desc) = 1) group by stage", LIFE))
def d56(spark, d):
    last = rows.latest(O.lifecycle(items(spark, d)).select("trend_id", "day", "momentum", "stage"), "day", ["trend_id"])
    return last.groupBy("stage").agg(N().alias("trends"), F.max("momentum").alias("best"))


@query("d58_signals_by_source", sql("select trend_id, source, count(*) as n, min(id) as first_id from sig group by 1, 2"))
def d58(spark, d):
    return signals(spark, d).groupBy("trend_id", "source").agg(N().alias("n"), F.min("id").alias("first_id"))


@query("d60_chat_context", "select conv_id, length(string_agg(role || ': ' || text, chr(10) order by turn)) as n_chars, arg_max(role, turn) as last_role from conversations where turn < 20 group by conv_id")
def d60(spark, d):
    t = table(spark, d, "conversations").filter("turn < 20").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("x")))).alias("a"), F.max_by("role", "turn").alias("last_role"))
    return t.select("conv_id", F.length(F.array_join(F.transform("a", lambda s: s["x"]), "\n")).cast("long").alias("n_chars"), "last_role")


@query("d61_snapshot_or_latest", sql("select t.trend_id, coalesce(c.n, l.n) as n, c.n is not null as current from (select distinct trend_id from items) t left join items c on c.trend_id = t.trend_id and c.day = date '2024-01-30' left join (select trend_id, arg_max(n, day) as n from items group by trend_id) l on l.trend_id = t.trend_id"))
def d61(spark, d):
    here = F.max(F.when(F.col("day") == F.lit("2024-01-30").cast("date"), F.col("n")))
    t = items(spark, d).groupBy("trend_id").agg(here.alias("c"), F.max_by("n", "day").alias("l"))
    return t.select("trend_id", F.coalesce("c", "l").alias("n"), F.col("c").isNotNull().alias("current"))


@query("d65_quotes", sql("select trend_id, string_agg(title, ' | ' order by cents desc, id) as quotes from (select * from sig qualify row_number() over (partition by trend_id order by cents desc, id) <= 5) group by trend_id"))
def d65(spark, d):
    t = rows.top_k(signals(spark, d), 5, F.desc("cents"), F.asc("id"), keys=["trend_id"]).groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cents")).alias("c"), "id", "title"))).alias("a"))
    return t.select("trend_id", F.array_join(F.transform("a", lambda s: s["title"]), " | ").alias("quotes"))

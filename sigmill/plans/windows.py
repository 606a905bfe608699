"""Window and sequence queries over the snapshots of each trend."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import windows as O
from sigmill.registry import query
from sigmill.sources.tables import items, signals, sql, table


def D():  # noqa: N802
    """The snapshot's day as text."""
    return F.col("day").cast("string").alias("day")


WT = "window w as (partition by trend_id order by day)"
V = "v as (select *, momentum - lag(momentum) over w as v from items window w as (partition by trend_id order by day))"
END = "e as (select *, row_number() over (partition by trend_id order by day desc) as k, count(*) over (partition by trend_id) as total from items)"


def three(x: str) -> str:
    return f"three_{x} as (select trend_id, max({x}) filter (k = 3) as r0, max({x}) filter (k = 2) as r1, max({x}) filter (k = 1) as r2 from e where total >= 3 group by trend_id)"


SLOPE = "sl as (select trend_id, case when count(*) >= 3 then regr_slope(momentum, i) when count(*) = 2 then max(v) else 0 end as slope from (select *, row_number() over (partition by trend_id order by day) as i from v) group by trend_id)"
TURN = f"turn as (select trend_id, min(day) as day from (select *, lag(v) over w as b, lead(v) over w as x from v {WT}) where b <= 0 and v > 0.02 and x > 0 group by trend_id)"
BREAK = "br as (select trend_id, max(momentum) filter (k = 1) as now, max(momentum) filter (k = 1) > median(momentum) filter (k > 3) + 1.5 * greatest(coalesce(stddev_samp(momentum) filter (k > 3), 0), 0.05) and max(momentum) filter (k = 1) > 0.5 as breakout from e where total >= 5 group by trend_id)"
LIFE = f"""l0 as (select *, lag(momentum) over w as pm, lag(n) over w as pn, row_number() over w as seen from items {WT}),
l1 as (select *, coalesce(pm >= 0.01, false) as comparable, case when pm >= 0.01 then (momentum - pm) / pm * 100 end as p, n - pn as ds, case when seen < 2 then 0.6 when seen < 3 then 0.7 else 1.0 end as ceil from l0),
life as (select *, case when pm is null then 'emerging' when not comparable then 'stable' when momentum >= 0.5 and abs(p) <= 10 then 'peaking' when p > 20 and momentum >= 0.3 then 'rising'
  when p < -20 and momentum >= 0.3 then 'declining' when momentum < 0.3 and p < -10 then 'fading' when momentum < 0.3 and p > 10 then 'emerging' else 'stable' end as stage,
  case when pm is null then least(0.9, ceil) when not comparable then 0.5 when momentum >= 0.5 and abs(p) <= 10 then least(0.76, ceil) when p > 20 and momentum >= 0.3 then least(0.76, ceil)
  when p < -20 and momentum >= 0.3 then least(0.72, ceil) when momentum < 0.3 and p < -10 then least(case when ds < 0 then 0.72 else 0.56 end, ceil)
  when momentum < 0.3 and p > 10 then least(case when ds > 0 then 0.68 else 0.48 end, ceil) else least(0.56, ceil) end::double as conf from l1)"""
TIMING = f"""ti as (select trend_id, count(*) as points, arg_max(momentum, day) as m, arg_max(n, day) as n, arg_max(stage, day) as stage, max(day) - min(day) as span from life group by trend_id),
tj as (select ti.*, slope, turn.day is not null as turned, coalesce(breakout, false) as breakout, coalesce(a.r0 > a.r1 and a.r1 > a.r2 and a.r0 - a.r2 > 0.15 * greatest(a.r0, 1), false) as thinner,
  coalesce(b.r0 < b.r1 and b.r1 < b.r2, false) as more from ti join sl using (trend_id) left join turn using (trend_id) left join br using (trend_id) left join three_top a using (trend_id) left join three_n b using (trend_id)),
timing as (select *, case when span + 1 < 2 or points < 3 then 'timing_uncertain' when m < 0.3 and stage = 'emerging' and slope <= 0 then 'too_early' when thinner then 'crowded' when n > 20 and slope < 0 then 'crowded'
  when m >= 0.3 and slope > 0 and (breakout or turned) then 'early_edge' when m >= 0.3 and slope > 0 and stage in ('emerging', 'rising') and more then 'early_edge'
  when stage in ('peaking', 'declining', 'stable') and m >= 0.4 and slope >= -0.05 then 'late_but_monetizable' when m >= 0.7 and slope >= 0 then 'early_edge' when m >= 0.3 and slope > 0 and more then 'early_edge' else 'too_early' end as label from tj)"""
ALL = (V, END, three("n"), three("top"), SLOPE, TURN, BREAK, LIFE, TIMING)


@query("w01_previous_state", sql(f"select trend_id, day::varchar as day, lag(momentum) over w as prev_momentum, lag(n) over w as prev_n, day - lag(day) over w as gap from items {WT}"))
def w01(spark, d):
    w = O.by()
    return items(spark, d).select("trend_id", D(), F.lag("momentum").over(w).alias("prev_momentum"), F.lag("n").over(w).alias("prev_n"), F.date_diff("day", F.lag("day").over(w)).cast("long").alias("gap"))


@query("w02_running_count", sql(f"select trend_id, day::varchar as day, row_number() over w as snapshots_seen from items {WT}"))
def w02(spark, d):
    return items(spark, d).select("trend_id", D(), F.row_number().over(O.by()).cast("long").alias("snapshots_seen"))


DAYS_SEEN = sql("""select id, trend_id, sum(new) over (partition by trend_id order by created_at, id rows unbounded preceding)::bigint as days_seen from
  (select id, trend_id, created_at, (lag(created_at::date) over (partition by trend_id order by created_at, id) is distinct from created_at::date)::int as new from sig)""")


@query("w03_running_distinct", DAYS_SEEN)
@query("w03_running_distinct_all", DAYS_SEEN)
def w03(spark, d):
    w = W.partitionBy("trend_id").orderBy("created_at", "id")
    day = F.to_date("created_at")
    s = signals(spark, d).withColumn("new", (~F.lag(day).over(w).eqNullSafe(day)).cast("int"))
    return s.select("id", "trend_id", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("days_seen"))


@query("w04_running_first_last", sql(f"select trend_id, day::varchar as day, min(day) over w::varchar as first_seen, max(n) over w as most from items {WT}"))
def w04(spark, d):
    w = O.by().rowsBetween(W.unboundedPreceding, 0)
    return items(spark, d).select("trend_id", D(), F.min("day").over(w).cast("string").alias("first_seen"), F.max("n").over(w).alias("most"))


@query("w05_velocity", sql("select trend_id, day::varchar as day, v from v", V))
def w05(spark, d):
    return items(spark, d).select("trend_id", D(), O.velocity().alias("v"))


@query("w06_inflection", sql("select trend_id, day::varchar as day from turn", V, TURN))
def w06(spark, d):
    return O.first_inflections(items(spark, d)).select("trend_id", D())


@query("w07_breakout", sql("select trend_id, now, breakout from br", END, BREAK))
def w07(spark, d):
    return O.breakouts(items(spark, d))


@query("w08_demand_breakout", sql("select trend_id, r0 < r1 and r1 < r2 and (r2 - r0) / greatest(r0, 1) > 0.3 as breakout from three_n", END, three("n")))
def w08(spark, d):
    r = O.last_three(items(spark, d), "n")
    return r.select("trend_id", ((F.col("r0") < F.col("r1")) & (F.col("r1") < F.col("r2")) & ((F.col("r2") - F.col("r0")) / F.greatest("r0", F.lit(1)) > 0.3)).alias("breakout"))


@query("w09_top_decline", sql("select trend_id, r0 > r1 and r1 > r2 and r0 - r2 > 0.15 * greatest(r0, 1) as crowding from three_top", END, three("top")))
def w09(spark, d):
    r = O.last_three(items(spark, d), "top")
    return r.select("trend_id", ((F.col("r0") > F.col("r1")) & (F.col("r1") > F.col("r2")) & (F.col("r0") - F.col("r2") > 0.15 * F.greatest("r0", F.lit(1)))).alias("crowding"))


@query("w10_ols_slope", sql("select trend_id, round(slope, 8) as slope from sl", V, SLOPE))
def w10(spark, d):
    return O.slopes(items(spark, d)).select("trend_id", F.round("slope", 8).alias("slope"))


@query("w11_signal_trend", sql("select trend_id, case when r0 < r1 and r1 < r2 then 'rising' when r0 > r1 and r1 > r2 then 'falling' else 'stable' end as trend from three_n", END, three("n")))
def w11(spark, d):
    r = O.last_three(items(spark, d), "n")
    up, down = (F.col("r0") < F.col("r1")) & (F.col("r1") < F.col("r2")), (F.col("r0") > F.col("r1")) & (F.col("r1") > F.col("r2"))
    return r.select("trend_id", F.when(up, "rising").when(down, "falling").otherwise("stable").alias("trend"))


@query("w12_first_of_day", sql("select trend_id, id from sig qualify row_number() over (partition by trend_id, created_at::date order by created_at, id) = 1"))
def w12(spark, d):
    return signals(spark, d).groupBy("trend_id", F.to_date("created_at").alias("day")).agg(F.min_by("id", F.struct("created_at", "id")).alias("id")).select("trend_id", "id")


@query("w13_peak", sql("select trend_id, max(momentum) as peak, min(day) filter (momentum = m)::varchar as peak_day from (select *, max(momentum) over (partition by trend_id) as m from items) group by trend_id"))
def w13(spark, d):
    return items(spark, d).groupBy("trend_id").agg(F.max("momentum").alias("peak"), F.min_by("day", F.struct(-F.col("momentum"), "day")).cast("string").alias("peak_day"))


@query("w14_last_non_null", sql("select trend_id, arg_max(n, day) filter (demand > 0) as last_demand_n from items group by trend_id"))
def w14(spark, d):
    return items(spark, d).groupBy("trend_id").agg(F.max_by("n", F.when(F.col("demand") > 0, F.col("day"))).alias("last_demand_n"))


@query("w15_change_points", sql(f"select trend_id, day::varchar as day, stage from (select trend_id, day, stage, lag(stage) over w as p from life {WT}) where p is null or p <> stage", LIFE))
def w15(spark, d):
    return O.changes(O.lifecycle(items(spark, d)), "stage").select("trend_id", D(), "stage")


@query("w16_week_over_week", sql("""select trend_id, day::varchar as day, case when p > 0 then (n - p) / p end as growth from (select a.trend_id, a.day, a.n, (select arg_min(b.n, abs(b.day - (a.day - 7)) * 100 + (b.day - date '2024-01-01')) from items b
  where b.trend_id = a.trend_id and abs(b.day - (a.day - 7)) < 5) as p from items a)"""))
def w16(spark, d):
    from sigmill.operators.joins import nearest_in_time

    t = nearest_in_time(items(spark, d).select("trend_id", "day", "n"), "trend_id", "day", "n", 7, 5)
    return t.select("trend_id", D(), F.when(F.col("near_7") > 0, (F.col("n") - F.col("near_7")) / F.col("near_7")).alias("growth"))


@query("w17_last_n_per_group", sql("select trend_id, day::varchar as day, n from e where k <= 14", END))
def w17(spark, d):
    return items(spark, d).withColumn("k", O.from_end()).filter("k <= 14").select("trend_id", D(), "n")


@query("w18_rank", "select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as place from customer")
def w18(spark, d):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("w19_running_novelty", sql("""select id, case when title like 'Ask HN%' or title like 'Weekly%' then case when rn = 1 then 0.5 else least(0.1, greatest(0.05, 1 / (1.5 * rn))) end else 1.0 end::double as novelty
  from (select id, title, row_number() over (partition by source, title order by created_at desc, id) as rn from sig)"""))
def w19(spark, d):
    rn = F.row_number().over(W.partitionBy("source", "title").orderBy(F.desc("created_at"), "id"))
    known = F.col("title").like("Ask HN%") | F.col("title").like("Weekly%")
    s = signals(spark, d).withColumn("rn", rn)
    return s.select("id", F.when(known, F.when(F.col("rn") == 1, 0.5).otherwise(F.least(F.lit(0.1), F.greatest(F.lit(0.05), 1 / (1.5 * F.col("rn")))))).otherwise(1.0).alias("novelty"))


@query("w20_transitions", sql(f"select trend_id, day::varchar as day, p as old_stage, stage as new_stage from (select trend_id, day, stage, lag(stage) over w as p from life {WT}) where p <> stage", LIFE))
def w20(spark, d):
    t = O.lifecycle(items(spark, d)).withColumn("p", F.lag("stage").over(O.by())).filter("p <> stage")
    return t.select("trend_id", D(), F.col("p").alias("old_stage"), F.col("stage").alias("new_stage"))


@query("w21_divergence", sql("""select a.trend_id, ((a.r2 - a.r0) / greatest(a.r0, 1) + case when b.r0 > b.r1 and b.r1 > b.r2 then (b.r0 - b.r2) / greatest(b.r0, 1) else 0 end) / 2 as divergence
  from three_n a join three_top b using (trend_id)""", END, three("n"), three("top")))
def w21(spark, d):
    i = items(spark, d)
    a = O.last_three(i, "n").select("trend_id", ((F.col("r2") - F.col("r0")) / F.greatest("r0", F.lit(1))).alias("more"))
    falling = (F.col("r0") > F.col("r1")) & (F.col("r1") > F.col("r2"))
    b = O.last_three(i, "top").select("trend_id", F.when(falling, (F.col("r0") - F.col("r2")) / F.greatest("r0", F.lit(1))).otherwise(0.0).alias("less"))
    return a.join(b, "trend_id").select("trend_id", ((F.col("more") + F.col("less")) / 2).alias("divergence"))


@query("w22_snapshot_drift", sql("""select day::varchar as day, metric, drift, case when drift > bar * 1.5 then 'high' when drift > bar then 'medium' else 'none' end as severity from (
  select day, unnest(['signals', 'trends']) as metric, unnest([abs(s - ps) / ps, abs(t - pt) / pt]) as drift, unnest([0.3, 0.5]) as bar from (
  select day, s, t, lag(s) over (order by day) as ps, lag(t) over (order by day) as pt from (select day, sum(n)::bigint as s, count(*) as t from items group by day)) where ps is not null)"""))
def w22(spark, d):
    s = items(spark, d).groupBy("day").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("t"))
    w = W.orderBy("day")
    s = s.withColumns({"ps": F.lag("s").over(w), "pt": F.lag("t").over(w)}).filter("ps is not null")
    one = lambda m, a, b, bar: F.struct(F.lit(m).alias("metric"), (F.abs(F.col(a) - F.col(b)) / F.col(b)).alias("drift"), F.lit(bar).alias("bar"))
    s = s.select("day", F.explode(F.array(one("signals", "s", "ps", 0.3), one("trends", "t", "pt", 0.5))).alias("m")).select("day", "m.*")
    return s.select(D(), "metric", "drift", F.when(F.col("drift") > F.col("bar") * 1.5, "high").when(F.col("drift") > F.col("bar"), "medium").otherwise("none").alias("severity"))


@query("w23_day_velocity", sql("""select trend_id, case when b = 0 then least(0.6, a / 30) else (a - b) / b end as velocity from (select trend_id, count_if(created_at >= timestamp '2024-01-30') as a,
  count_if(created_at >= timestamp '2024-01-29' and created_at < timestamp '2024-01-30') as b from sig group by trend_id)"""))
def w23(spark, d):
    on = lambda x: F.to_date("created_at") == F.lit(x).cast("date")
    t = signals(spark, d).groupBy("trend_id").agg(F.count_if(F.to_date("created_at") >= F.lit("2024-01-30").cast("date")).alias("a"), F.count_if(on("2024-01-29")).alias("b"))
    return t.select("trend_id", F.when(F.col("b") == 0, F.least(F.lit(0.6), F.col("a") / 30)).otherwise((F.col("a") - F.col("b")) / F.col("b")).alias("velocity"))


@query("w24_failure_streaks", sql("""select id, streak, case when streak = 0 then 'healthy' when streak = 1 then 'degraded' else 'failed' end as health from (select id, sum(f) over (partition by trend_id, island order by created_at, id rows unbounded preceding)::bigint as streak
  from (select *, (source = 'error')::int as f, sum((source <> 'error')::int) over (partition by trend_id order by created_at, id rows unbounded preceding) as island from sig))"""))
def w24(spark, d):
    s = signals(spark, d).withColumn("at", F.struct("created_at", "id"))
    s = O.failure_streaks(s, "trend_id", "at", F.col("source") == "error")
    return s.select("id", "streak", F.when(F.col("streak") == 0, "healthy").when(F.col("streak") == 1, "degraded").otherwise("failed").alias("health"))


@query("d08_lifecycle_stage", sql("select trend_id, day::varchar as day, stage, conf as stage_confidence from life", LIFE))
def d08(spark, d):
    return O.lifecycle(items(spark, d)).select("trend_id", D(), "stage", "stage_confidence")


@query("d09_lifecycle_history", sql("""select trend_id, day::varchar as day, stage, comparable, p as change, case when p is not null then round(0.7 * greatest(-1, least(1, p / 100)) + 0.3 * greatest(-1, least(1, ds / 10)), 6) end as acceleration, seen as snapshots_seen from life""", LIFE))
def d09(spark, d):
    clamp = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    t = O.lifecycle(items(spark, d))
    a = F.when(F.col("change").isNotNull(), 0.7 * clamp(F.col("change") / 100) + 0.3 * clamp((F.col("n") - F.col("prev_n")) / 10))
    return t.select("trend_id", D(), "stage", "comparable", "change", F.round(a, 6).alias("acceleration"), F.col("snapshots_seen").cast("long").alias("snapshots_seen"))


@query("d15_timing_label", sql("select trend_id, label, points, round(slope, 8) as slope from timing", *ALL))
def d15(spark, d):
    return O.timing(O.lifecycle(items(spark, d))).select("trend_id", "label", "points", F.round("slope", 8).alias("slope"))


@query("d16_expiry_risk", sql("select trend_id, case when stage in ('declining', 'fading') and slope < -0.03 then 'high' when stage in ('declining', 'fading') then 'medium' when stage = 'peaking' and slope < 0 then 'medium' when thinner then 'medium' when slope < -0.05 then 'high' else 'low' end as risk from timing", *ALL))
def d16(spark, d):
    t = O.timing(O.lifecycle(items(spark, d)))
    down, s = F.col("stage").isin("declining", "fading"), F.col("slope")
    risk = F.when(down & (s < -0.03), "high").when(down, "medium").when((F.col("stage") == "peaking") & (s < 0), "medium").when(F.col("thinner"), "medium").when(s < -0.05, "high").otherwise("low")
    return t.select("trend_id", risk.alias("risk"))


@query("d38_trajectory_summary", sql("select trend_id, count(*) as points, max(momentum) as peak, arg_max(stage, day) as stage, sum(n)::bigint as signals, min(day)::varchar as first_seen from life group by trend_id", LIFE))
def d38(spark, d):
    return O.lifecycle(items(spark, d)).groupBy("trend_id").agg(F.count(F.lit(1)).alias("points"), F.max("momentum").alias("peak"), F.max_by("stage", "day").alias("stage"), F.sum("n").alias("signals"), F.min("day").cast("string").alias("first_seen"))

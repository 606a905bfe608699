"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import aggregates as A
from sigmill.registry import query
from sigmill.sources.tables import items, signals, sql, table


def N():  # noqa: N802
    """Count of the rows of a group."""
    return F.count(F.lit(1))

#: Predictions: confidence in thousandths from a document's length, outcome from its label.
PRED = "pred as (select d.doc_id, (d.n_chars % 1001) / 1000.0::double as c, l.quality = 1 as actual from documents d join labels l using (doc_id))"


def predictions(spark, d):
    doc = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 1001 / F.lit(1000.0)).alias("c"))
    return doc.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("actual")), "doc_id")


@query("a01_group_count", sql("select source, title, count(*) as n from sig group by 1, 2"))
def a01(spark, d):
    return signals(spark, d).groupBy("source", "title").agg(N().alias("n"))


@query("a02_exploded_histogram", "select word, count(*) as n from (select unnest(string_split(lower(p_name), ' ')) as word from part) group by word")
def a02(spark, d):
    return table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(N().alias("n"))


@query("a03_conditional_counts", sql("select source, count_if(comments > 50) as passed, count_if(comments <= 50) as failed, count(*) as total, count_if(comments > 50) / count(*) as pass_rate from sig group by source"))
def a03(spark, d):
    ok = F.count_if(F.col("comments") > 50)
    return signals(spark, d).groupBy("source").agg(ok.alias("passed"), F.count_if(F.col("comments") <= 50).alias("failed"), N().alias("total"), (ok / N()).alias("pass_rate"))


@query("a04_moments", sql("select day::varchar as day, sum(n)::bigint as total, min(n) as least, max(n) as most, round(stddev_pop(n), 6) as std, sum(n) / count(*) as mean from items group by items.day"))
def a04(spark, d):
    return items(spark, d).groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.stddev_pop("n"), 6).alias("std"), (F.sum("n") / N()).alias("mean"))


@query("a05_sample_std", sql("select trend_id, round(coalesce(stddev_samp(n), 0), 6) as std from items group by trend_id"))
def a05(spark, d):
    return items(spark, d).groupBy("trend_id").agg(F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("std"))


@query("a06_stability", sql("""select trend_id, day::varchar as day, round(s, 6) as stability, case when s >= 0.8 then 'stable' when s >= 0.5 then 'rising' else 'volatile' end as label from
  (select trend_id, day, case when count(*) over w < 2 or avg(n) over w <= 0 then 1.0 else greatest(0, least(1, 1 - stddev_samp(n) over w / avg(n) over w)) end as s from items
   window w as (partition by trend_id order by day rows 3 preceding))"""))
def a06(spark, d):
    w = W.partitionBy("trend_id").orderBy("day").rowsBetween(-3, 0)
    cv = 1 - F.stddev_samp("n").over(w) / F.avg("n").over(w)
    s = F.when((F.count("n").over(w) < 2) | (F.avg("n").over(w) <= 0), 1.0).otherwise(F.greatest(F.lit(0), F.least(F.lit(1), cv)))
    t = items(spark, d).select("trend_id", F.col("day").cast("string").alias("day"), s.alias("s"))
    return t.select("trend_id", "day", F.round("s", 6).alias("stability"), F.when(F.col("s") >= 0.8, "stable").when(F.col("s") >= 0.5, "rising").otherwise("volatile").alias("label"))


@query("a07_index_p90", sql("select source, greatest(list_sort(list(cents))[(count(*) * 9) // 10 + 1], 100) as p90 from sig group by source"))
def a07(spark, d):
    p = A.pick_by_place(signals(spark, d), ["source"], "cents", {"p90": A.index_p90()})
    return p.select("source", F.greatest("p90", F.lit(100)).alias("p90"))


@query("a08_upper_median", sql("select source, list_sort(list(comments))[count(*) // 2 + 1] as median from sig group by source"))
def a08(spark, d):
    return A.pick_by_place(signals(spark, d), ["source"], "comments", {"median": F.floor(F.col("n") / 2)}).select("source", "median")


@query("a09_true_median", sql("select trend_id, median(comments)::double as median from sig group by trend_id"))
def a09(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.median("comments").alias("median"))


@query("a10_index_quartiles", sql("select trend_id, case when count(*) >= 4 then list_sort(list(comments))[count(*) // 4 + 1] else min(comments) end as q1, case when count(*) >= 4 then list_sort(list(comments))[3 * count(*) // 4 + 1] else max(comments) end as q3 from sig group by trend_id"))
def a10(spark, d):
    n = F.col("n")
    return A.pick_by_place(signals(spark, d), ["trend_id"], "comments", {"q1": F.when(n >= 4, F.floor(n / 4)).otherwise(0), "q3": F.when(n >= 4, F.floor(3 * n / 4)).otherwise(n - 1)}).select("trend_id", "q1", "q3")


@query("a11_top3_mean", sql("select trend_id, list_sum(list_sort(list(cents), 'desc')[1:3]) / least(count(*), 3) as top3 from sig group by trend_id"))
def a11(spark, d):
    s = signals(spark, d).withColumn("r", F.row_number().over(W.partitionBy("trend_id").orderBy(F.desc("cents")))).filter("r <= 3")
    return s.groupBy("trend_id").agg((F.sum("cents") / N()).alias("top3"))


@query("a12_harmonic_discount", sql("select trend_id, round(avg(x), 4) as weight from (select trend_id, cents / row_number() over (partition by trend_id, source order by cents desc, id) as x from sig) group by trend_id"))
def a12(spark, d):
    x = F.col("cents") / F.row_number().over(W.partitionBy("trend_id", "source").orderBy(F.desc("cents"), "id"))
    return signals(spark, d).withColumn("x", x).groupBy("trend_id").agg(F.round(F.avg("x"), 4).alias("weight"))


@query("a13_count_distinct", sql("select source, count(distinct trend_id) as trends, count(distinct created_at::date) as days from sig group by source"))
def a13(spark, d):
    return signals(spark, d).groupBy("source").agg(F.count_distinct("trend_id").alias("trends"), F.count_distinct(F.to_date("created_at")).alias("days"))


@query("a14_count_distinct_with_fallback", "select lang, count(distinct coalesce(nullif(source, 'src0'), doc_id::varchar)) as n from documents group by lang")
def a14(spark, d):
    k = F.coalesce(F.when(F.col("source") != "src0", F.col("source")), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count_distinct(k).alias("n"))


@query("a15_weighted_mean", "select l_suppkey, sum(l_quantity::bigint * l_linenumber) / sum(l_linenumber) as mean from lineitem group by l_suppkey")
def a15(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum(F.col("l_quantity").cast("long") * F.col("l_linenumber")) / F.sum("l_linenumber")).alias("mean"))


@query("a16_set_aggregate", sql("select trend_id, array_to_string(list_sort(list(distinct source)), ',') as sources from sig group by trend_id"))
def a16(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("a17_arg_max", sql("select trend_id, arg_max(id, cents * 1000000000 - id) as top_id, arg_min(source, epoch_us(created_at)) as first_source from sig group by trend_id"))
def a17(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.max_by("id", F.struct("cents", -F.col("id"))).alias("top_id"), F.min_by("source", "created_at").alias("first_source"))


@query("a18_mode", sql("select trend_id, arg_max(source, n * 10 - list_position(['click', 'error', 'purchase', 'signup', 'view'], source)) as mode from (select trend_id, source, count(*) as n from sig group by 1, 2) group by trend_id"))
def a18(spark, d):
    c = signals(spark, d).groupBy("trend_id", "source").agg(N().alias("n"))
    return c.groupBy("trend_id").agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("mode"))


@query("a19_gini", sql("select source, sum((2 * i - n - 1) * comments) / (max(n) * sum(comments)) as gini from (select source, comments, row_number() over (partition by source order by comments) as i, count(*) over (partition by source) as n from sig) group by source"))
def a19(spark, d):
    return A.gini(signals(spark, d), ["source"], "comments")


@query("a20_brier", f"with {PRED} select round(avg((c - actual::int) ** 2), 6) as brier from pred")
def a20(spark, d):
    return predictions(spark, d).agg(F.round(F.avg(F.pow(F.col("c") - F.col("actual").cast("int"), 2)), 6).alias("brier"))


@query("a21_calibration_error", f"""with {PRED}, b as (select least(floor(c * 10), 9)::int as bin, count(*) as n, avg(c) as conf, avg(actual::int) as acc from pred group by 1)
  select round(sum(n * abs(conf - acc)) / sum(n), 6) as ece, round(max(abs(conf - acc)), 6) as mce from b""")
def a21(spark, d):
    b = A.calibration_bins(predictions(spark, d), "c", "actual")
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return b.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


@query("a22_calibration_adjustments", f"""with {PRED} select least(floor(c * 10), 9)::int as bin, count(*) as n, round(avg(actual::int) / ((least(floor(c * 10), 9) * 2 + 1) / 20), 6) as multiplier from pred group by least(floor(c * 10), 9) having count(*) >= 5""")
def a22(spark, d):
    b = A.calibration_bins(predictions(spark, d), "c", "actual").filter("n >= 5")
    return b.select("bin", "n", F.round(F.col("accuracy") / ((F.col("bin") * 2 + 1) / 20), 6).alias("multiplier"))


@query("a23_funnel", """select l_partkey, count(*) as views, count_if(o_orderstatus <> 'P') as starts, count_if(o_orderstatus = 'F') as completions, count_if(o_orderstatus <> 'P') / count(*) as start_rate,
  case when count_if(o_orderstatus <> 'P') > 0 then count_if(o_orderstatus = 'F') / count_if(o_orderstatus <> 'P') end as completion_rate from lineitem join orders on o_orderkey = l_orderkey group by 1""")
def a23(spark, d):
    return outcomes(spark, d)


def outcomes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("s"))
    start, done = F.count_if(F.col("s") != "P"), F.count_if(F.col("s") == "F")
    return table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_partkey").agg(N().alias("views"), start.alias("starts"), done.alias("completions"), (start / N()).alias("start_rate"), A.rate(done, start).alias("completion_rate"))


@query("a24_two_level_rollup", """with o as (select l_partkey, count_if(o_orderstatus <> 'P') as starts, count_if(o_orderstatus = 'F') as completions from lineitem join orders on o_orderkey = l_orderkey group by 1)
  select p_brand, sum(starts)::bigint as starts, sum(completions)::bigint as completions, sum(completions) / sum(starts) as rate, round((1 - sum(completions) / sum(starts)) * 10, 6) as difficulty from o join part on p_partkey = l_partkey group by p_brand""")
def a24(spark, d):
    o = outcomes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rate = F.sum("completions") / F.sum("starts")
    return o.groupBy("p_brand").agg(F.sum("starts").alias("starts"), F.sum("completions").alias("completions"), rate.alias("rate"), F.round((1 - rate) * 10, 6).alias("difficulty"))


@query("a25_variant_summary", "select conv_id % 2 as variant, count(*) as n, sum(coalesce(case when turn % 3 > 0 then length(text) end, 0)) / count(*) as mean from conversations group by 1")
def a25(spark, d):
    c = F.when(F.col("turn") % 3 > 0, F.length("text"))
    return table(spark, d, "conversations").groupBy((F.col("conv_id") % 2).alias("variant")).agg(N().alias("n"), (F.sum(F.coalesce(c, F.lit(0))) / N()).alias("mean"))


@query("a26_bucketed_histogram", f"with {PRED} select count_if(c >= 0.8) as high, count_if(c >= 0.5 and c < 0.8) as medium, count_if(c < 0.5) as low from pred")
def a26(spark, d):
    c = F.col("c")
    return predictions(spark, d).agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


@query("a27_satisfaction_rate", sql("select trend_id, case when count_if(source in ('purchase', 'error')) > 0 then floor(100 * count_if(source = 'purchase') / count_if(source in ('purchase', 'error')) + 0.5)::bigint end as rate from sig group by trend_id"))
def a27(spark, d):
    up, down = F.count_if(F.col("source") == "purchase"), F.count_if(F.col("source") == "error")
    return signals(spark, d).groupBy("trend_id").agg(F.when(up + down > 0, F.floor(100 * up / (up + down) + 0.5)).alias("rate"))


@query("a28_alert_digest", sql("select source as kind, case when comments >= 90 then 'urgent' when comments >= 60 then 'high' else 'normal' end as priority, count(*) as n, count_if(id % 4 <> 0) as unseen, max(id) as newest from sig group by 1, 2"))
def a28(spark, d):
    p = F.when(F.col("comments") >= 90, "urgent").when(F.col("comments") >= 60, "high").otherwise("normal")
    return signals(spark, d).groupBy(F.col("source").alias("kind"), p.alias("priority")).agg(N().alias("n"), F.count_if(F.col("id") % 4 != 0).alias("unseen"), F.max("id").alias("newest"))


@query("a30_false_positives", "select l_partkey, count(*) as votes, count_if(l_returnflag = 'R') / count(*) as dismiss_rate from lineitem group by 1 having (count(*) >= 3 and count_if(l_returnflag = 'R') / count(*) >= 0.7) or (count(*) >= 2 and count_if(l_returnflag = 'N') = 0)")
def a30(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_partkey").agg(N().alias("votes"), (F.count_if(F.col("l_returnflag") == "R") / N()).alias("dismiss_rate"), F.count_if(F.col("l_returnflag") == "N").alias("kept"))
    return t.filter("(votes >= 3 and dismiss_rate >= 0.7) or (votes >= 2 and kept = 0)").drop("kept")


@query("a31_latest_per_group", "select o_custkey, arg_max(o_orderkey, epoch(o_orderdate) * 10000000 + o_orderkey) as o_orderkey from orders group by o_custkey")
def a31(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("a32_prediction_accuracy", f"with {PRED} select avg(((c >= 0.5) = actual)::int) as accuracy from (select * from pred order by doc_id desc limit 100)")
def a32(spark, d):
    return predictions(spark, d).orderBy(F.desc("doc_id")).limit(100).agg(F.avg(((F.col("c") >= 0.5) == F.col("actual")).cast("int")).alias("accuracy"))


@query("a33_outcome_stats", "select o_custkey, count_if(o_orderstatus = 'F') as completed, count_if(o_orderstatus = 'O') as started, count_if(o_orderstatus = 'P') as abandoned, floor(100 * count_if(o_orderstatus = 'F') / count(*) + 0.5)::bigint as percent from orders group by 1")
def a33(spark, d):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_custkey").agg(of("F").alias("completed"), of("O").alias("started"), of("P").alias("abandoned"), F.floor(100 * of("F") / N() + 0.5).alias("percent"))


@query("a34_weighted_score_mean", sql("select trend_id, round(sum(least(cents / 20000, 1) * 0.5 ** (date_diff('day', created_at::date, date '2024-01-31') / 7)) / count(*), 6) as momentum from sig group by trend_id"))
def a34(spark, d):
    age = F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("created_at"))
    return signals(spark, d).groupBy("trend_id").agg(F.round(F.sum(F.least(F.col("cents") / 20000, F.lit(1)) * F.pow(F.lit(0.5), age / 7)) / N(), 6).alias("momentum"))


@query("a35_distinct_pairs", sql("select count(distinct (trend_id, source)) as n from sig"))
def a35(spark, d):
    return signals(spark, d).agg(F.count_distinct(F.struct("trend_id", "source")).alias("n"))


@query("a36_source_share", sql("select source, count(*) as n, floor(100 * count(*) / sum(count(*)) over () + 0.5)::bigint as percent from sig group by source"))
def a36(spark, d):
    c = signals(spark, d).groupBy("source").agg(N().alias("n"))
    return c.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(W.partitionBy()) + 0.5))

"""Digests, reports and texts over the rules of the other modules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators import aggregates, rows
from sigmill.plans import rest as R
from sigmill.plans import state as T
from sigmill.plans import users as U
from sigmill.plans.scalars import CLASS, listed, q
from sigmill.registry import query, sql_of
from sigmill.sources.posts import links, posts, sql_posts
from sigmill.sources.tables import signals, sql

ALERTS = f"al as ({sql_of('d28_alert_rules')})"
# Priority of each alert.
PRIORITY = {
    "entered_early_edge": "high", "confidence_upgraded": "normal", "momentum_breakout": "high", "timing_uncertain": "low", "became_eligible": "high", "stage_transition": "normal", "entered_crowded_zone": "high", "crowding_increasing": "normal",
}


def n_rows():
    return F.count(F.lit(1))


def of_priority(level: str) -> list[str]:
    return [k for k, v in PRIORITY.items() if v == level]


@query("a28_alert_digest_by_priority", f"with {ALERTS} select trend_id, {', '.join(f'count_if(alert in {listed(of_priority(x))}) as {x}' for x in ('high', 'normal', 'low'))}, max(slot)::int as newest, string_agg(distinct alert, ',' order by alert) as alerts from al group by trend_id")
def a28(spark, d):
    levels = [F.count_if(F.col("alert").isin(of_priority(x))).alias(x) for x in ("high", "normal", "low")]
    return T.d28(spark, d).groupBy("trend_id").agg(*levels, F.max("slot").cast("int").alias("newest"), F.array_join(F.array_sort(F.collect_set("alert")), ",").alias("alerts"))


@query("d51_unseen_alerts", f"""with {ALERTS}, u as (select *, count(*) over (partition by trend_id) as unseen, row_number() over (partition by trend_id order by slot desc, alert) as place from al where slot % 3 <> 0 and slot % 5 <> 0) select trend_id, slot, alert, unseen from u where place <= 50""")
def d51(spark, d):
    """Newest fifty alerts of each trend that were neither seen (every third snapshot) nor dismissed (every fifth), with their count."""
    t = T.d28(spark, d).filter("slot % 3 <> 0 and slot % 5 <> 0").withColumn("unseen", n_rows().over(W.partitionBy("trend_id")))
    return rows.top_k(t, 50, F.desc("slot"), F.asc("alert"), keys=["trend_id"]).select("trend_id", "slot", "alert", "unseen")


@query("a29_trust_funnel", sql(f"select count(*) as trends, count_if({T.SCORE} >= 0.5) as qualified, count_if({T.SCORE} >= 0.5 and demand >= 3) as confirmed, count_if({T.SCORE} >= 0.5 and demand = 0) as doubtful, round(avg(conf) + 1e-9, 5)::double as confidence from state", T.STATE))
def a29(spark, d):
    good = T.score() >= 0.5
    t = T.state(spark, d).agg(n_rows().alias("trends"), F.count_if(good).alias("qualified"), F.count_if(good & (F.col("demand") >= 3)).alias("confirmed"), F.count_if(good & (F.col("demand") == 0)).alias("doubtful"), F.avg("conf").alias("c"))
    return t.select("trends", "qualified", "confirmed", "doubtful", F.round(F.col("c") + 1e-9, 5).alias("confidence"))


@query("d25_calibrated_by_bins", f"""select trend_id, round(c, 6)::double as calibrated, round(half_width * c / confidence, 6)::double as half_width from (select *, greatest(0.01, least(0.99, confidence * (1 + (k - 5) * 0.02) + (5 - k) * 0.005)) as c from
  (select *, least(floor(confidence * 10 + 1e-9), 9) as k from ({sql_of('d24_will_qualify')})))""")
def d25(spark, d):
    k = F.least(F.floor(F.col("confidence") * 10 + 1e-9), F.lit(9))
    t = T.d24a(spark, d).withColumn("c", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("confidence") * (1 + (k - 5) * 0.02) + (5 - k) * 0.005)))
    return t.select("trend_id", F.round("c", 6).alias("calibrated"), F.round(F.col("half_width") * F.col("c") / F.col("confidence"), 6).alias("half_width"))


@query("d33_rates_and_adjustment", f"""select n, round(fp / n, 6) as false_positive_rate, round(fn / n, 6) as false_negative_rate, case when fp > 0.3 * n then 'raise_threshold' when fn > 0.3 * n then 'lower_threshold' else 'keep' end as adjustment
  from (select count(*) as n, count_if(kind = 'false_positive') as fp, count_if(kind = 'false_negative') as fn from ({sql_of('d33_misclassification')}))""")
def d33(spark, d):
    is_ = lambda k: F.count_if(F.col("kind") == k)
    t = U.d33(spark, d).agg(n_rows().alias("n"), is_("false_positive").alias("fp"), is_("false_negative").alias("fn"))
    step = F.when(F.col("fp") > 0.3 * F.col("n"), "raise_threshold").when(F.col("fn") > 0.3 * F.col("n"), "lower_threshold").otherwise("keep")
    return t.select("n", F.round(F.col("fp") / F.col("n"), 6).alias("false_positive_rate"), F.round(F.col("fn") / F.col("n"), 6).alias("false_negative_rate"), step.alias("adjustment"))


BASE = {"click": 0.25, "error": 0.25, "purchase": 0.20, "signup": 0.15, "view": 0.10}


@query("d34_renormalised_weights", sql(f"""select source, round(0.95 * w / sum(w) over (), 6)::double as weight from (select source, case source {' '.join(f"when '{k}' then {v}" for k, v in BASE.items())} else 0.05 end + round(greatest(-0.2, least(0.2, (sum(comments) / count(*) / 100 - 0.5) * 0.05 * count(*) / 5)) + 1e-9, 4) as w
  from sig group by source having count(*) >= 5)"""))
def d34(spark, d):
    base = F.lit(0.05)
    for k, v in BASE.items():
        base = F.when(F.col("source") == k, v).otherwise(base)
    shift = (F.sum("comments") / n_rows() / 100 - 0.5) * 0.05 * n_rows() / 5
    t = signals(spark, d).groupBy("source").agg(n_rows().alias("n"), F.round(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), shift)) + 1e-9, 4).alias("shift")).filter("n >= 5").withColumn("w", base + F.col("shift"))
    return t.select("source", F.round(0.95 * F.col("w") / F.sum("w").over(W.partitionBy()), 6).alias("weight"))


@query("d37_health_checks_by_name", sql_posts(f"""select 'canonical_share' as name, count(canonical) * 2 >= count(*) as passed from cu union all select 'has_posts', count(*) > 0 from posts
  union all select 'scores_positive', count_if(score > 0) * 2 >= count(*) from posts union all select 'titles_filled', count_if(length(title) > 0) = count(*) from posts union all select 'several_sources', count(distinct site) >= 2 from posts""", R.SITES))
def d37(spark, d):
    p = posts(spark, d)
    told = p.agg((n_rows() > 0).alias("has_posts"), (F.count_if(F.col("score") > 0) * 2 >= n_rows()).alias("scores_positive"), (F.count_if(F.length("title") > 0) == n_rows()).alias("titles_filled"), (F.count_distinct("site") >= 2).alias("several_sources"))
    canon = links(spark, d).agg((F.count(X.canonical_url(F.col("url"))["url"]) * 2 >= n_rows()).alias("canonical_share"))
    each = lambda t: t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("passed")) for c in t.columns])).alias("x")).select("x.*")
    return each(told).unionByName(each(canon))


@query("d38_trajectory_points", sql("select trend_id, string_agg(slot::varchar || ':' || stage || ':' || n::varchar, '|' order by slot) as points, count(*) as snapshots, round(max(m), 6) as peak, arg_max(slot, m - slot * 1e-9)::int as peak_slot from hist group by trend_id", T.LIFE))
def d38(spark, d):
    """Points follow the time that a trend is watched, not its signals."""
    t = T.history(spark, d).groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct("slot", "stage", "n"))).alias("x"), n_rows().alias("snapshots"), F.round(F.max("m"), 6).alias("peak"), F.max_by("slot", F.col("m") - F.col("slot") * 1e-9).cast("int").alias("peak_slot"))
    told = F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["slot"].cast("string"), x["stage"], x["n"].cast("string"))), "|")
    return t.select("trend_id", told.alias("points"), "snapshots", "peak", "peak_slot")


@query("d55_explore_list_joined", f"""with o as ({sql_of('d11_opportunity_quality')}), h as ({sql_of('d13_hypothesis_score')}), g as ({sql_of('d27_growth_prediction_rules')}), l as ({sql_of('d59_brief_response')})
  select trend_id, l.momentum, l.stage, o.score, h.status, g.prob, g.direction, case when signal_count >= 3 then 'high' when signal_count >= 2 then 'medium' else 'low' end as quality from l join o using (trend_id) join h using (trend_id) join g using (trend_id) where l.stage_confidence >= 0.5""")
def d55(spark, d):
    t = T.d59(spark, d).filter("stage_confidence >= 0.5").join(T.d11(spark, d).select("trend_id", "score"), "trend_id").join(T.d13(spark, d).select("trend_id", "status"), "trend_id").join(T.d27(spark, d).select("trend_id", "prob", "direction"), "trend_id")
    return t.select("trend_id", "momentum", "stage", "score", "status", "prob", "direction", F.when(F.col("signal_count") >= 3, "high").when(F.col("signal_count") >= 2, "medium").otherwise("low").alias("quality"))


@query("d57_outcome_sections", f"""with a as ({sql_of('d32_archetype')}), k as ({sql_of('d33_misclassification')}) select 'archetype' as section, coalesce(archetype, 'none') as name, count(*) as n from a group by 2 union all select 'misclassification', kind, count(*) from k group by 2 union all select 'actual', actual, count(*) from k group by 2""")
def d57(spark, d):
    k = U.d33(spark, d)
    of = lambda t, c, s: t.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("name")).agg(n_rows().alias("n")).select(F.lit(s).alias("section"), "name", "n")
    return of(U.d32(spark, d), "archetype", "archetype").unionByName(of(k, "kind", "misclassification")).unionByName(of(k, "actual", "actual"))


@query("d60_context_of_titles", sql_posts("""select trend, substr(string_agg(title, ' | ' order by score desc, id), 1, 2000) as context from (select * from (select * from posts qualify row_number() over (partition by trend, title order by score desc, id) = 1) qualify row_number() over (partition by trend order by score desc, id) <= 20) group by trend"""))
def d60(spark, d):
    p = posts(spark, d).select("id", "trend", "score", "title")
    once = rows.top_k(p, 1, F.desc("score"), F.asc("id"), keys=["trend", "title"])
    top = rows.top_k(once, 20, F.desc("score"), F.asc("id"), keys=["trend"]).groupBy("trend").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "title"))).alias("x"))
    return top.select("trend", F.substring(F.array_join(F.transform("x", lambda x: x["title"]), " | "), 1, 2000).alias("context"))


GUARDS = {"first": "First snapshot of this trend", "gap": "Less than 12 hours since the snapshot before", "small": "Momentum before was too small to compare with"}


@query("d62_guards_explained", sql(f"select trend_id, slot, case when pm is null then {q(GUARDS['first'])} when gap < 12 then {q(GUARDS['gap'])} else {q(GUARDS['small'])} end as why from s2 where not comparable", T.LIFE))
def d62(spark, d):
    why = F.when(F.col("pm").isNull(), GUARDS["first"]).when(F.col("gap") < 12, GUARDS["gap"]).otherwise(GUARDS["small"])
    return T.history(spark, d).filter("not comparable").select("trend_id", "slot", why.alias("why"))


@query("m08_change_with_guards", sql("select trend_id, slot, round(p, 4)::double as change, case when pm is null then 'first' when gap < 12 then 'gap' when pm < 0.01 then 'small' else 'none' end as guard from (select * from s3)", T.LIFE))
def m08(spark, d):
    guard = F.when(F.col("pm").isNull(), "first").when(F.col("gap") < 12, "gap").when(F.col("pm") < 0.01, "small").otherwise("none")
    return T.history(spark, d).select("trend_id", "slot", F.round("p", 4).alias("change"), guard.alias("guard"))


@query("m04_baseline_chain", sql_posts("select trend, case when n >= 60 then greatest(p90, 1) when n >= 20 then median when trend like 'en-%' then 426 when trend like 'de-%' then 1690 else 100 end::bigint as p90, case when n >= 60 then 'rolling' when n >= 20 then 'median' when trend like 'en-%' or trend like 'de-%' then 'bootstrap' else 'fallback' end as method from (select trend, count(*) as n, list_sort(list(score))[(count(*) * 9) // 10 + 1] as p90, list_sort(list(score))[count(*) // 2 + 1] as median from posts group by 1)"))
def m04(spark, d):
    t = aggregates.pick_by_place(posts(spark, d), ["trend"], "score", {"p90": aggregates.index_p90(), "median": F.floor(F.col("n") / 2)})
    en, de, n = F.col("trend").startswith("en-"), F.col("trend").startswith("de-"), F.col("n")
    value = F.when(n >= 60, F.greatest("p90", F.lit(1))).when(n >= 20, F.col("median")).when(en, 426).when(de, 1690).otherwise(100)
    return t.select("trend", value.cast("long").alias("p90"), F.when(n >= 60, "rolling").when(n >= 20, "median").when(en | de, "bootstrap").otherwise("fallback").alias("method"))


@query("f16_evidence_hash_of_json", sql_posts("select trend, substr(sha256(to_json(list({'id': id, 'score': score} order by id))::varchar), 1, 16) as hash from (select * from posts qualify row_number() over (partition by trend order by score desc, id) <= 10) group by trend"))
def f16(spark, d):
    top = rows.top_k(posts(spark, d).select("id", "trend", "score"), 10, F.desc("score"), F.asc("id"), keys=["trend"])
    return top.groupBy("trend").agg(F.substring(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("id", "score")))), 256), 1, 16).alias("hash"))


@query("f31_cluster_name_of_titles", sql_posts("""select trend, string_agg(upper(w[1]) || w[2:], ' ' order by k desc, pos) as name from (select trend, w, count(*) as k, min(pos) as pos from (select trend, unnest(regexp_split_to_array(regexp_replace(lower(title), '[^a-z ]', '', 'g'), ' +')) as w, place * 1000 + generate_subscripts(regexp_split_to_array(regexp_replace(lower(title), '[^a-z ]', '', 'g'), ' +'), 1) as pos
  from (select *, row_number() over (partition by trend order by score desc, id) as place from posts) where place <= 5) where length(w) > 3 group by 1, 2 qualify row_number() over (partition by trend order by count(*) desc, min(pos)) <= 3) group by trend"""))
def f31(spark, d):
    p = posts(spark, d).select("id", "trend", "score", "title")
    p = p.withColumn("place", F.row_number().over(W.partitionBy("trend").orderBy(F.desc("score"), "id"))).filter("place <= 5")
    w = p.select("trend", "place", F.posexplode(F.split(F.regexp_replace(F.lower("title"), "[^a-z ]", ""), " +")).alias("i", "w")).filter(F.length("w") > 3)
    k = w.groupBy("trend", "w").agg(n_rows().alias("k"), F.min(F.col("place") * 1000 + F.col("i") + 1).alias("pos"))
    top = rows.top_k(k, 3, F.desc("k"), F.asc("pos"), keys=["trend"]).groupBy("trend").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "pos", "w"))).alias("x"))
    return top.select("trend", F.array_join(F.transform("x", lambda x: F.initcap(x["w"])), " ").alias("name"))


NARRATIVE = ["personal_story", "opinion", "social_commentary", "career_advice"]


@query("f36_topic_only_by_rules", sql(f"select trend_id, count_if(c in {listed(NARRATIVE)}) > 0.6 * count(*) or (count(distinct source) = 1 and count(*) <= 2) or count(distinct title) <= 1 as topic_only from (select trend_id, source, title, {CLASS} as c from sig) group by trend_id"))
def f36(spark, d):
    t = signals(spark, d).select("trend_id", "source", "title", X.content_class(F.col("title"), F.col("source")).alias("c")).groupBy("trend_id")
    told = F.count_if(F.col("c").isin(NARRATIVE)) > 0.6 * n_rows()
    return t.agg((told | ((F.count_distinct("source") == 1) & (n_rows() <= 2)) | (F.count_distinct("title") <= 1)).alias("topic_only"))


@query("f37_summary_text", sql("""select trend_id, concat_ws(' ', signals::varchar || ' signals from ' || sources::varchar || ' sources.', case when demand >= 3 then 'Demand is clear.' when demand >= 1 then 'There is some demand.' end, case stage when 'rising' then 'Momentum is rising.' when 'peaking' then 'Momentum is at its peak.' when 'declining' then 'Momentum is falling.' when 'fading' then 'Interest is fading.' end,
  case when days < 2 then 'Seen on one day only.' else 'Seen on ' || days::int::varchar || ' days.' end) as summary from state""", T.STATE))
def f37(spark, d):
    c = F.col
    parts = [
        F.concat(c("signals").cast("string"), F.lit(" signals from "), c("sources").cast("string"), F.lit(" sources.")),
        F.when(c("demand") >= 3, "Demand is clear.").when(c("demand") >= 1, "There is some demand."),
        F.when(c("stage") == "rising", "Momentum is rising.").when(c("stage") == "peaking", "Momentum is at its peak.").when(c("stage") == "declining", "Momentum is falling.").when(c("stage") == "fading", "Interest is fading."),
        F.when(c("days") < 2, "Seen on one day only.").otherwise(F.concat(F.lit("Seen on "), c("days").cast("string"), F.lit(" days."))),
    ]
    return T.state(spark, d).select("trend_id", F.concat_ws(" ", *parts).alias("summary"))

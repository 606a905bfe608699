"""Dedup, trends, gates, saturation, confidence, predictions and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions import scoring as S
from sigmill.functions import text as X
from sigmill.operators import dedup, rows
from sigmill.operators import windows as O
from sigmill.plans.aggregates import PRED, predictions
from sigmill.plans.scalars import CLASS, CLEAN, shown
from sigmill.plans.windows import LIFE, D
from sigmill.registry import query
from sigmill.sources.tables import items, signals, sql, table


def N():  # noqa: N802
    """Count of the rows of a group."""
    return F.count(F.lit(1))



@query("d00_trend_momentum", sql("""select t.trend_id, round(0.5 * e + 0.3 * s + 0.2 * dd * dd, 6) as momentum, signals from (select trend_id, count(*) as signals, sum(least(cents / p90, 1) * 0.5 ** (date_diff('day', created_at::date, date '2024-01-31') / 7)) / count(*) as e,
  least(1, (count(distinct source) - 1) / 6) as s, count_if(source in ('purchase', 'signup')) / count(*) as dd from sig join p using (source) group by trend_id) t order by momentum desc, t.trend_id limit 30""",
  "p as (select source, greatest(list_sort(list(cents))[(count(*) * 9) // 10 + 1], 100) as p90 from sig group by source)"))
def d00(spark, d):
    """Flagship: engagement over its source's percentile, decayed by age, with diversity and demand; top 30."""
    from sigmill.operators.aggregates import index_p90, pick_by_place

    s = signals(spark, d)
    p = pick_by_place(s, ["source"], "cents", {"p90": index_p90()}).select("source", F.greatest("p90", F.lit(100)).alias("p90"))
    age = F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("created_at"))
    x = F.least(F.col("cents") / F.col("p90"), F.lit(1)) * S.decay(age)
    kinds = F.least(F.lit(1.0), (F.count_distinct("source") - 1) / 6)
    demand = F.count_if(F.col("source").isin("purchase", "signup")) / N()
    t = s.join(p, "source").groupBy("trend_id").agg(N().alias("signals"), (F.sum(x) / N()).alias("e"), kinds.alias("s"), demand.alias("dd"))
    t = t.select("trend_id", F.round(S.momentum(F.col("e"), F.col("s"), F.col("dd")), 6).alias("momentum"), "signals")
    return rows.top_k(t, 30, F.desc("momentum"), F.asc("trend_id"))


CANON = "canon as (select page_id, rtrim(lower(regexp_extract(cleaned, '^\\w+://([^/?]*)', 1)) || regexp_extract(cleaned, '^\\w+://[^/?]*([^?]*)', 1), '/') as c from clean)"


@query("d01_url_duplicates", f"with {CLEAN}, {CANON} select first as canonical, page_id as duplicate, 'canonical_url' as match_type from (select *, min(page_id) over (partition by c) as first from canon) where first <> page_id")
def d01(spark, d):
    return dedup.url_duplicates(table(spark, d, "pages"), "page_id", "url")


@query("d02_event_groups")
def d02(spark, d):
    return dedup.event_groups(signals(spark, d), "id", "title")


PH = "ph as (select p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) as phrase from part)"


@query("d03_phrase_index", f"with {PH} select phrase, count(*) as n, min(p_partkey) as first from ph group by phrase having count(*) >= 2")
def d03(spark, d):
    return dedup.phrase_index(table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("ph")), "p_partkey", "ph")


@query("d03b_trends", f"""with {PH}, sz as (select phrase, count(*) as size from ph group by phrase), best as (select p_partkey, phrase from ph join sz using (phrase) qualify row_number() over (partition by p_partkey order by size desc, phrase) = 1)
  select phrase as trend, count(*) as n from best group by phrase having count(*) >= 2 order by n desc, trend limit 30""")
def d03b(spark, d):
    return dedup.trends(table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("ph")), "p_partkey", "ph")




@query("d05_cluster_continuity", """with a0 as (select label, i, avg(x) as x from (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) where vec_id % 2 = 0 group by 1, 2),
b0 as (select label, i, avg(x) as x from (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) where vec_id % 2 = 1 group by 1, 2),
a as (select label, list(x order by i) as v from a0 group by label), b as (select label, list(x order by i) as v from b0 group by label)
select a.label, arg_max(b.label, list_cosine_similarity(a.v, b.v)) as previous, round(max(list_cosine_similarity(a.v, b.v)), 6) as similarity, case when max(list_cosine_similarity(a.v, b.v)) >= 0.5 then 'continuation' else 'new' end as lineage from a, b group by a.label""")
def d05(spark, d):
    """Nearest centroid of the half before, by blocks of centroids."""
    from sigmill.operators.joins import nearest_vectors

    e = table(spark, d, "embeddings")
    now, old = (dedup.centroids(e.filter(f"vec_id % 2 = {k}"), "label", "embedding") for k in (0, 1))
    best = nearest_vectors(now, old, "label", "centroid", 1, -1.0)
    kind = F.when(F.col("c") >= 0.5, "continuation").otherwise("new")
    return best.select(F.col("query_id").cast("int").alias("label"), F.col("label").cast("int").alias("previous"), F.round("c", 6).alias("similarity"), kind.alias("lineage"))


@query("d06_cluster_distance", """with c0 as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2), c as (select label, list(x order by i) as v from c0 group by label)
select label, count(*) as n, count_if(1 - list_cosine_similarity(embedding::double[], v) <= 0.3) as strong, round(avg(1 - list_cosine_similarity(embedding::double[], v)), 6) as distance from embeddings join c using (label) group by label""")
def d06(spark, d):
    from sigmill.operators.joins import cosine

    e = table(spark, d, "embeddings")
    t = e.join(dedup.centroids(e, "label", "embedding"), "label").withColumn("x", 1 - cosine(F.col("embedding"), F.col("centroid")))
    return t.groupBy("label").agg(N().alias("n"), F.count_if(F.col("x") <= 0.3).alias("strong"), F.round(F.avg("x"), 6).alias("distance"))


@query("d07_garbage_filter", sql(f"""select trend_id, count_if(c in ('career_advice', 'social_commentary', 'personal_story', 'opinion', 'ask_hn')) / count(*) as off_topic, count_if(c in ('product', 'show_hn', 'technical')) = 0 as no_product,
  count_if(c in ('career_advice', 'social_commentary', 'personal_story', 'opinion', 'ask_hn')) / count(*) > 0.6 or count_if(c in ('product', 'show_hn', 'technical')) = 0 as garbage from (select trend_id, {CLASS} as c from sig) group by trend_id"""))
def d07(spark, d):
    c = F.col("c")
    off = F.count_if(c.isin("career_advice", "social_commentary", "personal_story", "opinion", "ask_hn")) / N()
    none = F.count_if(c.isin("product", "show_hn", "technical")) == 0
    return signals(spark, d).select("trend_id", X.content_class(F.col("title"), F.col("source")).alias("c")).groupBy("trend_id").agg(off.alias("off_topic"), none.alias("no_product"), ((off > 0.6) | none).alias("garbage"))


GATE = "g as (select trend_id, count(distinct created_at::date) as days, count(distinct title) as artifacts, count_if(source = 'purchase') as demand, sum(comments)::bigint as comments from sig group by trend_id)"


@query("d10_first_failing_gate", sql("select trend_id, case when days < 2 then 'persistence' when artifacts < 2 then 'artifacts' when comments < 200 then 'confidence' when demand < 1 then 'demand' else 'qualified' end as gate from g", GATE))
def d10(spark, d):
    t = gates(spark, d)
    g = F.when(F.col("days") < 2, "persistence").when(F.col("artifacts") < 2, "artifacts").when(F.col("comments") < 200, "confidence").when(F.col("demand") < 1, "demand").otherwise("qualified")
    return t.select("trend_id", g.alias("gate"))


def gates(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.count_distinct(F.to_date("created_at")).alias("days"), F.count_distinct("title").alias("artifacts"), F.count_if(F.col("source") == "purchase").alias("demand"), F.sum("comments").alias("comments"))


@query("d11_opportunity_score", sql("select trend_id, round(0.5 * least(comments / 1000, 1) + 0.3 * least(demand / 3, 1) + 0.2 * least(artifacts / 10, 1), 6) as score from g", GATE))
def d11(spark, d):
    cap = lambda c, n: F.least(F.col(c) / n, F.lit(1))
    return gates(spark, d).select("trend_id", F.round(0.5 * cap("comments", 1000) + 0.3 * cap("demand", 3) + 0.2 * cap("artifacts", 10), 6).alias("score"))


@query("d13_hypothesis_confidence", sql("""select trend_id, round(case when artifacts >= 3 then 0.3 when artifacts >= 2 then 0.15 else 0 end + case when demand >= 3 then 0.2 when demand >= 1 then 0.1 else 0 end + case when days >= 5 then 0.3 when days >= 3 then 0.15 else 0 end, 6)::double as confidence,
  case when demand = 0 or case when artifacts >= 3 then 0.3 when artifacts >= 2 then 0.15 else 0 end + case when demand >= 3 then 0.2 when demand >= 1 then 0.1 else 0 end + case when days >= 5 then 0.3 when days >= 3 then 0.15 else 0 end < 0.5 then 'uncertain' else 'supported' end as status from g""", GATE))
def d13(spark, d):
    step = lambda c, hi, a, lo, b: F.when(F.col(c) >= hi, a).when(F.col(c) >= lo, b).otherwise(0.0)
    t = gates(spark, d).withColumn("c", F.round(step("artifacts", 3, 0.3, 2, 0.15) + step("demand", 3, 0.2, 1, 0.1) + step("days", 5, 0.3, 3, 0.15), 6))
    return t.select("trend_id", F.col("c").alias("confidence"), F.when((F.col("demand") == 0) | (F.col("c") < 0.5), "uncertain").otherwise("supported").alias("status"))


SAT = """sa as (select trend_id, (sum((2 * i - n - 1) * comments)) / nullif(max(n) * sum(comments), 0) as gini, max(n) as n, max(k) as k, max(alt) as alt from (select trend_id, comments, row_number() over w as i, count(*) over (partition by trend_id) as n,
  (select count(distinct s.source) from sig s where s.trend_id = sig.trend_id) as k, count_if(title like '%alternative%') over (partition by trend_id) as alt from sig window w as (partition by trend_id order by comments)) group by trend_id),
sat as (select trend_id, case when n >= 5 then 0.6 * least(n / 30, 1) + 0.4 * (1 - coalesce(gini, 0)) end as density, case when alt > 0 then least(alt / n / 0.3, 1) end as intent, least((k - 1) / 4, 1) as spread from sa),
satu as (select trend_id, round((coalesce(density * 0.30, 0) + coalesce(intent * 0.25, 0) + coalesce(spread * 0.15, 0)) / (case when density is null then 0 else 0.30 end + case when intent is null then 0 else 0.25 end + 0.15), 6)::double as saturation from sat)"""


@query("d17_saturation", sql("select trend_id, saturation, case when saturation < 0.3 then 'low' when saturation <= 0.6 then 'moderate' else 'high' end as level from satu", SAT))
def d17(spark, d):
    from sigmill.operators.aggregates import gini

    s = signals(spark, d)
    t = s.groupBy("trend_id").agg(N().alias("n"), F.count_distinct("source").alias("k"), F.count_if(F.col("title").contains("alternative")).alias("alt")).join(gini(s, ["trend_id"], "comments"), "trend_id")
    n = F.col("n")
    density = F.when(n >= 5, 0.6 * F.least(n / 30, F.lit(1)) + 0.4 * (1 - F.col("gini")))
    intent = F.when(F.col("alt") > 0, F.least(F.col("alt") / n / 0.3, F.lit(1)))
    t = t.withColumn("saturation", F.round(S.saturation([(density, 0.30), (intent, 0.25), (F.least((F.col("k") - 1) / 4, F.lit(1.0)), 0.15)]), 6))
    return t.select("trend_id", "saturation", F.when(F.col("saturation") < 0.3, "low").when(F.col("saturation") <= 0.6, "moderate").otherwise("high").alias("level"))


@query("d24_raw_confidence", sql("""select trend_id, day::varchar as day, round(greatest(0.05, least(0.95, 0.5 + case when momentum >= 0.7 then 0.15 when momentum >= 0.5 then 0.08 when momentum < 0.3 then -0.10 else 0 end + case when n >= 5 then 0.10 when n >= 3 then 0.05 else 0 end
  + case when stage in ('rising', 'peaking') then 0.08 when stage in ('fading', 'declining') then -0.12 else 0 end + case when n_sources / 5 >= 0.5 then 0.08 when n_sources / 5 < 0.2 then -0.05 else 0 end)), 6)::double as confidence from life""", LIFE))
def d24(spark, d):
    t = O.lifecycle(items(spark, d))
    c = S.will_qualify(F.col("momentum"), F.col("n"), F.col("stage"), F.col("n_sources") / 5, F.lit(0.5))
    return t.select("trend_id", D(), F.round(c, 6).alias("confidence"))


@query("d25_calibrated_prediction", f"""with {PRED}, b as (select least(floor(c * 10), 9) as bin, avg(actual::int) / ((least(floor(c * 10), 9) * 2 + 1) / 20) as m from pred group by least(floor(c * 10), 9) having count(*) >= 5)
  select doc_id, round(greatest(0.01, least(0.99, c * coalesce(m, 1))), 6) as calibrated from pred left join b on c >= bin / 10 and c < (bin + 1) / 10""")
def d25(spark, d):
    from sigmill.operators.aggregates import calibration_bins

    p = predictions(spark, d)
    b = calibration_bins(p, "c", "actual").filter("n >= 5").select("bin", (F.col("accuracy") / ((F.col("bin") * 2 + 1) / 20)).alias("m"))
    t = p.join(F.broadcast(b), (F.col("c") >= F.col("bin") / 10) & (F.col("c") < (F.col("bin") + 1) / 10), "left")  # ten rows at most
    return t.select("doc_id", F.round(S.clamp(F.col("c") * F.coalesce("m", F.lit(1.0)), 0.01, 0.99), 6).alias("calibrated"))


@query("d27_growth_prediction", sql("""select trend_id, day::varchar as day, round(greatest(0, least(1, case when p > 100 then 0.3 when p > 50 then 0.2 when p > 10 then 0.1 when p < -30 then -0.15 else 0 end + case when n_sources >= 4 then 0.15 when n_sources >= 2 then 0.08 else 0 end
  + case when demand / n > 0.3 then 0.15 when demand / n > 0.1 then 0.08 else 0 end + case when stage in ('emerging', 'rising') then 0.1 when stage = 'peaking' then 0.05 when stage in ('declining', 'fading') then -0.1 else 0 end + case when momentum > 0.7 then 0.1 else 0 end)), 4)::double as probability from life""", LIFE))
def d27(spark, d):
    p, k, r = F.col("change"), F.col("n_sources"), F.col("demand") / F.col("n")
    x = F.when(p > 100, 0.3).when(p > 50, 0.2).when(p > 10, 0.1).when(p < -30, -0.15).otherwise(0.0)
    x = x + F.when(k >= 4, 0.15).when(k >= 2, 0.08).otherwise(0.0) + F.when(r > 0.3, 0.15).when(r > 0.1, 0.08).otherwise(0.0)
    x = x + F.when(F.col("stage").isin("emerging", "rising"), 0.1).when(F.col("stage") == "peaking", 0.05).when(F.col("stage").isin("declining", "fading"), -0.1).otherwise(0.0)
    x = x + F.when(F.col("momentum") > 0.7, 0.1).otherwise(0.0)
    return O.lifecycle(items(spark, d)).select("trend_id", D(), F.round(S.clamp(x, 0, 1), 4).alias("probability"))


@query("d28_alerts", sql("""select trend_id, day::varchar as day, kind from (select trend_id, day, unnest(list_filter([case when stage = 'rising' and ps is distinct from 'rising' then 'entered_rising' end, case when conf - pc >= 0.15 then 'confidence_upgraded' end,
  case when stage in ('declining', 'fading') and ps in ('rising', 'peaking') then 'expiry_risk' end, case when ps <> stage then 'stage_transition' end], lambda x: x is not null)) as kind
  from (select *, lag(stage) over w as ps, lag(conf) over w as pc from life window w as (partition by trend_id order by day)))""", LIFE))
def d28(spark, d):
    w = O.by()
    t = O.lifecycle(items(spark, d)).withColumns({"p": F.lag("stage").over(w), "pc": F.lag("stage_confidence").over(w)})
    s, p = F.col("stage"), F.col("p")
    kinds = [
        F.when((s == "rising") & ~p.eqNullSafe("rising"), "entered_rising"),
        F.when(F.col("stage_confidence") - F.col("pc") >= 0.15, "confidence_upgraded"),
        F.when(s.isin("declining", "fading") & p.isin("rising", "peaking"), "expiry_risk"),
        F.when(p != s, "stage_transition"),
    ]
    return t.select("trend_id", D(), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


@query("d45_novelty_by_title", sql("select title, count(*) as seen, round(greatest(0.05, 1 / (1.5 * count(*))), 8)::double as novelty from sig group by title"))
def d45(spark, d):
    return signals(spark, d).groupBy("title").agg(N().alias("seen"), F.round(F.greatest(F.lit(0.05), 1 / (1.5 * N())), 8).alias("novelty"))


@query("d46_negative_ratio", sql(f"select trend_id, count_if(len({shown(X.NEGATIVE)}) > 0) / count(*) as ratio, case when count_if(len({shown(X.NEGATIVE)}) > 0) / count(*) >= 0.4 then 'negative' when count_if(len({shown(X.NEGATIVE)}) > 0) / count(*) >= 0.15 then 'mixed' else 'neutral' end as label from sig group by trend_id"))
def d46(spark, d):
    r = F.count_if(F.size(X.signs(F.col("title"), X.NEGATIVE)) > 0) / N()
    return signals(spark, d).groupBy("trend_id").agg(r.alias("ratio"), F.when(r >= 0.4, "negative").when(r >= 0.15, "mixed").otherwise("neutral").alias("label"))


@query("d53_demand_density", sql("select trend_id, round(avg(comments / 100) * (count_if(comments >= 30) / count(*)), 6) as density from sig group by trend_id"))
def d53(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.round(F.sum("comments") / N() / 100 * (F.count_if(F.col("comments") >= 30) / N()), 6).alias("density"))


@query("d54_quality_label", sql("select trend_id, case when count(distinct source) >= 2 and count(*) >= 3 then 'high' when count(*) >= 2 then 'medium' else 'low' end as quality from sig group by trend_id"))
def d54(spark, d):
    return signals(spark, d).groupBy("trend_id").agg(F.when((F.count_distinct("source") >= 2) & (N() >= 3), "high").when(N() >= 2, "medium").otherwise("low").alias("quality"))


@query("d63_failing_collectors", sql("""select trend_id, streak from (select trend_id, sum(f) over (partition by trend_id, island order by created_at, id rows unbounded preceding)::bigint as streak, row_number() over (partition by trend_id order by created_at desc, id desc) as k
  from (select *, (source = 'error')::int as f, sum((source <> 'error')::int) over (partition by trend_id order by created_at, id rows unbounded preceding) as island from sig)) where k = 1 and streak >= 2"""))
def d63(spark, d):
    s = O.failure_streaks(signals(spark, d).withColumn("at", F.struct("created_at", "id")), "trend_id", "at", F.col("source") == "error")
    return s.groupBy("trend_id").agg(F.max_by("streak", "at").alias("streak")).filter("streak >= 2")


@query("d64_skip_unchanged", "select doc_id from documents d where not exists (select 1 from documents e where e.doc_id = d.doc_id - 1 and sha256(coalesce(e.text, '')) = sha256(coalesce(d.text, '')))")
def d64(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return t.join(t.select((F.col("doc_id") + 1).alias("doc_id"), "h"), ["doc_id", "h"], "left_anti").select("doc_id")

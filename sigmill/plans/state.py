"""Rules over the state of a trend: lifecycle by snapshots of eight hours, gates, scores, predictions, confidences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import market as M
from sigmill.functions import scoring as S
from sigmill.functions import text as X
from sigmill.operators import rows
from sigmill.plans.scalars import q
from sigmill.plans.users import ARCH, OUT, part_outcomes
from sigmill.registry import query
from sigmill.sources.tables import signals, sql, table

#: Hours between snapshots.
HOURS = 8
STAGES = """case when pm is null then 'emerging' when not comparable then 'stable' when m >= 0.5 and abs(p) <= case when gap < 24 then 5 else 10 end then 'peaking' when p > 20 and m >= 0.3 then 'rising' when p < -20 and m >= 0.3 then 'declining'
  when m < 0.3 and p < -10 then 'fading' when m < 0.3 and p > 10 then 'emerging' else 'stable' end"""
SURE = """case when pm is null then least(0.9, ceil) when not comparable then 0.5 when m >= 0.5 and abs(p) <= case when gap < 24 then 5 else 10 end then least(0.76, ceil) when p > 20 and m >= 0.3 then least(0.76, ceil) when p < -20 and m >= 0.3 then least(0.72, ceil)
  when m < 0.3 and p < -10 then least(case when ds < 0 then 0.72 else 0.56 end, ceil) when m < 0.3 and p > 10 then least(case when ds > 0 then 0.68 else 0.48 end, ceil) else least(0.56, ceil) end"""
LIFE = f"""snap as (select trend_id, (created_at::date - date '2024-01-01') * {24 // HOURS} + hour(created_at) // {HOURS} as slot, count(*) as n, sum(least(cents, 10000)) / (count(*) * 10000) as m from sig group by 1, 2),
s1 as (select *, slot // {24 // HOURS} as day, lag(m) over w as pm, n - lag(n) over w as ds, {HOURS} * (slot - lag(slot) over w) as gap, row_number() over w as seen, lag(slot // {24 // HOURS}) over w as pday from snap window w as (partition by trend_id order by slot)),
s2 as (select *, pm is not null and gap >= 12 and pm >= 0.01 as comparable, sum(case when pday is null or pday <> day then 1 else 0 end) over (partition by trend_id order by slot rows unbounded preceding) as days from s1),
s3 as (select *, case when comparable then (m - pm) / pm * 100 end as p, least(case when seen < 3 then 0.7 else 1 end, case when days < 2 then 0.6 else 1 end) as ceil from s2),
hist as (select trend_id, slot, n, m, gap, comparable, p, ds, seen, days, {STAGES} as stage, ({SURE})::double as conf, case when comparable then round(0.7 * greatest(-1, least(1, p / 100)) + 0.3 * greatest(-1, least(1, ds / 10)), 6) end::double as accel from s3)"""
DEMANDED = q("(?i)" + "|".join(X.DEMAND))
ACTIONS = {"migration": (["migrat"], 1.0), "self_hosted": (["alternative", "self-host", "self host", "hosted", "cloud", "saas", "managed"], 1.0), "sdk": (["library", "sdk", "package", "framework"], 0.8)}
has = lambda words: "bool_or(" + " or ".join(f"contains(lower(title), {q(w)})" for w in words) + ")"
STATE = f"""{LIFE}, agg as (select trend_id, count(*) as signals, count(distinct source) as sources, count(distinct title) as artifacts, count_if(regexp_matches(title, {DEMANDED})) as demand, count_if(regexp_matches(title, {q('(?i)' + M.AUDIENCE_PAIN)})) as pains,
  {', '.join(f'{has(w)} as a_{k}' for k, (w, _) in ACTIONS.items())} from sig group by trend_id),
st0 as (select *, row_number() over (partition by trend_id order by slot desc) = 1 as newest from hist),
st1 as (select * from (select * from st0 where newest) join agg using (trend_id)),
st2 as (select *, {' + '.join(f'a_{k}::int' for k in ACTIONS)} as n_actions, (demand / signals) * (demand / signals) as density, case when artifacts >= 3 then 0.3 when artifacts >= 2 then 0.15 else 0 end + case when sources >= 3 then 0.2 when sources >= 2 then 0.1 else 0 end
  + case when demand >= 3 then 0.2 when demand >= 1 then 0.1 else 0 end + case when days >= 5 and conf >= 0.6 and comparable then 0.3 when days >= 3 and conf >= 0.5 then 0.15 else 0 end as hypo from st1),
state as (select *, case when n_actions = 0 then 0 else 0.6 * greatest({', '.join(f'a_{k}::int * {v}' for k, (_, v) in ACTIONS.items())}) + 0.4 * ({' + '.join(f'a_{k}::int * {v}' for k, (_, v) in ACTIONS.items())}) / n_actions end as action,
  case when comparable and accel > 0 then 0.4 * least(m / 0.5, 1) + 0.3 * least(accel / 2, 1) + 0.3 * conf else 0.55 * least(m / 0.5, 1) + 0.45 * conf end as quality from st2)"""


def history(spark, d):
    """Every snapshot of a trend with its change, stage, confidence and acceleration.

    Comparable: not the first, 12 hours or more after the one before, whose momentum was
    .01 or more. Under 24 hours the band in which a momentum counts as flat is half as wide.
    """
    s = signals(spark, d)
    slot = F.date_diff(F.to_date("created_at"), F.lit("2024-01-01").cast("date")) * (24 // HOURS) + F.floor(F.hour("created_at") / HOURS).cast("int")
    t = s.groupBy("trend_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.least("cents", F.lit(10000))) / (F.count(F.lit(1)) * 10000)).alias("m"))
    w = W.partitionBy("trend_id").orderBy("slot")
    day = F.floor(F.col("slot") / (24 // HOURS))
    t = t.withColumns({"day": day, "pm": F.lag("m").over(w), "ds": F.col("n") - F.lag("n").over(w), "gap": HOURS * (F.col("slot") - F.lag("slot").over(w)), "seen": F.row_number().over(w), "pday": F.lag(day).over(w)})
    new_day = F.when(F.col("pday").isNull() | (F.col("pday") != F.col("day")), 1).otherwise(0)
    first, m = F.col("pm").isNull(), F.col("m")
    t = t.withColumns({"comparable": ~first & (F.col("gap") >= 12) & (F.col("pm") >= 0.01), "days": F.sum(new_day).over(w.rowsBetween(W.unboundedPreceding, 0))})
    t = t.withColumns({"p": F.when(F.col("comparable"), (m - F.col("pm")) / F.col("pm") * 100), "ceil": F.least(F.when(F.col("seen") < 3, 0.7).otherwise(1.0), F.when(F.col("days") < 2, 0.6).otherwise(1.0))})
    p, ds, ceil = F.col("p"), F.col("ds"), F.col("ceil")
    rules = [
        (first, "emerging", F.least(F.lit(0.9), ceil)),
        (~F.col("comparable"), "stable", F.lit(0.5)),
        ((m >= 0.5) & (F.abs(p) <= F.when(F.col("gap") < 24, 5).otherwise(10)), "peaking", F.least(F.lit(0.76), ceil)),
        ((p > 20) & (m >= 0.3), "rising", F.least(F.lit(0.76), ceil)),
        ((p < -20) & (m >= 0.3), "declining", F.least(F.lit(0.72), ceil)),
        ((m < 0.3) & (p < -10), "fading", F.least(F.when(ds < 0, 0.72).otherwise(0.56), ceil)),
        ((m < 0.3) & (p > 10), "emerging", F.least(F.when(ds > 0, 0.68).otherwise(0.48), ceil)),
    ]
    stage, sure = F.lit("stable"), F.least(F.lit(0.56), ceil)
    for when, name, c in reversed(rules):
        stage, sure = F.when(when, name).otherwise(stage), F.when(when, c).otherwise(sure)
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return t.withColumns({"stage": stage, "conf": sure, "accel": F.when(F.col("comparable"), F.round(0.7 * clamp(p / 100) + 0.3 * clamp(ds / 10), 6))})


def state(spark, d):
    """A row for each trend: its newest snapshot, what its signals show, and the scores that rules share."""
    title = F.col("title")
    told = {k: F.bool_or(M.hits(F.lower(title), words) > 0).alias(f"a_{k}") for k, (words, _) in ACTIONS.items()}
    agg = signals(spark, d).groupBy("trend_id").agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct("title").alias("artifacts"),
        F.count_if(title.rlike("(?i)" + "|".join(X.DEMAND))).alias("demand"),
        F.count_if(title.rlike("(?i)" + M.AUDIENCE_PAIN)).alias("pains"),
        *told.values(),
    )
    t = rows.latest(history(spark, d), "slot", ["trend_id"]).join(agg, "trend_id")
    step = lambda c, hi, a, lo, b: F.when(F.col(c) >= hi, a).when(F.col(c) >= lo, b).otherwise(0.0)
    past = F.when((F.col("days") >= 5) & (F.col("conf") >= 0.6) & F.col("comparable"), 0.3).when((F.col("days") >= 3) & (F.col("conf") >= 0.5), 0.15).otherwise(0.0)
    each = [F.col(f"a_{k}").cast("int") * v for k, (_, v) in ACTIONS.items()]
    n_actions = sum((F.col(f"a_{k}").cast("int") for k in ACTIONS), F.lit(0))
    share = F.col("demand") / F.col("signals")
    t = t.withColumns({"n_actions": n_actions, "density": share * share, "hypo": step("artifacts", 3, 0.3, 2, 0.15) + step("sources", 3, 0.2, 2, 0.1) + step("demand", 3, 0.2, 1, 0.1) + past})
    action = F.when(F.col("n_actions") == 0, 0.0).otherwise(0.6 * F.greatest(*each) + 0.4 * sum(each[1:], each[0]) / F.col("n_actions"))
    near = F.least(F.col("m") / 0.5, F.lit(1.0))
    fast = 0.4 * near + 0.3 * F.least(F.col("accel") / 2, F.lit(1.0)) + 0.3 * F.col("conf")
    return t.withColumns({"action": action, "quality": F.when(F.col("comparable") & (F.col("accel") > 0), fast).otherwise(0.55 * near + 0.45 * F.col("conf"))})


@query("d08_lifecycle_rules", sql("select trend_id, slot, days, comparable, stage, conf, accel from hist", LIFE))
def d08(spark, d):
    return history(spark, d).select("trend_id", "slot", "days", "comparable", "stage", "conf", "accel")


@query("d13_hypothesis_score", sql("select trend_id, round(hypo, 6)::double as confidence, case when hypo < 0.5 or demand = 0 then 'uncertain' else 'supported' end as status from state", STATE))
def d13(spark, d):
    return state(spark, d).select("trend_id", F.round("hypo", 6).alias("confidence"), F.when((F.round("hypo", 6) < 0.5) | (F.col("demand") == 0), "uncertain").otherwise("supported").alias("status"))


@query("d14_model_gate", sql("select trend_id, artifacts >= 2 and not (sources = 1 and demand = 0) and (demand >= 1 or pains >= 2) as asks from state", STATE))
def d14(spark, d):
    c = F.col
    return state(spark, d).select("trend_id", ((c("artifacts") >= 2) & ~((c("sources") == 1) & (c("demand") == 0)) & ((c("demand") >= 1) | (c("pains") >= 2))).alias("asks"))


#: Gates in order, each with its test in SQL and in Spark.
GATES = [
    ("persistence", "days >= 2 or coalesce(p > 100 and gap <= 24, false)", lambda c: (c("days") >= 2) | F.coalesce((c("p") > 100) & (c("gap") <= 24), F.lit(False))),
    ("artifacts", "artifacts >= 2", lambda c: c("artifacts") >= 2),
    ("hypothesis", "hypo >= 0.1", lambda c: c("hypo") >= 0.1),
    ("confidence", "conf >= 0.6", lambda c: c("conf") >= 0.6),
    ("demand", "demand >= 1", lambda c: c("demand") >= 1),
    ("actionability", "n_actions >= 1", lambda c: c("n_actions") >= 1),
]


@query("d10_gate_log", sql(f"""select trend_id, k as place, name as gate, passed from (select trend_id, k, name, passed, coalesce(bool_and(passed) over (partition by trend_id order by k rows between unbounded preceding and 1 preceding), true) as asked from (
  {' union all '.join(f"select trend_id, {k} as k, {q(n)} as name, {test} as passed from state" for k, (n, test, _) in enumerate(GATES))})) where asked""", STATE))
def d10(spark, d):
    t = state(spark, d)
    tests = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("gate"), f(F.col).alias("passed")) for k, (n, _, f) in enumerate(GATES)])
    first = F.coalesce(F.array_min(F.transform(F.filter("g", lambda x: ~x["passed"]), lambda x: x["place"])), F.lit(len(GATES)))
    t = t.select("trend_id", tests.alias("g"))
    return t.select("trend_id", F.explode(F.slice("g", F.lit(1), first + 1)).alias("x")).select("trend_id", "x.*")


SCORE = "0.5 * quality + 0.3 * least(demand / 3, 1) + 0.2 * action"


def score():
    return 0.5 * F.col("quality") + 0.3 * F.least(F.col("demand") / 3, F.lit(1.0)) + 0.2 * F.col("action")


@query("d11_opportunity_quality", sql(f"select trend_id, round(quality, 6)::double as quality, round(action, 6)::double as action, round({SCORE}, 6)::double as score from state", STATE))
def d11(spark, d):
    return state(spark, d).select("trend_id", F.round("quality", 6).alias("quality"), F.round("action", 6).alias("action"), F.round(score(), 6).alias("score"))


#: Clamped and rounded; the small addend keeps halves from being rounded differently by different engines.
CLAMP = "round(greatest(0.05, least(0.95, {})) + 1e-9, 3)::double"


def clamped(c):
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), c)) + 1e-9, 3)


@query("d24_will_qualify", sql(f"""select trend_id, {CLAMP.format('''0.5 + case when m >= 0.7 then 0.15 when m >= 0.5 then 0.08 when m < 0.3 then -0.10 else 0 end + case when signals >= 5 then 0.10 when signals >= 3 then 0.05 else 0 end
  + case when stage in ('rising', 'peaking') then 0.08 when stage in ('fading', 'declining') then -0.12 else 0 end + case when sources / 5 >= 0.5 then 0.08 when sources / 5 < 0.2 then -0.05 else 0 end''')} as confidence, 0.25::double as half_width from state""", STATE))
def d24a(spark, d):
    c = F.col
    v = 0.5 + F.when(c("m") >= 0.7, 0.15).when(c("m") >= 0.5, 0.08).when(c("m") < 0.3, -0.10).otherwise(0.0) + F.when(c("signals") >= 5, 0.10).when(c("signals") >= 3, 0.05).otherwise(0.0)
    v = v + F.when(c("stage").isin("rising", "peaking"), 0.08).when(c("stage").isin("fading", "declining"), -0.12).otherwise(0.0) + F.when(c("sources") / 5 >= 0.5, 0.08).when(c("sources") / 5 < 0.2, -0.05).otherwise(0.0)
    return state(spark, d).select("trend_id", clamped(v).alias("confidence"), F.lit(0.25).alias("half_width"))


@query("d24_will_be_started", sql(f"select trend_id, {CLAMP.format(f'0.4 + case when {SCORE} >= 0.7 then 0.20 when {SCORE} >= 0.5 then 0.10 else 0 end + case when n_actions >= 3 then 0.08 else 0 end')} as confidence, 0.3::double as half_width from state", STATE))
def d24b(spark, d):
    v = 0.4 + F.when(score() >= 0.7, 0.20).when(score() >= 0.5, 0.10).otherwise(0.0) + F.when(F.col("n_actions") >= 3, 0.08).otherwise(0.0)
    return state(spark, d).select("trend_id", clamped(v).alias("confidence"), F.lit(0.3).alias("half_width"))


# Completion by archetype.
BASES = {"fast_mvp": 0.55, "proven_winner": 0.50, "content_wedge": 0.45, "infra_bet": 0.30, "execution_trap": 0.15}
BASE = "case " + " ".join(f"when {ARCH} = {q(k)} then {v}" for k, v in BASES.items()) + " else 0.35 end"
HARD = "case when p % 10 >= 7 then 0.8 when p % 10 <= 3 then 1.1 else 1 end"


@query("d24_will_be_completed", f"with {OUT} select p, {CLAMP.format(f'(case when starts >= 5 then 0.3 * {BASE} + 0.7 * cr else {BASE} end) * {HARD}')} as confidence, case when starts >= 10 then 0.15 else 0.25 end::double as half_width from oo")
def d24c(spark, d):
    arch = S.archetype(F.col("starts"), F.col("cr"), F.col("q"), F.col("days"))
    base = M.lookup(BASES, F.coalesce(arch, F.lit("")), 0.35)
    v = F.when(F.col("starts") >= 5, 0.3 * base + 0.7 * F.col("cr")).otherwise(base) * F.when(F.col("p") % 10 >= 7, 0.8).when(F.col("p") % 10 <= 3, 1.1).otherwise(1.0)
    return part_outcomes(spark, d).select("p", clamped(v).alias("confidence"), F.when(F.col("starts") >= 10, 0.15).otherwise(0.25).alias("half_width"))


@query("d24_will_succeed", f"with {OUT} select p, {CLAMP.format(f'''(case when done >= 3 then 0.3 * 0.6 + 0.7 * least(q / 5, 1) else 0.6 end) + case when {ARCH} = 'proven_winner' then 0.15 when {ARCH} = 'execution_trap' then -0.20 else 0 end''')} as confidence, 0.2::double as half_width from oo")
def d24d(spark, d):
    arch = F.coalesce(S.archetype(F.col("starts"), F.col("cr"), F.col("q"), F.col("days")), F.lit(""))
    v = F.when(F.col("done") >= 3, 0.3 * 0.6 + 0.7 * F.least(F.col("q") / 5, F.lit(1.0))).otherwise(0.6) + F.when(arch == "proven_winner", 0.15).when(arch == "execution_trap", -0.20).otherwise(0.0)
    return part_outcomes(spark, d).select("p", clamped(v).alias("confidence"), F.lit(0.2).alias("half_width"))


GROW = "(p / 100)"
PROB = f"""round(greatest(0, least(1, 0.3 + coalesce(case when {GROW} > 1 then 0.3 when {GROW} > 0.5 then 0.2 when {GROW} > 0.1 then 0.1 when {GROW} < -0.3 then -0.15 else 0 end, 0) + coalesce(case when accel > 0.2 then 0.15 when accel < -0.2 then -0.1 else 0 end, 0)
  + case when sources >= 4 then 0.15 when sources >= 2 then 0.08 else 0 end + case when density > 0.3 then 0.15 when density > 0.1 then 0.08 else 0 end + case when pains >= 5 then 0.1 when pains >= 2 then 0.05 else 0 end
  + case when stage = 'emerging' and days <= 5 then 0.1 when stage = 'rising' then 0.1 when stage = 'peaking' then 0.05 when stage in ('declining', 'fading') then -0.1 else 0 end + case when m > 0.7 then 0.1 else 0 end)), 4)::double"""


@query("d27_growth_prediction_rules", sql(f"""select trend_id, prob, case when prob > 0.7 and sources >= 3 and coalesce({GROW} > 0.8, false) then 'breakout' when coalesce({GROW} > 1.5, false) and sources >= 3 then 'breakout' when coalesce({GROW} > 0.5, false) and coalesce(accel >= 0, true) then 'accelerating' when coalesce({GROW} < -0.2, false) then 'declining' else 'steady' end as direction,
  case when seen >= 5 and conf >= 0.6 then 'high' when seen >= 3 or conf >= 0.4 then 'medium' else 'low' end as level, array_to_string(list_filter([case when coalesce(abs({GROW}) > 0.1, false) then 'growth' end, case when coalesce(abs(accel) > 0.2, false) then 'acceleration' end, case when sources >= 2 then 'sources' end,
  case when density > 0.1 then 'demand' end, case when pains >= 2 then 'pain' end, case when m > 0.7 then 'momentum' end], lambda x: x is not null), ',') as reasons from (select *, {PROB} as prob from state)""", STATE))
def d27(spark, d):
    c, g = F.col, F.col("p") / 100
    v = 0.3 + F.coalesce(F.when(g > 1, 0.3).when(g > 0.5, 0.2).when(g > 0.1, 0.1).when(g < -0.3, -0.15), F.lit(0.0)) + F.coalesce(F.when(c("accel") > 0.2, 0.15).when(c("accel") < -0.2, -0.1), F.lit(0.0))
    v = v + F.when(c("sources") >= 4, 0.15).when(c("sources") >= 2, 0.08).otherwise(0.0) + F.when(c("density") > 0.3, 0.15).when(c("density") > 0.1, 0.08).otherwise(0.0) + F.when(c("pains") >= 5, 0.1).when(c("pains") >= 2, 0.05).otherwise(0.0)
    v = v + F.when((c("stage") == "emerging") & (c("days") <= 5), 0.1).when(c("stage") == "rising", 0.1).when(c("stage") == "peaking", 0.05).when(c("stage").isin("declining", "fading"), -0.1).otherwise(0.0) + F.when(c("m") > 0.7, 0.1).otherwise(0.0)
    t = state(spark, d).withColumn("prob", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 4))
    over = lambda x: F.coalesce(g > x, F.lit(False))
    way = F.when((c("prob") > 0.7) & (c("sources") >= 3) & over(0.8), "breakout").when(over(1.5) & (c("sources") >= 3), "breakout").when(over(0.5) & F.coalesce(c("accel") >= 0, F.lit(True)), "accelerating").when(g < -0.2, "declining").otherwise("steady")
    level = F.when((c("seen") >= 5) & (c("conf") >= 0.6), "high").when((c("seen") >= 3) | (c("conf") >= 0.4), "medium").otherwise("low")
    why = F.array(F.when(F.abs(g) > 0.1, "growth"), F.when(F.abs("accel") > 0.2, "acceleration"), F.when(c("sources") >= 2, "sources"), F.when(c("density") > 0.1, "demand"), F.when(c("pains") >= 2, "pain"), F.when(c("m") > 0.7, "momentum"))
    return t.select("trend_id", "prob", way.alias("direction"), level.alias("level"), F.array_join(F.array_compact(why), ",").alias("reasons"))


@query("d28_alert_rules", sql("""select trend_id, slot, unnest(list_filter([case when stage = 'rising' and coalesce(ps <> 'rising', true) and conf >= 0.7 and comparable then 'entered_early_edge' end, case when conf - coalesce(pc, 0) >= 0.15 and conf >= 0.7 then 'confidence_upgraded' end,
  case when coalesce(p > 50, false) and conf >= 0.7 and comparable then 'momentum_breakout' end, case when seen < 3 or days < 2 then 'timing_uncertain' end, case when m >= 0.3 and conf >= 0.5 and not coalesce(pm2 >= 0.3 and pc >= 0.5, false) then 'became_eligible' end, case when ps is not null and ps <> stage then 'stage_transition' end,
  case when n >= 3 and coalesce(pn < 3, true) and conf >= 0.6 then 'entered_crowded_zone' end, case when coalesce(n - pn >= 2, false) and conf >= 0.6 then 'crowding_increasing' end], lambda x: x is not null)) as alert
  from (select *, lag(stage) over w as ps, lag(conf) over w as pc, lag(m) over w as pm2, lag(n) over w as pn from hist window w as (partition by trend_id order by slot))""", LIFE))
def d28(spark, d):
    w = W.partitionBy("trend_id").orderBy("slot")
    t = history(spark, d).withColumns({"ps": F.lag("stage").over(w), "pc": F.lag("conf").over(w), "pm2": F.lag("m").over(w), "pn": F.lag("n").over(w)})
    c, no = F.col, lambda x, y: F.coalesce(x, F.lit(y))
    fired = F.array(
        F.when((c("stage") == "rising") & no(c("ps") != "rising", True) & (c("conf") >= 0.7) & c("comparable"), "entered_early_edge"),
        F.when((c("conf") - no(c("pc"), 0.0) >= 0.15) & (c("conf") >= 0.7), "confidence_upgraded"),
        F.when(no(c("p") > 50, False) & (c("conf") >= 0.7) & c("comparable"), "momentum_breakout"),
        F.when((c("seen") < 3) | (c("days") < 2), "timing_uncertain"),
        F.when((c("m") >= 0.3) & (c("conf") >= 0.5) & ~no((c("pm2") >= 0.3) & (c("pc") >= 0.5), False), "became_eligible"),
        F.when(c("ps").isNotNull() & (c("ps") != c("stage")), "stage_transition"),
        F.when((c("n") >= 3) & no(c("pn") < 3, True) & (c("conf") >= 0.6), "entered_crowded_zone"),
        F.when(no(c("n") - c("pn") >= 2, False) & (c("conf") >= 0.6), "crowding_increasing"),
    )
    return t.select("trend_id", "slot", F.explode(F.array_compact(fired)).alias("alert"))


WHY = "case tl " + " ".join(f"when {q(k)} then {q(v)}" for k, v in M.TIMING.items()) + " end"


@query("d59_brief_response", sql(f"""select trend_id, stage, round(conf, 3)::double as stage_confidence, round(m, 6) as momentum, round(peak, 6) as peak_momentum, n as signal_count, total, first::int as first_slot,
  array_to_string(list_filter([{WHY}, case when stage = 'rising' then 'Momentum is accelerating — signal volume is increasing.' end], lambda x: x is not null), ' ') as why_now, breakdown from (select *, case when days < 2 or seen < 3 then 'too_early' when n > 3 and coalesce(p < 0, false) then 'crowded' when m >= 0.3 and coalesce(p > 0, false) then 'early_edge' when m >= 0.4 then 'late_but_monetizable' else 'too_early' end as tl from state)
  join (select trend_id, max(m) as peak, min(slot) as first, count(*) as total from hist group by 1) using (trend_id) join (select trend_id, string_agg(source || ':' || k::varchar, ',' order by source) as breakdown from (select trend_id, source, count(*) as k from sig group by 1, 2) group by 1) using (trend_id)""", STATE))
def d59(spark, d):
    c = F.col
    label = F.when((c("days") < 2) | (c("seen") < 3), "too_early").when((c("n") > 3) & F.coalesce(c("p") < 0, F.lit(False)), "crowded").when((c("m") >= 0.3) & F.coalesce(c("p") > 0, F.lit(False)), "early_edge").when(c("m") >= 0.4, "late_but_monetizable").otherwise("too_early")
    past = history(spark, d).groupBy("trend_id").agg(F.max("m").alias("peak"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("total"))
    of = signals(spark, d).groupBy("trend_id", "source").agg(F.count(F.lit(1)).alias("k")).groupBy("trend_id")
    of = of.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", F.col("k").cast("string")))), ",").alias("breakdown"))
    why = F.array(M.lookup(M.TIMING, label, ""), F.when(c("stage") == "rising", "Momentum is accelerating — signal volume is increasing."))
    t = state(spark, d).join(past, "trend_id").join(of, "trend_id")
    return t.select("trend_id", "stage", F.round("conf", 3).alias("stage_confidence"), F.round("m", 6).alias("momentum"), F.round("peak", 6).alias("peak_momentum"), F.col("n").alias("signal_count"), "total", "first_slot", F.array_join(F.array_compact(why), " ").alias("why_now"), "breakdown")


FACTORS = """list_filter([case when cr >= 0.6 then 'High completion rate (' || floor(cr * 100)::int::varchar || '%)' when cr >= 0.4 then 'Moderate completion rate (' || floor(cr * 100)::int::varchar || '%)' when cr < 0.2 then 'Low completion rate (' || floor(cr * 100)::int::varchar || '%)' end,
  case when q >= 4 then 'High quality outcomes' when q >= 3 then 'Good quality outcomes' when q > 0 and q < 2 then 'Low quality outcomes' end, case when starts >= 10 then 'High sample size (' || starts::varchar || ' users)' when starts >= 5 then 'Moderate sample (' || starts::varchar || ' users)' end], lambda x: x is not null)"""


@query("d50_outcome_factors", f"""with {OUT}, f as (select p, {FACTORS} as f, case when cr >= 0.6 then 0.10 when cr >= 0.4 then 0.05 when cr < 0.2 then -0.15 else 0 end + case when q >= 4 then 0.10 when q >= 3 then 0.05 when q > 0 and q < 2 then -0.10 else 0 end + case when starts >= 10 then 0.05 when starts >= 5 then 0.02 else 0 end as m from oo where starts >= 3)
  select p, array_to_string(list_transform(f, lambda x: case when contains(lower(x), 'boost') or round(m, 6) > 0.1 then 'boost: ' when contains(lower(x), 'caution') or contains(lower(x), 'low') or contains(lower(x), 'concern') then 'warning: ' else 'info: ' end || x), '; ') as factors from f""")
def d50(spark, d):
    cr, qual, n = F.col("cr"), F.col("q"), F.col("starts")
    rate = lambda word: F.concat(F.lit(f"{word} completion rate ("), F.floor(cr * 100).cast("int").cast("string"), F.lit("%)"))
    people = lambda word: F.concat(F.lit(f"{word} ("), n.cast("string"), F.lit(" users)"))
    told = F.array_compact(F.array(F.when(cr >= 0.6, rate("High")).when(cr >= 0.4, rate("Moderate")).when(cr < 0.2, rate("Low")), F.when(qual >= 4, "High quality outcomes").when(qual >= 3, "Good quality outcomes").when((qual > 0) & (qual < 2), "Low quality outcomes"), F.when(n >= 10, people("High sample size")).when(n >= 5, people("Moderate sample"))))
    t = part_outcomes(spark, d).filter("starts >= 3").withColumns({"f": told, "m": F.round(S.outcome_modifier(n, cr, qual), 6)})
    kind = lambda x: F.when(F.lower(x).contains("boost") | (F.col("m") > 0.1), "boost: ").when(F.lower(x).rlike("caution|low|concern"), "warning: ").otherwise("info: ")
    return t.select("p", F.array_join(F.transform("f", lambda x: F.concat(kind(x), x)), "; ").alias("factors"))

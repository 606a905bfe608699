"""Predictions made at every snapshot of a trend, resolved by later snapshots, and calibrated by what was resolved by then."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators import calibration
from sigmill.plans import state as T
from sigmill.registry import query
from sigmill.sources.tables import signals, sql

#: Snapshots after which a prediction is held against what came.
AHEAD = 3
KINDS = ("will_qualify", "will_be_started", "will_be_completed")
SLOT = f"(created_at::date - date '2024-01-01') * {24 // T.HOURS} + hour(created_at) // {T.HOURS}"
# raw confidences, each as (constant part and rules, half of the interval)
RAW = {
    "will_qualify": ("0.5 + case when m >= 0.7 then 0.15 when m >= 0.5 then 0.08 when m < 0.3 then -0.10 else 0.0 end + case when signals >= 5 then 0.10 when signals >= 3 then 0.05 else 0.0 end + case when stage in ('rising', 'peaking') then 0.08 when stage in ('fading', 'declining') then -0.12 else 0.0 end", "0.25"),
    "will_be_started": ("case when views >= 10 then 0.3 * (0.4 + case when m >= 0.7 then 0.20 when m >= 0.5 then 0.10 else 0.0 end) + 0.7 * least(starts / views, 1.0) else 0.4 + case when m >= 0.7 then 0.20 when m >= 0.5 then 0.10 else 0.0 end end", "case when views >= 10 then 0.2 else 0.3 end"),
    "will_be_completed": ("case when starts >= 5 then 0.3 * 0.35 + 0.7 * least(done / starts, 1.0) else 0.35 end", "case when starts >= 10 then 0.15 else 0.25 end"),
}
#: What came true of each kind within the next snapshots; null is not resolved.
CAME = {"will_qualify": "qualified_then", "will_be_started": "starts_then > starts", "will_be_completed": "case when starts_then > 0 then done_then > done end"}
PRED = f"""moves as (select trend_id, {SLOT} as slot, count_if(source in ('view', 'click')) as v, count_if(source = 'signup') as s, count_if(source = 'purchase') as d from sig group by 1, 2),
life as (select trend_id, slot, m, stage, (days >= 2 or coalesce(p > 100 and gap <= 24, false)) and conf >= 0.6 and m >= 0.3 as qualified, sum(n) over w as signals, sum(v) over w as views, sum(s) over w as starts, sum(d) over w as done from hist join moves using (trend_id, slot) window w as (partition by trend_id order by slot rows unbounded preceding)),
ahead as (select *, lead(slot, {AHEAD}) over w as then_slot, lead(qualified, {AHEAD}) over w as qualified_then, lead(starts, {AHEAD}) over w as starts_then, lead(done, {AHEAD}) over w as done_then from life window w as (partition by trend_id order by slot)),
pred as ({' union all '.join(f"select trend_id, '{k}' as kind, slot as made_at, round(greatest(0.05, least(0.95, {RAW[k][0]})) + 1e-9, 3)::double as raw, ({RAW[k][1]})::double as half_width, case when ({CAME[k]}) is not null then then_slot end as resolved_at, ({CAME[k]}) as actual from ahead" for k in KINDS)})"""
BIN = "least(floor(raw * 10 + 1e-9), 9)::int"
#: What was known of each kind, bin and time, by comparing every such time with every resolved count before it.
KNOWN = f"""asked as (select distinct kind, {BIN} as bin, made_at from pred),
done as (select kind, {BIN} as bin, resolved_at as time, count(*) as c, count_if(actual) as h from pred where resolved_at is not null group by 1, 2, 3),
known as (select a.kind, a.bin, a.made_at, coalesce(sum(c) filter (where d.bin = a.bin), 0)::bigint as n, coalesce(sum(h) filter (where d.bin = a.bin), 0)::bigint as hits, coalesce(sum(c), 0)::bigint as total from asked a left join done d on d.kind = a.kind and d.time < a.made_at group by 1, 2, 3)"""
TIMES = "floor((40000 * hits + n * (2 * bin + 1)) / (2 * n * (2 * bin + 1))) / 1000"


def predictions(spark, d):
    """(trend_id, kind, made_at, raw, half_width, resolved_at, actual): three predictions at every snapshot of a trend.

    They know what the trend has shown up to their snapshot. The third snapshot after it resolves them: the trend passes the gates then, was taken up
    in between, was completed in between if it has been taken up at all. Trends without such a snapshot stay unresolved.
    """
    s = signals(spark, d)
    slot = F.date_diff(F.to_date("created_at"), F.lit("2024-01-01").cast("date")) * (24 // T.HOURS) + F.floor(F.hour("created_at") / T.HOURS).cast("int")
    source = F.col("source")
    moves = s.groupBy("trend_id", slot.alias("slot")).agg(F.count_if(source.isin("view", "click")).alias("v"), F.count_if(source == "signup").alias("s"), F.count_if(source == "purchase").alias("d"))
    t = T.history(spark, d).join(moves, ["trend_id", "slot"])
    c, order = F.col, W.partitionBy("trend_id").orderBy("slot")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    qualified = ((c("days") >= 2) | F.coalesce((c("p") > 100) & (c("gap") <= 24), F.lit(False))) & (c("conf") >= 0.6) & (c("m") >= 0.3)
    t = t.select("trend_id", "slot", "m", "stage", qualified.alias("qualified"), *[F.sum(x).over(upto).alias(y) for x, y in (("n", "signals"), ("v", "views"), ("s", "starts"), ("d", "done"))])
    t = t.withColumns({"then_slot": F.lead("slot", AHEAD).over(order), **{f"{x}_then": F.lead(x, AHEAD).over(order) for x in ("qualified", "starts", "done")}})

    def told(k: str) -> Column:
        came = F.expr(CAME[k])
        raw = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.expr(RAW[k][0]).cast("double"))) + 1e-9, 3)
        return F.struct(F.lit(k).alias("kind"), raw.alias("raw"), F.expr(RAW[k][1]).cast("double").alias("half_width"), F.when(came.isNotNull(), c("then_slot")).alias("resolved_at"), came.alias("actual"))

    return t.select("trend_id", c("slot").alias("made_at"), F.explode(F.array(*map(told, KINDS))).alias("x")).select("trend_id", "made_at", "x.*")


@query("d26_predictions_resolved_later", sql("select trend_id, kind, made_at, raw, half_width, resolved_at, actual from pred", T.LIFE, PRED))
def d26(spark, d):
    return predictions(spark, d)


@query("a22_adjustments_as_known", sql(f"select kind, bin, made_at, n, hits, total, case when total >= {calibration.LEAST} and n >= {calibration.LEAST_IN_BIN} then {TIMES} end::double as multiplier from known", T.LIFE, PRED, KNOWN))
def a22(spark, d):
    t = calibration.known_by(predictions(spark, d))
    enough = (F.col("total") >= calibration.LEAST) & (F.col("n") >= calibration.LEAST_IN_BIN)
    return t.withColumn("multiplier", F.when(enough, calibration.multiplier(F.col("n"), F.col("hits"), F.col("bin"))))


@query("d25_calibrated_as_known", sql(f"""select trend_id, kind, made_at, raw, multiplier, round(sure, 6)::double as confidence, round(greatest(0, (raw - half_width) * sure / raw) + 1e-9, 3)::double as low, round(least(1, (raw + half_width) * sure / raw) + 1e-9, 3)::double as high, round(sure, 6) >= 0.5 as predicted from
  (select *, case when multiplier is null then raw else greatest(0.01, least(0.99, raw * multiplier)) end as sure from (select p.*, case when total >= {calibration.LEAST} and n >= {calibration.LEAST_IN_BIN} then {TIMES} end::double as multiplier from (select *, {BIN} as bin from pred) p join known using (kind, bin, made_at)))""", T.LIFE, PRED, KNOWN))
def d25(spark, d):
    return calibration.calibrated(predictions(spark, d)).select("trend_id", "kind", "made_at", "raw", "multiplier", "confidence", "low", "high", "predicted")

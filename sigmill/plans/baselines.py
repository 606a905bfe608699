"""Baselines by snapshot, in batch and over a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.operators import baselines
from sigmill.registry import query
from sigmill.sources.tables import signals, sql
from sigmill.streaming import signals as R

HOURS, DAYS = 8, 14
# 90th percentiles known beforehand, by source.
BOOTSTRAP = {"hackernews": 426, "github": 1690, "devto": 92, "reddit": 150, "producthunt": 300, "indiehackers": 50, "substack": 1}
#: Kinds of events stand for sources.
SOURCES = {"view": "hackernews", "click": "github", "signup": "devto", "error": "reddit"}
NAMED = f"case source {' '.join(f'''when '{k}' then '{v}' ''' for k, v in SOURCES.items())}else source end"
COUNTED = f"""one as (select {NAMED} as source, (created_at::date - date '2024-01-01') * {24 // HOURS} + hour(created_at) // {HOURS} as slot, cents // 100 + comments as value from sig),
b as (select source, slot, count(*) as n, list_sort(list(value))[(count(*) * 9) // 10 + 1] as p90 from one group by 1, 2),
r as (select b.source, b.slot, count(*) as span_n, list_sort(list(o.value))[(count(*) * 9) // 10 + 1] as span_p90 from b join one o on o.source = b.source and o.slot between b.slot - {DAYS * 24 // HOURS - 1} and b.slot group by 1, 2)"""


def engagement(spark, d):
    """(source, slot, value, c): how often a source had an engagement in a snapshot of eight hours."""
    slot = F.date_diff(F.to_date("created_at"), F.lit("2024-01-01").cast("date")) * (24 // HOURS) + F.floor(F.hour("created_at") / HOURS)
    value = F.expr("cents div 100") + F.col("comments")
    return signals(spark, d).select(F.expr(NAMED).alias("source"), slot.cast("int").alias("slot"), value.alias("value")).groupBy("source", "slot", "value").agg(F.count(F.lit(1)).alias("c"))


@query("m04_baseline_by_snapshot", sql(f"""select source, slot, case when n >= 20 then greatest(p90, 1) when span_n >= 60 then greatest(span_p90, 1) else case source {' '.join(f"when '{k}' then {v}" for k, v in BOOTSTRAP.items())} else 100 end end::bigint as p90,
  case when n >= 20 then n when span_n >= 60 then span_n else 0 end::bigint as sample_size, case when n >= 20 then 'batch_current' when span_n >= 60 then 'rolling_14d' else 'bootstrap' end as method from b join r using (source, slot)""", COUNTED))
def m04(spark, d):
    """Stored values are those of the batches here, so the median never comes in: three batches of 20 make a span of 60. A test has stored values of their own."""
    counted = engagement(spark, d)
    return baselines.chain(counted, baselines.p90_of_counts(counted, ["source", "slot"]), DAYS * 24 // HOURS, BOOTSTRAP)


@query("st3_rolling_p90", f"""with e as (select event_type as source, ts::date - date '2024-01-01' as slot, floor(value)::bigint as value from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 7 day)
  select s.source, s.slot::int as slot, count(*) as n, list_sort(list(e.value))[(count(*) * 9) // 10 + 1] as p90 from (select distinct source, slot from e) s join e on e.source = s.source and e.slot between s.slot - {DAYS - 1} and s.slot group by 1, 2""")
def st3(spark, d):
    """The stream keeps counts of the values of a day, and lets them go once the watermark has passed it; spans of 14 days are sums of these counts."""
    days = R.landed(R.daily_values(R.event_stream(spark, d)))
    return baselines.p90_of_counts(baselines.over_spans(days, DAYS), ["source", "slot"])

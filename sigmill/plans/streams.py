"""Structured Streaming queries, run over the input that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.registry import query
from sigmill.streaming import signals as R


@query("st1_change_feed", "select event_type, count(*) as n from events group by event_type")
def st1(spark, d):
    return R.finished(R.event_stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("st2_daily_window", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def st2(spark, d):
    return R.finished(R.daily_counts(R.event_stream(spark, d)), "complete")


@query("st3_rolling_window", """select strftime(e, '%Y-%m-%d') as day, count(*) as n from (select ts, unnest(generate_series(date_trunc('day', ts) + interval 1 day, date_trunc('day', ts) + interval 14 day, interval 1 day)) as e from events) group by 1""")
def st3(spark, d):
    return R.finished(R.rolling_counts(R.event_stream(spark, d)), "complete")


@query("st4_suppressed_alerts", "select distinct user_id, event_type from events")
def st4(spark, d):
    return R.landed(R.suppressed(R.event_stream(spark, d)))


@query("st5_failure_state", "select user_id, count(*) as total, count_if(event_type = 'error') as failures from events group by user_id")
def st5(spark, d):
    return R.landed(R.failure_state(R.event_stream(spark, d)))


@query("st6_closed_days", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 7 day group by 1, 2")
def st6(spark, d):
    return R.landed(R.closed_days(R.event_stream(spark, d)))


@query("st4_alerts_sent", f"""with recursive c as (select event_id, user_id, epoch_us(ts) // 1000 as s, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as k from events where event_type in ('purchase', 'error')),
  w(user_id, k, event_id, ms, sent) as (select user_id, k, event_id, s, s from c where k = 1 union all select c.user_id, c.k, case when c.s - w.sent >= {R.SILENCE} then c.event_id end, c.s, case when c.s - w.sent >= {R.SILENCE} then c.s else w.sent end from w join c on c.user_id = w.user_id and c.k = w.k + 1)
  select user_id, event_id, ms from w where event_id is not null and ms < (select max(s) from c) - {R.LATE}""")
def st4_sent(spark, d):
    """Purchases and errors as alerts, as a stream with state: those that the watermark has passed."""
    return R.landed(R.sent_alerts(R.event_stream(spark, d).filter(F.col("event_type").isin("purchase", "error"))))

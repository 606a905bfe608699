"""Rows a distance apart, as a batch and as a stream of several files, against the rule taken row by row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import spacing
from sigmill.sources.sinks import new_path
from sigmill.streaming import signals


def one_by_one(rows, gap):
    out, last = [], {}
    for k, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            out.append((k, t))
    return out


@pytest.mark.parametrize("gap", [1, 7, 100])
def test_spaced(spark, gap):
    rng = np.random.default_rng(gap)
    rows = [(None if k == 9 else int(k), int(t)) for k, t in zip(rng.integers(0, 10, 500) % 10, rng.integers(-50, 2000, 500))]
    rows += [(77, t) for t in range(0, 300, 3)] + [(78, 0), (78, gap), (78, 2 * gap - 1), (78, 10**6)] + rows[:20]
    df = spark.createDataFrame(rows + [(5, None)], "k long, t long").repartition(3)
    got = [(r.k, r.t) for r in spacing.spaced(df, "k", "t", gap).collect()]
    assert sorted(got, key=str) == sorted(one_by_one(rows, gap), key=str)
    assert spacing.spaced(df.limit(0), "k", "t", gap).count() == 0


BASE = dt.datetime(2024, 1, 1)
HOUR = 3600


def streamed(spark, files):
    """Sent alerts of files of (user, row, seconds), each a batch of its own, oldest file first."""
    path = new_path(spark, "alerts")
    for f in files:
        rows = [(u, r, None if s is None else BASE + dt.timedelta(seconds=s)) for u, r, s in f]
        spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    zero = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp())
    return sorted((r.user_id, r.event_id, r.ms // 1000 - zero) for r in signals.landed(signals.sent_alerts(stream)).collect())


def test_alerts_over_files_and_late_rows(spark):
    day = 24 * HOUR
    files = [
        [(1, 10, 100), (1, 11, 50), (2, 20, 1000), (3, 30, None)],
        [(1, 12, 40), (2, 21, 2000), (1, 13, 5 * HOUR)],  # row 12 is late by less than an hour, so it goes first
        [(1, 14, day), (1, 15, day + 40), (2, 22, 1001)],  # row 22 comes behind the watermark; 14 is too early, 15 is not
        [(1, 16, day + 41), (2, 23, day + 1000), (1, 17, 2 * day + 40)],
        [(9, 90, 4 * day)],
    ]
    assert streamed(spark, files) == [(1, 12, 40), (1, 15, day + 40), (1, 17, 2 * day + 40), (2, 20, 1000), (2, 23, day + 1000)]


def test_alerts_don_t_depend_on_files(spark):
    rng = np.random.default_rng(5)
    rows = sorted(((int(u), i, int(s)) for i, (u, s) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 20 * 24 * HOUR, 200)))), key=lambda r: r[2])
    rows.append((99, 999, 30 * 24 * HOUR))
    want, last = [], {}
    for u, i, s in rows[:-1]:
        if u not in last or s - last[u] >= 24 * HOUR:
            last[u] = s
            want.append((u, i, s))
    for n in (1, 4):
        cut = len(rows) // n + 1
        assert streamed(spark, [rows[k : k + cut] for k in range(0, len(rows), cut)]) == sorted(want)


@pytest.mark.parametrize("groups", [1, 3])
def test_alerts_of_keys_that_share_a_state(spark, groups):
    path, rng = new_path(spark, "alerts"), np.random.default_rng(groups)
    users = [None, 0, -4, 2**60 + 1, 7, 8]
    rows = sorted(((users[u], i, int(s)) for i, (u, s) in enumerate(zip(rng.integers(0, 6, 300), rng.integers(0, 30 * 24 * HOUR, 300)))), key=lambda r: r[2])
    want, last = [], {}
    for u, i, s in rows:
        if u not in last or s - last[u] >= 24 * HOUR:
            last[u] = s
            want.append((u, i))
    rows.append((99, 999, 60 * 24 * HOUR))
    for at in range(0, len(rows), 75):
        some = [(u, i, BASE + dt.timedelta(seconds=s)) for u, i, s in rows[at : at + 75]]
        spark.createDataFrame(some, "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = signals.landed(signals.sent_alerts(stream, groups=groups)).collect()
    assert sorted(((r.user_id, r.event_id) for r in got), key=str) == sorted(want, key=str)


def test_calls_of_a_stream_are_no_more_with_more_keys(spark):
    """Many keys take few groups, each of which costs a call in every batch."""
    path = new_path(spark, "alerts")
    spark.range(20_000).selectExpr("id as user_id", "id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 60) as ts").coalesce(1).write.parquet(path)
    out = signals.sent_alerts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    name = f"alerts{abs(hash(path))}"
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 1024


def test_counts_over_files(spark):
    path = new_path(spark, "counts")
    for k in range(3):
        spark.createDataFrame([(BASE + dt.timedelta(days=k), "a"), (BASE, "b")], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = signals.finished(stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    assert {(r.event_type, r.n) for r in got.collect()} == {("a", 3), ("b", 3)}

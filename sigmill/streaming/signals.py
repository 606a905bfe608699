"""Streaming forms: counts by window, suppression of repeats, failure streaks, from a folder of Parquet files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigmill.sources.sinks import new_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: each file is new input once."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", "7 days").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def rolling_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "14 days", "1 day")
    return events.withWatermark("ts", "7 days").groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.end", "yyyy-MM-dd").alias("day"), "n")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over the input that is there and returns its last whole result, which each batch writes into the shared folder under its number."""
    spark, last = stream.sparkSession, []
    path = new_path(spark, "stream")

    def write(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/{batch}")
        last[:] = [batch]

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(write).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def landed(stream: DataFrame) -> DataFrame:
    """Runs an append stream over the input that is there, into Parquet files in the shared folder, and reads them."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(path)


def suppressed(events: DataFrame) -> DataFrame:
    """One alert for each user and type within 24 hours: state is dropped behind the watermark."""
    return events.withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def closed_days(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Counts of the days that the watermark has passed; a day is told once and its state is gone."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def daily_values(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(source, slot, value, c): how often each whole value came on a day that the watermark has passed; state holds counts of open days alone."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type", F.floor("value").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    slot = F.date_diff(F.to_date("window.start"), F.lit("2024-01-01").cast("date"))
    return counts.select(F.col("event_type").alias("source"), slot.alias("slot"), "value", "c")


def failure_state(events: DataFrame) -> DataFrame:
    """Totals and failures of each user, carried over from batch to batch in state; a row for each user of a batch."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, failures = state.get if state.exists else (0, 0)
        for f in frames:
            total, failures = total + len(f), failures + int((f["event_type"] == "error").sum())
        state.update((total, failures))
        yield pd.DataFrame({"user_id": [key[0]], "total": [total], "failures": [failures]})

    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(count, "user_id long, total long, failures long", "total long, failures long", "append", GroupStateTimeout.NoTimeout)


#: Milliseconds for which a sent alert silences its key, and for which rows may come late.
SILENCE, LATE = 24 * 3600 * 1000, 3600 * 1000


#: Groups into which keys are dealt by hash, each with one state: a call for a group costs the same for one key as for hundreds. A stream keeps the number of its first run.
GROUPS = 1024


def sent_alerts(events: DataFrame, key: str = "user_id", row: str = "event_id", groups: int = GROUPS) -> DataFrame:
    """(key, row, at): alerts that are sent, each 24 hours or more behind the last that was sent of its key; suppressed ones don't count.

    Rows are decided in the order of their time (then ``row``) once the watermark, an hour behind the latest row, has passed them, so neither files nor their
    order matter; rows behind the watermark are dropped. A key's state is the time of the last sent alert and the rows that may still be
    sent: those within 24 hours of it are dropped at once; ``groups`` of keys hold theirs together. A timer decides rows of keys that get no more, and ends a key's state 24 hours after its last alert.
    Rows without key are one key.
    """

    def decide(g: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, lasts, keys, times, ids = state.get if state.exists else ([], [], [], [], [])
        last, open_ = dict(zip(told, lasts, strict=True)), list(zip(keys, times, ids, strict=True))
        for f in frames:
            open_ += zip(f["k"].tolist(), f["ms"].tolist(), f["row"].tolist(), strict=True)
        passed, sent, wait, first = state.getCurrentWatermarkMs(), [], [], {}
        for k, ms, r in sorted(open_):
            if k in last and ms - last[k] < SILENCE:
                continue
            if ms >= passed:
                wait.append((k, ms, r))
                first.setdefault(k, ms)
            else:
                last[k] = ms
                sent.append((k, ms, r))
        last = {k: ms for k, ms in last.items() if k in first or ms + SILENCE > passed}
        if not wait and not last:
            if state.exists:
                state.remove()
        else:
            state.update((list(last), list(last.values()), *(list(x) for x in (zip(*wait, strict=True) if wait else ([], [], [])))))
            due = min([*first.values(), *(ms + SILENCE for k, ms in last.items() if k not in first)])
            state.setTimeoutTimestamp(max(due, passed + 1))
        out = pd.DataFrame(sent, columns=["k", "ms", "row"]).astype("int64")
        yield out if g[0] >= 0 else out.assign(k=pd.Series([None] * len(out), dtype="Int64"))

    rows = events.withWatermark("ts", f"{LATE} milliseconds").select(F.col(key).cast("long").alias("k"), F.col(row).cast("long").alias("row"), F.floor(F.unix_micros("ts") / 1000).alias("ms"), "ts").filter("ms is not null")
    # rows without key are a group of their own, in which 0 stands for it
    rows = rows.withColumn("g", F.when(F.col("k").isNull(), -1).otherwise(F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int"))).fillna(0, ["k"])
    sent = rows.groupBy("g").applyInPandasWithState(decide, "k long, ms long, row long", "told array<long>, lasts array<long>, keys array<long>, times array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return sent.select(F.col("k").alias(key), F.col("row").alias(row), "ms")

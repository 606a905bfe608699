"""Baselines of engagement by counted values: counts of a snapshot add up to those of any span, so quantiles of spans need no rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows from which a batch, or the span behind it, stands for itself, and stored batches whose median stands in.
BATCH, SPAN, STORED = 20, 60, 3
#: Values that share these leading bits are counted together first.
LOW_BITS = 10


def p90_of_counts(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p90) of rows (keys, value, c): the value whose place, from 0, is the whole part of .9 n.

    Values are whole numbers. Counts by leading bits tell in which cut the place lies, and only the values of that cut are
    put in order, so a key's distinct values don't gather in one task; null values count for nothing.
    """
    t = counted.filter("value is not null").withColumn("cut", F.shiftright("value", LOW_BITS))
    cuts = t.groupBy(*keys, "cut").agg(F.sum("c").alias("c"))
    every, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("cut").rowsBetween(W.unboundedPreceding, 0)
    cuts = cuts.withColumns({"n": F.sum("c").over(every), "below": F.sum("c").over(upto) - F.col("c")}).withColumn("place", F.expr("9 * n div 10"))
    cuts = cuts.filter("place >= below and place < below + c").select(*keys, "cut", "n", F.expr("place - below").alias("place"))
    inside = t.groupBy(*keys, "cut", "value").agg(F.sum("c").alias("c")).join(cuts, [*keys, "cut"])
    upto = W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return inside.withColumn("upto", F.sum("c").over(upto)).filter("upto > place").groupBy(*keys).agg(F.first("n").alias("n"), F.min("value").alias("p90"))


def over_spans(counted: DataFrame, length: int) -> DataFrame:
    """(source, slot, value, c): counts over the ``length`` slots that end with each slot of a source that has rows. A count goes to as many spans as it lies in."""
    asked = counted.select("source", "slot").distinct()
    each = counted.select("source", F.explode(F.sequence(F.col("slot"), F.col("slot") + (length - 1))).alias("slot"), "value", "c")
    return each.groupBy("source", "slot", "value").agg(F.sum("c").alias("c")).join(asked, ["source", "slot"], "left_semi")


def chain(counted: DataFrame, stored: DataFrame, length: int, bootstrap: Mapping[str, int], otherwise: int = 100) -> DataFrame:
    """(source, slot, p90, sample_size, method): the baseline of every snapshot (slot) of a source, by the first way that has enough rows.

    ``counted`` is (source, slot, value, c) with slots as whole numbers, ``stored`` (source, slot, n, p90) what earlier runs kept. The batch itself
    from ``BATCH`` rows on (batch_current); the ``length`` slots up to it from ``SPAN`` rows on (rolling_14d); the upper median of ``STORED`` or more
    stored values of these slots that had ``BATCH`` rows each (snapshot_median); a constant of the source; ``otherwise`` (bootstrap both).
    The first two are 1 at least. Null sources and slots are left out.
    """
    counted = counted.filter("source is not null and slot is not null")
    batch = p90_of_counts(counted, ["source", "slot"])
    span = p90_of_counts(over_spans(counted, length), ["source", "slot"]).withColumnsRenamed({"n": "span_n", "p90": "span_p90"})
    kept = stored.filter(F.col("n") >= BATCH).select("source", F.explode(F.sequence(F.col("slot"), F.col("slot") + (length - 1))).alias("slot"), "n", "p90")
    order = W.partitionBy("source", "slot").orderBy("p90")
    kept = kept.withColumns({"k": F.row_number().over(order) - 1, "m": F.count(F.lit(1)).over(W.partitionBy("source", "slot")), "all": F.sum("n").over(W.partitionBy("source", "slot"))})
    kept = kept.filter(f"m >= {STORED} and k = m div 2").select("source", "slot", F.col("p90").alias("median"), F.col("all").alias("stored_n"))
    t = batch.join(span, ["source", "slot"]).join(kept, ["source", "slot"], "left")
    constant = F.coalesce(*[F.when(F.col("source") == s, v) for s, v in bootstrap.items()], F.lit(otherwise)).cast("long")
    one = F.lit(1).cast("long")
    ways = [
        (F.col("n") >= BATCH, "batch_current", F.greatest("p90", one), F.col("n")),
        (F.col("span_n") >= SPAN, "rolling_14d", F.greatest("span_p90", one), F.col("span_n")),
        (F.col("median").isNotNull(), "snapshot_median", F.col("median"), F.col("stored_n")),
    ]
    p90, size, method = constant, F.lit(0).cast("long"), F.lit("bootstrap")
    for when, name, value, n in reversed(ways):
        p90, size, method = F.when(when, value).otherwise(p90), F.when(when, n).otherwise(size), F.when(when, name).otherwise(method)
    return t.select("source", "slot", p90.alias("p90"), size.alias("sample_size"), method.alias("method"))

"""Confidences calibrated by what was known when they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Resolved predictions of a kind from which it is calibrated, and those of a bin from which the bin is.
LEAST, LEAST_IN_BIN = 20, 5


def tenth(confidence: Column) -> Column:
    """Bin of a confidence of three decimals: tenths, the last closed at 1; null has none."""
    return F.when(confidence.isNotNull(), F.least(F.floor(confidence * 10 + 1e-9), F.lit(9))).cast("int")


def multiplier(n: Column, hits: Column, bin_: Column) -> Column:
    """Accuracy over the middle of the bin, to three decimals, in whole numbers so that halves round up everywhere."""
    mid = 2 * bin_ + 1
    return F.floor((40000 * hits + n * mid) / (2 * n * mid)) / 1000


def known_by(predictions: DataFrame) -> DataFrame:
    """(kind, bin, made_at, n, hits, total): for each kind, bin and time of the predictions, what was resolved before that time.

    ``n`` and ``hits`` count the bin's resolved predictions and those that came true, ``total`` the kind's. Predictions are counted
    by time first, so running sums go over times (snapshots, not rows): a kind or bin that holds most rows costs no more.
    """
    p = predictions.select("kind", tenth(F.col("raw")).alias("bin"), "made_at", "resolved_at", F.col("actual").cast("int").alias("actual"))
    done = p.filter("resolved_at is not null and actual is not null and bin is not null").groupBy("kind", "bin", F.col("resolved_at").alias("time")).agg(F.count(F.lit(1)).alias("c"), F.sum("actual").alias("h"))
    asked = p.filter("made_at is not null and bin is not null").select("kind", "bin", F.col("made_at").alias("time")).distinct()
    none = F.lit(0).cast("long")
    both = asked.select("*", none.alias("c"), none.alias("h"), F.lit(True).alias("asks")).unionByName(done.select("*", F.lit(False).alias("asks")))
    # a range up to one snapshot before: what is resolved at the time itself isn't known yet
    before = lambda *keys: W.partitionBy(*keys).orderBy("time").rangeBetween(W.unboundedPreceding, -1)
    sums = {"n": F.sum("c").over(before("kind", "bin")), "hits": F.sum("h").over(before("kind", "bin")), "total": F.sum("c").over(before("kind"))}
    told = both.groupBy("kind", "bin", "time").agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.bool_or("asks").alias("asks")).withColumns(sums)
    return told.filter("asks").select("kind", "bin", F.col("time").alias("made_at"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])


def calibrated(predictions: DataFrame) -> DataFrame:
    """Adds multiplier, confidence, low, high and predicted to predictions (kind, raw, half_width, made_at, resolved_at, actual; others stay).

    A raw confidence (three decimals) is multiplied by what its kind and bin have shown up to then, and kept within .01 and .99; while fewer
    than ``LEAST`` of the kind or ``LEAST_IN_BIN`` of the bin are resolved it stays as it is. The interval
    is scaled alike. ``made_at`` and ``resolved_at`` are whole numbers of snapshots. A raw confidence or time that is null stays without
    multiplier; a null ``raw`` has a null result. Equal rows come out alike, an empty table stays empty.
    """
    names = [c for c in predictions.columns if c not in ("multiplier", "confidence", "low", "high", "predicted")]
    known = known_by(predictions).select(F.col("kind").alias("_kind"), F.col("bin").alias("_bin"), F.col("made_at").alias("_made_at"), "n", "hits", "total")
    known = known.filter((F.col("total") >= LEAST) & (F.col("n") >= LEAST_IN_BIN)).select("_kind", "_bin", "_made_at", multiplier(F.col("n"), F.col("hits"), F.col("_bin")).alias("_times"))
    same = F.col("kind").eqNullSafe(F.col("_kind")) & (tenth(F.col("raw")) == F.col("_bin")) & (F.col("made_at") == F.col("_made_at"))
    t = predictions.select(*names).join(known, same, "left")
    raw, sure = F.col("raw"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("raw") * F.col("_times")))
    sure = F.when(F.col("_times").isNull(), raw).otherwise(sure)
    ratio = F.when(raw > 0, sure / raw).otherwise(1.0)
    out = {
        "multiplier": F.col("_times"),
        "confidence": F.round(sure, 6),
        "low": F.round(F.greatest(F.lit(0.0), (raw - F.col("half_width")) * ratio) + 1e-9, 3),
        "high": F.round(F.least(F.lit(1.0), (raw + F.col("half_width")) * ratio) + 1e-9, 3),
        "predicted": F.round(sure, 6) >= 0.5,
    }
    return t.select(*names, *[F.when(raw.isNotNull(), v).alias(k) for k, v in out.items()])

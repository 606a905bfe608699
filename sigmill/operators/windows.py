"""Sequence operators over the snapshots of a trend: one shuffle and one sort on the trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, AT = "trend_id", "day"


def by() -> W:
    return W.partitionBy(KEY).orderBy(AT)


def trend() -> W:
    return W.partitionBy(KEY)


def from_end() -> Column:
    """1 for the last snapshot of a trend, 2 for the one before it."""
    return F.row_number().over(W.partitionBy(KEY).orderBy(F.desc(AT)))


def velocity(x: str = "momentum") -> Column:
    return F.col(x) - F.lag(x).over(by())


def first_inflections(df: DataFrame, least: float = 0.02) -> DataFrame:
    """Per trend, the first day with a velocity that turns from none to over ``least`` and stays positive."""
    v = df.withColumn("_v", velocity())
    v = v.withColumns({"_before": F.lag("_v").over(by()), "_next": F.lead("_v").over(by())})
    return v.filter((F.col("_before") <= 0) & (F.col("_v") > least) & (F.col("_next") > 0)).groupBy(KEY).agg(F.min(AT).alias(AT))


def slopes(df: DataFrame, x: str = "momentum") -> DataFrame:
    """Least squares slope against the place; the last difference with two points; 0 with one."""
    t = df.withColumn("_i", F.row_number().over(by())).withColumn("_v", velocity(x))
    n = F.count(F.lit(1))
    return t.groupBy(KEY).agg(F.when(n >= 3, F.regr_slope(F.col(x), F.col("_i"))).when(n == 2, F.max("_v")).otherwise(0.0).alias("slope"))


def last_three(df: DataFrame, x: str) -> DataFrame:
    """Per trend with three snapshots or more, the last three values: r0, r1, r2."""
    t = df.withColumn("_k", from_end()).filter("_k <= 3")
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(x)))
    return t.groupBy(KEY).agg(at(3).alias("r0"), at(2).alias("r1"), at(1).alias("r2")).filter("r0 is not null")


def breakouts(df: DataFrame, x: str = "momentum") -> DataFrame:
    """Trends of five snapshots or more whose last value is over the median of all but the last three
    plus 1.5 of their spread (at least .05), and over .5."""
    t = df.withColumns({"_k": from_end(), "_n": F.count(F.lit(1)).over(trend())}).filter("_n >= 5")
    old = F.when(F.col("_k") > 3, F.col(x))
    t = t.groupBy(KEY).agg(F.median(old).alias("m"), F.stddev_samp(old).alias("s"), F.max(F.when(F.col("_k") == 1, F.col(x))).alias("now"))
    bar = F.col("m") + 1.5 * F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.05))
    return t.select(KEY, "now", ((F.col("now") > bar) & (F.col("now") > 0.5)).alias("breakout"))


def changes(df: DataFrame, label: str) -> DataFrame:
    """Snapshots whose label isn't that of the snapshot before them, nulls left out."""
    t = df.filter(F.col(label).isNotNull()).withColumn("_p", F.lag(label).over(by()))
    return t.filter(~F.col("_p").eqNullSafe(F.col(label))).drop("_p")


def failure_streaks(df: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """Failures in a row up to each row, back to 0 with a success."""
    w = W.partitionBy(key).orderBy(at)
    t = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.sum("_f").over(W.partitionBy(key, "_island").orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("streak", run).drop("_f", "_island")


def lifecycle(df: DataFrame) -> DataFrame:
    """Stage of each snapshot by the ordered rules, with change, seen counts and confidence.

    First appearance, then comparability (gap of 12 h or more, previous momentum .01 or
    more), then momentum and change; confidence has ceilings for few snapshots or days.
    """
    t = df.withColumns(
        {
            "prev_momentum": F.lag("momentum").over(by()),
            "prev_n": F.lag("n").over(by()),
            "gap_days": F.date_diff(F.col(AT), F.lag(AT).over(by())),
            "snapshots_seen": F.row_number().over(by()),
        }
    )
    m, first = F.col("momentum"), F.col("prev_momentum").isNull()
    t = t.withColumn("comparable", ~first & (F.col("prev_momentum") >= 0.01))
    t = t.withColumn("change", F.when(F.col("comparable"), (m - F.col("prev_momentum")) / F.col("prev_momentum") * 100))
    p, ds = F.col("change"), F.col("n") - F.col("prev_n")
    rules = [
        (first, "emerging", F.lit(0.9)),
        (~F.col("comparable"), "stable", None),
        ((m >= 0.5) & (F.abs(p) <= 10), "peaking", F.lit(0.76)),
        ((p > 20) & (m >= 0.3), "rising", F.lit(0.76)),
        ((p < -20) & (m >= 0.3), "declining", F.lit(0.72)),
        ((m < 0.3) & (p < -10), "fading", F.when(ds < 0, 0.72).otherwise(0.56)),
        ((m < 0.3) & (p > 10), "emerging", F.when(ds > 0, 0.68).otherwise(0.48)),
    ]
    ceiling = F.when(F.col("snapshots_seen") < 2, 0.6).when(F.col("snapshots_seen") < 3, 0.7).otherwise(1.0)
    stage, sure = F.lit("stable"), F.least(F.lit(0.56), ceiling)
    for when, name, c in reversed(rules):
        stage = F.when(when, name).otherwise(stage)
        sure = F.when(when, F.lit(0.5) if c is None else F.least(c, ceiling)).otherwise(sure)
    return t.withColumns({"stage": stage, "stage_confidence": sure})


def timing(df: DataFrame) -> DataFrame:
    """Timing label of each trend from its whole series: guards first, then the first rule that holds.

    ``df`` has momentum, n, top and stage of every snapshot.
    """
    n_points = F.count(F.lit(1))
    last = df.groupBy(KEY).agg(n_points.alias("points"), F.max_by("momentum", AT).alias("m"), F.max_by("n", AT).alias("n"), F.max_by("stage", AT).alias("stage"), F.date_diff(F.max(AT), F.min(AT)).alias("span"))
    t = last.join(slopes(df), KEY).join(first_inflections(df).select(KEY, F.lit(True).alias("turned")), KEY, "left")
    t = t.join(breakouts(df).select(KEY, "breakout"), KEY, "left")
    top = last_three(df, "top").select(KEY, ((F.col("r0") > F.col("r1")) & (F.col("r1") > F.col("r2")) & (F.col("r0") - F.col("r2") > 0.15 * F.greatest("r0", F.lit(1)))).alias("thinner"))
    more = last_three(df, "n").select(KEY, ((F.col("r0") < F.col("r1")) & (F.col("r1") < F.col("r2"))).alias("more"))
    t = t.join(top, KEY, "left").join(more, KEY, "left").fillna(False, ["turned", "breakout", "thinner", "more"])
    m, s, stage = F.col("m"), F.col("slope"), F.col("stage")
    rules = [
        ((F.col("span") + 1 < 2) | (F.col("points") < 3), "timing_uncertain"),
        ((m < 0.3) & (stage == "emerging") & (s <= 0), "too_early"),
        (F.col("thinner"), "crowded"),
        ((F.col("n") > 20) & (s < 0), "crowded"),
        ((m >= 0.3) & (s > 0) & (F.col("breakout") | F.col("turned")), "early_edge"),
        ((m >= 0.3) & (s > 0) & stage.isin("emerging", "rising") & F.col("more"), "early_edge"),
        (stage.isin("peaking", "declining", "stable") & (m >= 0.4) & (s >= -0.05), "late_but_monetizable"),
        ((m >= 0.7) & (s >= 0), "early_edge"),
        ((m >= 0.3) & (s > 0) & F.col("more"), "early_edge"),
    ]
    label = F.lit("too_early")
    for when, name in reversed(rules):
        label = F.when(when, name).otherwise(label)
    return t.withColumn("label", label)

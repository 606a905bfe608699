"""Signals to trends: phrases that several signals share are merged greedily, the most common ones first."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions.phrases import TERMS
from sigmill.operators.graph import kept

# Single words that are too wide for a trend.
GENERIC = "edge app model tool code web data cloud mobile framework library api database server client application".split()

#: Occurrences of undecided phrases up to which one task decides them in order; beyond that they are decided by rounds.
FEW = 200_000


def shared_phrases(occ: DataFrame) -> DataFrame:
    """(phrase, n) of phrases (k, phrase) that two rows or more hold, without wide single words; if none is left, wide technical ones too."""
    n = kept(occ.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))
    telling = n.filter(~F.col("phrase").isin(GENERIC))
    if telling.limit(1).count():
        return telling
    return n.filter(F.col("phrase").isin(TERMS) | F.col("phrase").contains("-"))


def _in_order(rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Decides phrases one after another: (grp, k, phrase) of those that open a group or join one."""
    groups: dict[int, set] = {}
    of: dict[int, set] = {}
    for g, k in zip(members["grp"], members["k"], strict=True):
        groups.setdefault(g, set()).add(k)
        of.setdefault(k, set()).add(g)
    out = []
    for (_, place), x in rows.sort_values(["place"]).groupby(["place", "place"], sort=True):
        mine = set(x["k"])
        if sum(k not in of for k in mine) < 2 and len(mine) < 3:
            continue
        met = Counter(g for k in mine for g in of.get(k, ()))
        at = min((g for g, n in met.items() if 2 * n > len(mine)), default=place)
        for k in mine - groups.setdefault(at, set()):
            of.setdefault(k, set()).add(at)
            out.append((at, k))
        groups[at] |= mine
    return pd.DataFrame(out, columns=["grp", "k"]).astype("int64")


def merged_groups(occ: DataFrame, shared: DataFrame, few: int = FEW) -> DataFrame:
    """(grp, k): rows of each group, named by the place of the phrase that opened it.

    Phrases are taken from the most common one on, equal ones by name. One with fewer than three rows, of which not
    two are new, is left out; one of which more than half lies in a group joins the earliest such; any other opens one. A phrase's
    fate rests on the earlier ones that share rows with it alone, as no earlier one has fewer rows: so in each round all
    phrases act that come first among the undecided in every row that they hold. What is left is decided in one task
    as soon as it is small.
    """
    # places are made from counts and names, so that they need no sort in one task
    order = kept(shared.orderBy(F.desc("n"), "phrase").withColumn("place", F.monotonically_increasing_id()))
    open_ = kept(occ.join(order, "phrase").select("place", "n", "k"))
    groups = kept(open_.sparkSession.createDataFrame([], "grp long, k long"))
    while (left := open_.count()) > few:
        first = open_.groupBy("k").agg(F.min("place").alias("first"))
        ready = kept(open_.join(first, "k").groupBy("place").agg(F.min(F.col("first") == F.col("place")).alias("ready")).filter("ready").select("place"))
        mine = kept(open_.join(ready, "place"))
        used = groups.groupBy("k").agg(F.count(F.lit(1)).alias("used"))
        new = mine.join(used, "k", "left").groupBy("place", "n").agg(F.count_if(F.col("used").isNull()).alias("new")).filter("new >= 2 or n >= 3").select("place")
        met = mine.join(groups, "k").groupBy("place", "n", "grp").agg(F.count(F.lit(1)).alias("both")).filter("2 * both > n").groupBy("place").agg(F.min("grp").alias("grp"))
        acts = mine.join(new, "place").join(met, "place", "left").select(F.coalesce("grp", "place").alias("grp"), "k")
        groups = kept(groups.unionByName(acts).distinct())
        open_ = kept(open_.join(ready, "place", "left_anti"))
    if not left:
        return groups
    near = groups.join(groups.join(open_.select("k").distinct(), "k", "left_semi").select("grp").distinct(), "grp").join(open_.select("k").distinct(), "k", "left_semi")
    one = F.lit(1).alias("one")
    rest = open_.select("place", "k", one).groupBy("one").cogroup(near.select("grp", "k", one).groupBy("one")).applyInPandas(lambda a, b: _in_order(a, b), "grp long, k long")
    return kept(groups.unionByName(rest).distinct())


def trend_groups(df: DataFrame, key: str, phrases: str, limit: int = 30, few: int = FEW) -> DataFrame:
    """(trend, n, first): the ``limit`` largest groups, named by the phrase that tells most of them.

    A phrase tells how many of the group's rows hold it, times one and half its words; equal ones go by name. Single words that
    are no technical terms name no trend. Rows without phrases, or with null, belong to none; a row may belong to several groups.
    """
    occ = kept(df.select(F.col(key).cast("long").alias("k"), F.explode(F.array_distinct(phrases)).alias("phrase")).filter("phrase is not null"))
    shared = kept(shared_phrases(occ))
    groups = merged_groups(occ, shared, few)
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).filter("n >= 2")
    told = shared.select("phrase").unionByName(occ.select("phrase").filter(F.col("phrase").isin(TERMS)).distinct()).distinct()
    held = groups.join(occ.join(told, "phrase"), "k").groupBy("grp", "phrase").agg(F.count(F.lit(1)).alias("held"))
    worth = F.col("held") * (1 + F.size(F.split("phrase", "-")) * 0.5)
    best = held.groupBy("grp").agg(F.min_by("phrase", F.struct(-worth, F.col("phrase"))).alias("trend"))
    named = size.join(best, "grp").filter(F.col("trend").contains("-") | F.col("trend").isin(TERMS))
    return named.select("trend", "n", "first", "grp").orderBy(F.desc("n"), "trend", "first", "grp").limit(limit).drop("grp")

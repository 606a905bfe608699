"""Duplicates by URL, by event and by phrase; grouping of signals into trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators.graph import components
from sigmill.operators.similar import token_sort_ratio


def url_duplicates(df: DataFrame, key: str, url: str) -> DataFrame:
    """(canonical, duplicate, match_type): rows with one canonical URL, the least key being canonical."""
    t = df.select(F.col(key).alias("duplicate"), X.canonical_url(F.col(url))["url"].alias("c")).filter("c is not null")
    first = t.groupBy("c").agg(F.min("duplicate").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return t.join(first, "c").filter("duplicate <> canonical").select("canonical", "duplicate", F.lit("canonical_url").alias("match_type"))


def event_groups(df: DataFrame, key: str, title: str, least: float = 0.75, loose: float = 0.5, ratio: float = 0.70) -> DataFrame:
    """(key, group): rows whose titles have two entities or more and share enough of them, closed over links.

    Two sets of entities are one event from a Jaccard similarity of ``least`` on, or from
    ``loose`` on if the titles are alike by ``ratio`` too. Equal sets fold into one first, for
    which the title of its least key stands. Unlike sets meet on their rarest entities
    alone: of two sets that share enough, the first ones in the order of rarity, as many as the
    similarity leaves out and one more, have one in common; so common entities pair no one.
    """
    t = df.select(F.col(key).alias("k"), F.col(title).alias("title"), F.array_sort(X.entities(F.col(title))).alias("e")).filter(F.size("e") >= 2)
    sets = t.groupBy("e").agg(F.min("k").alias("first"), F.min_by("title", "k").alias("title"))
    each = sets.select("first", F.explode("e").alias("t"))
    rare = each.join(each.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t").groupBy("first").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda s: s["t"]).alias("r"))
    sets = sets.join(rare, "first").withColumn("r", F.slice("r", F.lit(1), (F.size("r") - F.ceil(F.lit(min(least, loose)) * F.size("r")) + 1).cast("int")))
    x = sets.select("first", "e", "title", F.explode("r").alias("t"))
    y = sets.select(F.col("first").alias("other"), F.col("e").alias("f"), F.col("title").alias("more"), F.explode("r").alias("t"))
    near = x.join(y, "t").filter("first < other").dropDuplicates(["first", "other"]).withColumn("j", X.jaccard(F.col("e"), F.col("f")))
    sure = near.filter(F.col("j") >= least).select("first", "other")
    alike = near.filter((F.col("j") < least) & (F.col("j") >= loose)).withColumn("s", token_sort_ratio(F.col("title"), F.col("more"))).filter(F.col("s") >= ratio).select("first", "other")
    roots = components(sure.unionByName(alike).select(F.col("first").alias("a"), F.col("other").alias("b")))
    named = sets.join(roots, sets["first"] == roots["node"], "left").select("e", F.coalesce("root", "first").alias("grp"))
    return t.join(named, "e").select(F.col("k").alias(key), F.col("grp").alias("event_group"))


def phrase_index(df: DataFrame, key: str, phrases: str, least: int = 2) -> DataFrame:
    """Inverted index: phrases that at least ``least`` rows hold, with their count and first row."""
    t = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(phrases)).alias("phrase"))
    return t.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).filter(F.col("n") >= least)


def trends(df: DataFrame, key: str, phrases: str, limit: int = 30) -> DataFrame:
    """Each row goes to its most common phrase, ties to the first in order; groups of two or more, largest first."""
    t = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(phrases)).alias("phrase"))
    size = t.groupBy("phrase").agg(F.count(F.lit(1)).alias("size"))
    best = t.join(size, "phrase").groupBy("k").agg(F.min_by("phrase", F.struct(-F.col("size"), "phrase")).alias("trend"))
    return best.groupBy("trend").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.desc("n"), "trend").limit(limit)


def centroids(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Mean vector of each cluster, scaled to length 1; sums by component, so a hot cluster spreads."""
    t = df.select(cluster, F.posexplode(vec).alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    t = t.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(cluster))))
    return t.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))

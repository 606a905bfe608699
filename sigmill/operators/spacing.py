"""Rows of a key that keep a distance in time from the last one that was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators.graph import kept


def next_allowed(df: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, at, next): of rows unlike in key and ``at`` (long), the first of the key that is ``gap`` or more behind; null where none is.

    It lies in the span of ``gap`` in which it may begin, or is the first row of the next span that has one. So the rows of a key are sorted within spans
    alone, and what is sorted for the whole key is one row for each span.
    """
    rows = df.select(F.col(key).alias("k"), F.col(at).alias("at")).withColumn("span", F.floor(F.col("at") / gap))
    spans = rows.groupBy("k", "span").agg(F.min("at").alias("first"))
    spans = spans.select("k", "span", F.lead("first").over(W.partitionBy("k").orderBy("span")).alias("after"))
    # a row's limit always lies in the span behind its own
    asked = rows.select("k", (F.col("span") + 1).alias("span"), (F.col("at") + gap).alias("x"), F.col("at").alias("asks"))
    both = rows.select("k", "span", F.col("at").alias("x"), F.lit(None).cast("long").alias("asks")).unionByName(asked)
    # an asking row comes before a row of the same time, which is far enough
    later = W.partitionBy("k", "span").orderBy("x", F.col("asks").isNull()).rowsBetween(1, W.unboundedFollowing)
    found = both.withColumn("here", F.min(F.when(F.col("asks").isNull(), F.col("x"))).over(later)).filter("asks is not null")
    own = spans.select("k", (F.col("span") + 1).alias("span"), "after")
    first_of_next = spans.select("k", "span", F.col("after").alias("beyond"))
    # the first row behind the asking one's span, or, where that comes too early, the first behind the limit's span
    out = found.join(first_of_next, ["k", "span"], "left").join(own, ["k", "span"])
    past = F.when(F.col("after") >= F.col("x"), F.col("after")).otherwise(F.col("beyond"))
    return out.select(F.col("k").alias(key), F.col("asks").alias(at), F.coalesce("here", past).alias("next"))


def spaced(df: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, at): the first row of each key, and then always the first that is ``gap`` or more behind the last that was kept.

    Rows of one key and time count once; null keys are one key, null times are left out. Each row points to the next one that its being kept would allow, and
    pointers are doubled until all rows that the first one leads to are found: as many rounds as the logarithm of the longest chain.
    """
    told = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()
    rows = df.filter(F.col(at).isNotNull()).groupBy(*[c.alias(n) for n, c in zip(("_t", "_n"), told, strict=True)], F.col(at).alias("at")).agg(F.first(key).alias("v"))
    rows = kept(rows.withColumn("k", F.struct("_t", "_n")).select("k", "at", "v"))
    jump = kept(next_allowed(rows, "k", "at", gap).filter("next is not null"))
    reached = kept(rows.groupBy("k").agg(F.min("at").alias("at")))
    while jump.limit(1).count():
        reached = kept(reached.unionByName(reached.join(jump, ["k", "at"]).select("k", F.col("next").alias("at"))).distinct())
        jump = kept(jump.join(jump.select("k", F.col("at").alias("next"), F.col("next").alias("far")), ["k", "next"]).select("k", "at", F.col("far").alias("next")))
    return reached.join(rows, ["k", "at"]).select(F.col("v").alias(key), F.col("at").alias(at))

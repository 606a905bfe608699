"""Joins that Spark has no operator for: as-of, nearest in time, pairs by shared tokens, by title, by vector."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previous_state(df: DataFrame, key: str, order: str, ordinal: str, columns: Sequence[str], reach: int) -> DataFrame:
    """As-of join of each row with the row before it of the same key, at most ``reach`` ordinals back.

    One window instead of a self-join: a shuffle and a sort on the key.
    """
    w = W.partitionBy(key).orderBy(order)
    near = F.col(ordinal) - F.lag(ordinal).over(w) <= reach
    return df.withColumns({f"prev_{c}": F.when(near, F.lag(c).over(w)) for c in columns})


def nearest_in_time(df: DataFrame, key: str, at: str, value: str, days_back: int, reach: int) -> DataFrame:
    """Adds ``near_<days>``: the value of the key's row nearest to ``days_back`` days before, within ``reach`` days.

    Candidates are cut to the reach by the join's range on days, exploded to an equi-join.
    """
    days = F.explode(F.sequence(F.lit(-reach + 1), F.lit(reach - 1))).alias("off")
    probe = df.select(key, F.col(at).alias("_at"), days).withColumn("_day", F.date_add(F.date_sub("_at", days_back), F.col("off")))
    found = probe.join(df.select(key, F.col(at).alias("_day"), F.col(value).alias("_v")), [key, "_day"])
    best = found.groupBy(key, "_at").agg(F.min_by("_v", F.struct(F.abs("off"), "_day")).alias(f"near_{days_back}"))
    return df.join(best.withColumnRenamed("_at", at), [key, at], "left")


def shared_token_pairs(df: DataFrame, key: str, tokens: str, least: int) -> DataFrame:
    """(a, b, shared) of keys a < b with at least ``least`` tokens in common; rare tokens do the meeting.

    Of rows that share ``least`` tokens, all but the ``least`` - 1 most common tokens of each have one
    in common, so these meet; the whole sets then decide.
    """
    t = df.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("s")).filter(F.size("s") >= least)
    each = t.select("k", F.explode("s").alias("t"))
    seen = each.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rare = each.join(seen, "t").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("r")).filter(F.size("r") >= least)
    meet = rare.select("k", "r", F.explode(F.slice("r", F.lit(1), F.size("r") - (least - 1))).alias("t"))
    pairs = meet.select(F.col("k").alias("a"), F.col("r").alias("x"), "t").join(meet.select(F.col("k").alias("b"), F.col("r").alias("y"), "t"), "t").filter("a < b").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared")).filter(F.col("shared") >= least)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest_vectors(queries: DataFrame, df: DataFrame, key: str, vector: str, k: int, least: float, block: int = 4096) -> DataFrame:
    """(query_id, key, c): for each query the ``k`` rows with the greatest cosine, ``least`` at least.

    Blocks of queries meet blocks of rows in tasks of their own, each of which returns
    its ``k`` best rows for a query; these are ranked again. Ties go to the lesser key.
    """
    qs, ds = (max(1, -(-t.count() // block)) for t in (queries, df))
    at = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v"), at(qs).alias("a"), every(ds).alias("b"))
    right = df.select(key, F.col(vector).alias("v"), at(ds).alias("b"), every(qs).alias("a"))

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), key: np.zeros(0, np.int64), "c": np.zeros(0)})
        if not len(q) or not len(x):
            return none
        x = x.sort_values(key)
        m, ids, out = np.stack(x["v"]).astype(float), x[key].to_numpy(), [none]
        norm = np.sqrt((m * m).sum(1))
        for i, v in zip(q["query_id"], q["v"], strict=True):
            v = np.asarray(v, float)
            c = m @ v / (norm * np.sqrt(v @ v))
            near = np.flatnonzero(c >= least)
            near = near[np.argsort(-c[near], kind="stable")][:k]
            out.append(pd.DataFrame({"query_id": i, key: ids[near], "c": c[near]}))
        return pd.concat(out[1:])

    got = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, f"query_id long, {key} long, c double")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("c"), F.asc(key)))
    return got.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r")

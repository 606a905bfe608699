"""Relevance, outcomes and learned weights of users."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the parts of relevance.
WEIGHTS = {"role": 0.25, "domain": 0.25, "stack": 0.20, "effort": 0.15, "risk": 0.10, "avoid": -0.30}


def relevance(parts: Mapping[str, Column]) -> Column:
    """Weighted parts, each between 0 and 1, within 0 and 1."""
    total = sum((parts[k] * w for k, w in WEIGHTS.items() if k in parts), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def share_of_wants(wants: Column, text: Column) -> Column:
    """Share of the wanted words that the text holds; .5 without wants."""
    return F.when(F.size(wants) == 0, 0.5).otherwise(F.size(F.filter(wants, lambda w: F.contains(text, w))) / F.size(wants))


def personal_rank(base: Column, outcome: Column, fit: Column) -> Column:
    return 0.6 * base * (1 + outcome) + 0.4 * fit


def learned_weights(df: DataFrame, key: str, liked: Column, value: Column, age_days: Column) -> DataFrame:
    """Per key, the weighted mean of ``value`` among liked minus that among others, newer rows counting more.

    Scaled by .05 n / 5 and kept within .2; keys with fewer than five rows learn nothing.
    """
    w = F.pow(F.lit(0.5), age_days / 30)
    mean = lambda keep: F.sum(F.when(keep, w * value)) / F.sum(F.when(keep, w))
    n = F.count(F.lit(1))
    t = df.groupBy(key).agg(n.alias("n"), (mean(liked) - mean(~liked)).alias("gap"))
    t = t.filter((F.col("n") >= 5) & F.col("gap").isNotNull())
    return t.select(key, "n", F.round(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("gap") * 0.05 * F.col("n") / 5)), 4).alias("shift"))

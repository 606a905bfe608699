"""Scores: engagement, decay, diversity, saturation, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Rounds as web code does: halves go up."""
    return F.floor(x + 0.5)


def engagement(source: Column, score: Column, comments: Column) -> Column:
    """Score and comments by source; a comment counts whole, in part or not at all."""
    weight = F.when(source == "click", 0.5).when(source == "view", 0.3).when(source == "purchase", 0.0).otherwise(1.0)
    return F.when(source == "signup", 1.0).otherwise(score + weight * comments)


def seconds(time: Column) -> Column:
    """Whole seconds of a time since 1970, cut downward: two of them are as far apart as borders of seconds lie between them."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / 1000000)


def decay(age_days: Column, half_life: float = 7, whole: bool = True, past: bool = True) -> Column:
    """Weight by age; with ``past`` what lies ahead or has no age weighs 1, else more than 1 and null."""
    age = F.greatest(age_days, F.lit(0)) if past else age_days
    return F.pow(F.lit(0.5), (F.floor(age) if whole else age) / half_life)


def diversity(kinds: Column, spread_days: Column, top_share: Column) -> Column:
    """Seven sources or a week's spread are full marks; one source that holds most costs up to .3."""
    cost = F.when(top_share > 0.9, 0.3).when(top_share > 0.7, 0.1).otherwise(0.0)
    return (0.7 * F.least(F.lit(1.0), (kinds - 1) / 6) + 0.3 * F.least(F.lit(1.0), spread_days / 7)) * (1 - cost)


def momentum(engaged: Column, diverse: Column, demand_ratio: Column) -> Column:
    return 0.5 * engaged + 0.3 * diverse + 0.2 * demand_ratio * demand_ratio


def acceleration(change: Column, more: Column) -> Column:
    return 0.7 * clamp(change / 100, -1, 1) + 0.3 * clamp(more / 10, -1, 1)


def event_weight(top: Column, n: Column, kinds: Column) -> Column:
    return top * F.log1p(n) * (0.5 + 0.5 * kinds / n)


def saturation(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known, weights made to sum to 1."""
    total = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0)) / total)


def will_qualify(m: Column, n: Column, stage: Column, diverse: Column, stable: Column) -> Column:
    """Confidence from additive rules, without history."""
    c = 0.5 + F.when(m >= 0.7, 0.15).when(m >= 0.5, 0.08).when(m < 0.3, -0.10).otherwise(0.0)
    c = c + F.when(n >= 5, 0.10).when(n >= 3, 0.05).otherwise(0.0)
    c = c + F.when(stage.isin("rising", "peaking"), 0.08).when(stage.isin("fading", "declining"), -0.12).otherwise(0.0)
    c = c + F.when(diverse >= 0.5, 0.08).when((diverse > 0) & (diverse < 0.2), -0.05).otherwise(0.0)
    return clamp(c + F.when(stable >= 0.8, 0.06).when(stable < 0.3, -0.08).otherwise(0.0), 0.05, 0.95)


def archetype(starts: Column, rate: Column, quality: Column, days: Column) -> Column:
    return (
        F.when(starts < 3, F.lit(None).cast("string"))
        .when((rate < 0.3) & (starts >= 5), "execution_trap")
        .when((rate >= 0.6) & (quality >= 4), "proven_winner")
        .when((days <= 7) & (rate >= 0.4), "fast_mvp")
        .when((days >= 30) & (quality >= 3.5), "infra_bet")
        .when((rate >= 0.3) & (rate < 0.6), "content_wedge")
    )


def outcome_modifier(starts: Column, rate: Column, quality: Column) -> Column:
    """What past outcomes add to a score: nothing below three starts, else rules within .3."""
    m = F.when(rate >= 0.6, 0.10).when(rate >= 0.4, 0.05).when(rate < 0.2, -0.15).otherwise(0.0)
    m = m + F.when(quality >= 4, 0.10).when(quality >= 3, 0.05).when((quality > 0) & (quality < 2), -0.10).otherwise(0.0)
    m = m + F.when(starts >= 10, 0.05).when(starts >= 5, 0.02).otherwise(0.0)
    return F.when(starts >= 3, clamp(m, -0.3, 0.3)).otherwise(0.0)

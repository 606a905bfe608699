"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import SPACE, written
from sigmill.llm.quality_rules import symbol_count, text_of, words_of


def statistics(text: str = "text") -> dict[str, Column]:
    """Transformed statistics of a whole text, none of them a label or a source.

    Shares are of the words or characters and a few more, so that one odd word in a
    very short text doesn't stand as far out as a text full of them.
    """
    body, w = text_of(text), F.col("_w")
    n, letters = F.size(w) + 10, F.length(F.regexp_replace(body, rf"[{SPACE}]+", ""))
    chars = letters + 50
    kinds = F.size(F.array_distinct(w))
    again = F.size(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n).alias("b")), lambda p: p["a"] == p["b"]))
    count = lambda keep: F.length(F.regexp_replace(body, f"[^{keep}]++", ""))
    return {
        "length": F.log1p(F.size(w)),
        "word_length": F.log1p(chars / n),
        "symbols": F.log1p(10 * symbol_count(body) / n),
        "marks": F.log1p(10 * count("!?") / n),
        "bars": F.log1p(10 * count("|") / n),
        "stops": F.sqrt(count(".,") / n),
        "upper": F.sqrt(count(r"\p{Lu}") / chars),
        "digits": F.sqrt(count(r"\p{Nd}") / chars),
        "variety": F.log(kinds + 10) / F.log(n),
        "stutter": F.sqrt(again / n),
        "short": F.sqrt(F.size(F.filter(w, lambda x: F.length(x) <= 3)) / n),
        "lines": F.log1p(count("\n") / n * 20),
    }


NAMES = ["length", "word_length", "symbols", "marks", "bars", "stops", "upper", "digits", "variety", "stutter", "short", "lines"]


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row: doc_id and ``x``, the statistics of its text as an array."""
    split = docs.select(F.col("doc_id"), F.col(text).alias("text")).withColumn("_w", words_of(text_of("text")))
    return split.select("doc_id", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in statistics().values()]).alias("x"))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of shrunk covariances, log determinants, priors."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of log densities."""
        logs = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.logdet[c] + self.prior[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def moments(rows: DataFrame) -> np.ndarray:
    """Per class, the sum of z zᵀ with z = (1, x) over all (quality, x) rows.

    Every task adds up its own rows; what reaches the driver is a number for each
    class and pair of statistics, whatever the count of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(NAMES) + 1, len(NAMES) + 1))
        for b in batches:
            if len(b):
                z = np.hstack([np.ones((len(b), 1)), np.stack(b["x"].to_numpy())])
                for c in (0, 1):
                    own = z[b["quality"].to_numpy() == c]
                    total[c] += own.T @ own
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    got = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * (len(NAMES) + 1) ** 2)
    for r in got:
        out[r.k] = r.v
    return out.reshape(2, len(NAMES) + 1, -1)


def fit(sums: np.ndarray, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant | float:
    """Shrinks each class covariance towards the pooled one and a multiple of its scale.

    With fewer than two rows of a class there is nothing to compare: the share of
    class 1 (a half without labels) is returned, and scores every text.
    """
    n = sums[:, 0, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    mean = sums[:, 0, 1:] / n[:, None]
    cov = sums[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    shrunk = (1 - shrink) * cov + shrink * pooled + ridge * np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-9)
    factor = np.linalg.cholesky(shrunk)
    logdet = 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1)
    return Discriminant(mean, np.linalg.inv(factor), logdet, np.log(n / n.sum()))


def scored(features: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, x); ids never leave the JVM."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return features.select("doc_id", (F.lit(model) if isinstance(model, float) else score("x")).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, shrink: float = 0.1) -> DataFrame:
    """Score of every whole text; learns from labelled rows that aren't held out.

    Null and empty texts have the statistics of no words. Several labels of one
    doc_id all count, each with every text of that id; labels other than 0 and 1 and
    null ids teach nothing. An empty table stays empty; without labels of both
    classes the score is constant.
    """
    features = written(add_statistics(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "statistics")
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    # a shuffled join at every size: how many labels there are follows from the data
    model = fit(moments(features.join(known.hint("merge"), "doc_id").select("quality", "x")), shrink)
    out = scored(features, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

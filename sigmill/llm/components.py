"""Connected components of a graph that stays spread over the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import written


def _least(pairs: DataFrame, name: str) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), name)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root), root the least node of each component.

    Alternates large and small stars until the links no longer change: every round
    links nodes to the least neighbour, so paths shrink by half or more. Least
    neighbours are pre-aggregated and written, so the join back can be split where a
    node has very many links. Nothing but a count and a checksum reaches the driver.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both, "large").withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        m = _least(large, "small")
        small = large.join(m, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        if (after := _mark(now)) == mark:
            break
        mark = after
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Components of ``n`` items of one task, fed with links as they are found.

    ``label`` always names the root of every item, the least item known to be in its
    component. Links are held back until ``most`` of them have come, so what a task
    keeps grows with its items, not with the links between them.
    """

    def __init__(self, n: int, most: int = 1 << 20) -> None:
        self.label, self.most = np.arange(n), most
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._count = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self._held.append((i, j))
        self._count += len(i)
        if self._count >= self.most:
            self._join()

    def roots(self) -> np.ndarray:
        self._join()
        return self.label

    def _join(self) -> None:
        if not self._held:
            return
        i, j = (np.concatenate(v) for v in zip(*self._held, strict=True))
        self._held, self._count = [], 0
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            # only roots are hooked, each below the least root that it is linked to, so no link is lost
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

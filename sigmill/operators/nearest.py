"""Each vector's nearest other one by cosine, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.operators.graph import kept

#: Least and greatest count of a block's vectors, how many blocks there are between these, and the side of the matrices within a task.
LEAST_BLOCK, WIDEST, SIDES, TILE = 8192, 65_536, 16, 4096


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector is not null, not zero and holds finite components alone."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each two rows in double precision, the same wherever the rows lie."""
    out = [np.zeros(0)]
    for at in range(0, len(x), 65_536):
        a, b = (z[at : at + 65_536].astype(float) for z in (x, y))
        dot = lambda p, q: np.einsum("ij,ij->i", p, q)
        out.append(dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))))
    return np.concatenate(out)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _tops(s: np.ndarray, least: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a matrix of rough cosines, each off by ``slack`` at most, that may hold their row's greatest one from ``least`` on."""
    top = s.max(1)
    rows = np.flatnonzero(top >= least - slack)
    i, j = np.nonzero(s[rows] >= np.maximum(top[rows] - 2 * slack, least - slack)[:, None])
    return rows[i], j


def near_tops(x: np.ndarray, y: np.ndarray, least: float, within: bool, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, c): cosines c >= ``least`` of rows i of ``x`` and j of ``y``, among them the greatest ones of every row of either side; ``within``: both are one matrix, whose rows don't meet themselves.

    Matrices of ``tile`` by ``tile`` are multiplied in single precision; what may be greatest within its rounding is told in double precision.
    """
    a, b = _unit(x), _unit(y)
    # each product is off by a few units of single precision, and so is each of their sums
    slack, found = (x.shape[1] + 8) * 1.2e-7, []
    for p in range(0, len(a), tile):
        for q in range(p if within else 0, len(b), tile):
            s = a[p : p + tile] @ b[q : q + tile].T
            same = within and p == q
            if same:
                np.fill_diagonal(s, -2)
            i, j = _tops(s, least, slack)
            found.append((i + p, j + q))
            if not same:
                j, i = _tops(s.T, least, slack)
                found.append((i + p, j + q))
    i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    c = np.concatenate([np.zeros(0), *(_cosines(x[i[k : k + 1 << 20]], y[j[k : k + 1 << 20]]) for k in range(0, len(i), 1 << 20))])
    ok = c >= least
    return i[ok], j[ok], c[ok]


def _best(ids: np.ndarray, others: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """(id, other, c): the greatest c of each id, of equal ones the least other."""
    order = np.lexsort((others, -c, ids))
    ids, others, c = ids[order], others[order], c[order]
    first = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    return pd.DataFrame({"id": ids[first], "other": others[first], "c": c[first]})


def nearest_others(df: DataFrame, key: str, vector: str, least: float, block: int = LEAST_BLOCK, sides: int = SIDES, tile: int = TILE) -> DataFrame:
    """(id, other, c): of each vector the other one with the greatest cosine, ``least`` at least; of equal ones the least key. Keys are unlike; null, zero and not finite vectors are near to none.

    Equal vectors fold into one, so groups of copies cost one vector each. The others go by hash into about ``sides`` blocks, and every two blocks to one task, once for both: a vector is sent about
    ``sides`` times at any size up to a million. The products grow with the square of the unlike vectors; what is kept of them is a row for each vector and pair of blocks at most.
    """
    rows = kept(usable(df, key, vector))
    raw = np.dtype({"float": "<f4"}.get(rows.schema["v"].dataType.elementType.simpleString(), "<f8"))
    one = kept(rows.groupBy("v").agg(F.min("id").alias("id")))
    copies = kept(rows.join(one.select("v", F.col("id").alias("one")), "v").filter("id <> one").select("one", "id"))
    twice = kept(copies.groupBy("one").agg(F.min("id").alias("second")))
    n = one.count()
    size = max(block, min(WIDEST, -(-n // sides)))
    count = max(1, -(-n // size))
    dealt = one.join(twice.select(F.col("one").alias("id"), "second"), "id", "left").select("id", "v", F.col("second").isNotNull().alias("twice"), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        return pd.DataFrame({"block": [g["block"].iloc[0]], "ids": [g["id"].to_numpy()], "twice": [g["twice"].to_numpy()], "raw": [np.stack(g["v"].to_numpy()).astype(raw).tobytes()]})

    def told(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("side")
        (x, ids), (y, others) = [(np.frombuffer(r["raw"], raw).reshape(len(r["ids"]), -1), np.asarray(r["ids"])) for r in (g.iloc[0], g.iloc[-1])]
        within = len(g) == 1
        i, j, c = near_tops(x, y, least, within, tile)
        best = _best(np.concatenate([ids[i], others[j]]), np.concatenate([others[j], ids[i]]), np.concatenate([c, c]))
        if not within:
            return best
        mine = np.flatnonzero(np.asarray(g.iloc[0]["twice"], bool))
        return pd.concat([best, pd.DataFrame({"id": ids[mine], "other": ids[mine], "c": _cosines(x[mine], x[mine])})])

    blocks = kept(dealt.groupBy("block").applyInPandas(packed, "block int, ids array<long>, twice array<boolean>, raw binary"))
    at = F.broadcast(blocks.select("block"))
    pairs = kept(at.select(F.col("block").alias("p")).crossJoin(at.select(F.col("block").alias("q"))).filter("p <= q"))
    both = [F.broadcast(pairs).join(blocks.withColumnRenamed("block", c), c).select("p", "q", F.lit(c).alias("side"), "ids", "twice", "raw") for c in "pq"]
    two = both[0].unionByName(both[1].filter("p <> q")).repartition(count * (count + 1) // 2, "p", "q")
    out = kept(two.groupBy("p", "q").applyInPandas(told, "id long, other long, c double"))
    # a vector's own row says how near its copies are to it
    own = out.filter("id = other").select(F.col("id").alias("one"), F.col("c").alias("alike")).filter(F.col("alike") >= least)
    rest = out.filter("id <> other").groupBy("id").agg(F.max(F.struct("c", (-F.col("other")).alias("less"))).alias("x"))
    every = rest.unionByName(copies.join(rest.withColumnRenamed("id", "one"), "one").select("id", "x"))
    of = own.join(twice, "one").select(F.col("one").alias("id"), F.col("second").alias("other"), "alike").unionByName(copies.join(own, "one").select("id", F.col("one").alias("other"), "alike"))
    every = every.unionByName(of.select("id", F.struct(F.col("alike").alias("c"), (-F.col("other")).alias("less")).alias("x")))
    return every.groupBy("id").agg(F.max("x").alias("x")).select("id", (-F.col("x.less")).alias("other"), F.col("x.c").alias("c"))

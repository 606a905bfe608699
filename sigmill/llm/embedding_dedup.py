"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import written
from sigmill.llm.components import Forest, connected_components

#: Rounding that the bound on distance allows for; the cosine itself is compared exactly.
SLACK = 1e-9


def reach(cosine: float) -> float:
    """Distance of unit vectors whose cosine is ``cosine``."""
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK


def directions(classes: DataFrame, width: int, lead: int, rounds: int = 3) -> np.ndarray:
    """Leading principal directions (width, lead) of all unit vectors, by subspace iteration.

    Every task multiplies its own vectors with the present directions; what meets is
    width x lead numbers a task, never width x width. Any orthonormal directions give
    right results; the better ones only prune more.
    """
    lead = min(lead, width)
    if lead == width:
        return np.eye(width)
    axes = np.linalg.qr(np.random.default_rng(7).normal(size=(width, lead)))[0]
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], axes: np.ndarray = axes) -> Iterator[pd.DataFrame]:
            total, mean, n = np.zeros((width, lead)), np.zeros(width), 0
            for b in batches:
                if len(b):
                    x = units_of(padded(b["vec"], width))
                    total += x.T @ (x @ axes)
                    mean += x.sum(0)
                    n += len(b)
            if n:
                yield pd.DataFrame({"k": np.arange(total.size + width + 1), "v": np.concatenate([total.ravel(), mean, [n]])})

        got = classes.select("vec").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
        total, mean, n = got[: width * lead].reshape(width, lead), got[width * lead : -1], got[-1]
        axes = np.linalg.qr(total / n - np.outer(mean / n, mean / n @ axes))[0]
    return axes


def usable(vec: str) -> Column:
    """Not null, not zero, every component there and finite."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def units_of(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths in double precision; scaled first, so that squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def padded(vecs: pd.Series, width: int, kind: str = "<f8") -> np.ndarray:
    """Vectors as rows, zeros behind those that are shorter than ``width``."""
    if not len(vecs):
        return np.zeros((0, width), kind)
    first = len(vecs.iloc[0])
    if all(len(v) == first for v in vecs):
        out = np.stack(vecs.to_numpy()).astype(kind)
        return out if first == width else np.pad(out, ((0, 0), (0, width - first)))
    return np.stack([np.pad(np.asarray(v, kind), (0, width - len(v))) for v in vecs])


def spots(x: np.ndarray, length: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """What bounds the distance of unit vectors from below, when taken as places.

    First the count of components, so far apart that unlike lengths never meet; then
    the places on the leading directions; last the length of what lies off them all,
    as that of two vectors differs by no more than the distance between them.
    """
    p = x @ axes
    off = np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))
    return np.column_stack([4.0 * length, p, off])


def in_grid_order(classes: DataFrame, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Blocks of up to ``block`` vectors that follow each other in grid order.

    Cells of width ``eps`` on the leading directions, compared one after another, order
    the vectors; Spark sorts them by range. A block carries its vectors and the
    least and largest value on each direction. Blocks are numbered through the tasks'
    counts of blocks: a row for each task is all that meets.
    """
    kind, width = _kind(classes), len(axes)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = spots(units_of(padded(b["vec"], width)), np.array([len(v) for v in b["vec"]]), axes)
                yield b[["cls", "n", "vec"]].assign(at=list(p), cell=list(np.floor(p / eps).astype(np.int32)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        part, made = TaskContext.get().partitionId(), 0

        def one(b: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            made += 1
            p, raw = np.stack(b["at"].to_numpy()), [padded(b["vec"], width, kind).tobytes()]
            size = [np.array([len(v) for v in b["vec"]], np.int32)]
            return pd.DataFrame({"part": [part], "at": [made - 1], "cls": [b["cls"].to_numpy(np.int64)], "n": [b["n"].to_numpy(np.int64)], "size": size, "raw": raw, "low": [p.min(0)], "high": [p.max(0)]})

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= block:
                rows = pd.concat(held)
                yield one(rows.iloc[:block])
                held = [rows.iloc[block:]]
        if sum(map(len, held)):
            yield one(pd.concat(held))

    cells = written(classes.select("cls", "n", "vec").mapInPandas(project, f"cls long, n long, vec {dict(classes.dtypes)['vec']}, at array<double>, cell array<int>"), "cells")
    made = cells.orderBy("cell", "cls").mapInPandas(cut, "part int, at int, cls array<long>, n array<long>, size array<int>, raw binary, low array<double>, high array<double>")
    made = written(made, "made-blocks")
    count = made.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    base = count.select("part", (F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")).alias("base"))
    return written(made.join(base, "part").withColumn("block", (F.col("base") + F.col("at")).cast("int")).drop("part", "at", "base"), "blocks")


def near_blocks(blocks: DataFrame, eps: float, fan: int = 8) -> DataFrame:
    """(a, b), a <= b: blocks that aren't provably distant.

    Intervals of the sequence are joined from the whole down: ``fan`` neighbours make
    an interval of the level above, whose box holds theirs. A pair of intervals whose
    boxes lie more than ``eps`` apart is dropped with all below it.
    """
    boxes = blocks.select(F.col("block").alias("id"), "low", "high")
    levels = [boxes]
    top = blocks.agg(F.max("block")).first()[0]
    while top:
        up = levels[-1].select((F.col("id") / fan).cast("int").alias("id"), F.posexplode(F.arrays_zip("low", "high")).alias("k", "r"))
        up = up.groupBy("id", "k").agg(F.min("r.low").alias("l"), F.max("r.high").alias("h")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "l", "h"))).alias("r"))
        levels.append(up.select("id", F.transform("r", lambda x: x["l"]).alias("low"), F.transform("r", lambda x: x["h"]).alias("high")))
        top //= fan
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in levels[-2::-1]:
        kids = level.withColumn("up", (F.col("id") / fan).cast("int"))
        x, y = (kids.select(F.col("up").alias(f"{s}"), F.col("id").alias(f"{s}_id"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high")) for s in "ab")
        both = pairs.join(x, "a").join(y, "b").filter("a_id <= b_id")
        gap = F.transform(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), lambda r: F.greatest(F.lit(0.0), r["a_low"] - r["b_high"], r["b_low"] - r["a_high"]))
        apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
        pairs = both.filter(apart <= eps * eps).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, cosine: float, same: bool, leaf: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one length with cosine at least ``cosine``, by halving both intervals.

    ``px`` and ``py`` hold the vectors' ``spots``, which bound the distance from below.
    """
    eps2 = reach(cosine) ** 2
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        p, q = px[a:b], py[c:d]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > eps2:
            continue
        if b - a <= leaf and d - c <= leaf:
            near = x[a:b] @ y[c:d].T >= cosine
            if p[0, 0] != p[-1, 0] or q[0, 0] != q[-1, 0] or p[0, 0] != q[0, 0]:
                near &= p[:, :1] == q[:, 0]
            i, j = np.nonzero(near)
            if same and a == c:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i + a, j + c
            continue
        m, k = ((a + b) // 2 if b - a > leaf else b), ((c + d) // 2 if d - c > leaf else d)
        for s in ((a, m), (m, b)):
            for t in ((c, k), (k, d)):
                if s[0] < s[1] and t[0] < t[1] and not (same and t[0] < s[0]):
                    stack.append((*s, *t))


def _kind(classes: DataFrame) -> str:
    """How a block keeps its vectors: as they came, so single precision takes half the room."""
    return "<f4" if dict(classes.dtypes)["vec"] == "array<float>" else "<f8"


def class_links(classes: DataFrame, width: int, cosine: float, lead: int, block: int, side: int = 8) -> DataFrame:
    """Rows (u, v, n): a link of a task's forest, or, with v null, ``n`` links of u.

    ``side`` blocks in a row of the sequence against ``side`` others are one task's work,
    so a block travels once for ``side`` others, not once for each; links leave the
    task counted, not listed. ``width`` is the count of components of the longest vector.
    """
    eps, kind = reach(cosine), _kind(classes)
    axes = directions(classes, width, lead)
    blocks = in_grid_order(classes, axes, eps, max(32, min(block, (1 << 18) // width)))
    tile = [F.floor(F.col(c) / side).cast("int").alias(f"t{c}") for c in "ab"]
    pairs = written(near_blocks(blocks, eps).select(*tile, "a", "b"), "block-pairs")
    wanted = pairs.select("ta", "tb", F.col("a").alias("block")).union(pairs.select("ta", "tb", F.col("b").alias("block"))).distinct()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        begin = np.cumsum([0, *(len(c) for c in rows["cls"])])
        ids, n = np.concatenate(rows["cls"].to_list()), np.concatenate(rows["n"].to_list())
        x = [units_of(np.frombuffer(r, kind).reshape(len(c), width)) for r, c in zip(rows["raw"], rows["cls"], strict=True)]
        p = [spots(v, np.asarray(s), axes) for v, s in zip(x, rows["size"], strict=True)]
        at = rows["block"].to_numpy() // side
        forest, count = Forest(len(ids)), np.zeros(len(ids), np.int64)
        for a in np.flatnonzero(at == key[0]):
            for b in np.flatnonzero(at == key[1]):
                if b < a:
                    continue
                for i, j in join_intervals(x[a], p[a], x[b], p[b], cosine, a == b):
                    i, j = i + begin[a], j + begin[b]
                    forest.add(i, j)
                    np.add.at(count, i, n[j])
                    np.add.at(count, j, n[i])
        root = forest.roots()
        far, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(count)
        v = pd.array(np.concatenate([ids[root[far]], np.zeros(len(some), np.int64)]), "Int64")
        v[len(far) :] = None
        return pd.DataFrame({"u": np.concatenate([ids[far], ids[some]]), "v": v, "n": np.concatenate([np.zeros(len(far), np.int64), count[some]])})

    work = wanted.join(blocks, "block").groupBy("ta", "tb")
    return written(work.applyInPandas(run, "u long, v long, n long"), "block-links")


def near_vectors(table: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = 0.95, lead: int = 16, block: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept) of every row, by cosine in double precision.

    Equal vectors fold into one class named by its least key, and count as linked to
    one another; so copies of any number cost one vector. Vectors that are null,
    zero, or hold null or non-finite components link with nothing, nor do vectors of
    another length. Rows that repeat a key stay rows; null keys count for nothing in the
    least. An empty table stays empty; other columns are left behind.
    """
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec"))
    rows = rows.withColumn("ok", usable("vec")).withColumn("cls_of", F.when(F.col("ok"), F.md5(F.to_json(F.struct("vec")).cast("binary"))))
    good = rows.filter("ok")
    classes = good.groupBy("cls_of").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    width = classes.agg(F.max(F.size("vec"))).first()[0]
    names = classes.select("cls", "least", "n", "cls_of")
    if not width:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    links = class_links(classes, width, cosine, lead, block)
    roots = written(connected_components(links.filter("v is not null").select("u", "v")), "roots")
    least = roots.join(names, roots["node"] == names["cls"]).groupBy("root").agg(F.min("least").alias("component_id"))
    least = roots.join(least, "root").select(F.col("node").alias("cls"), "component_id")
    count = links.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("out"))
    told = names.join(count, "cls", "left").join(least, "cls", "left")
    told = told.select("cls_of", (F.coalesce("out", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(written(told, "class-links"), "cls_of", "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))

"""Density clustering of vectors: core distances, a minimum spanning tree of mutual reachability, excess of mass.

Points lie in blocks of bounded size within the cells of a bounded sample of pivots. Pairs of
cells that are provably further apart than what is sought are left out. Blocks lie on a bounded number of sides,
every two of which go to one task. The tree grows by rounds in which every component takes its least edge outward; it is then read from
its shortest edge to its longest, a bounded band of edges at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.operators.graph import components, kept
from sigmill.sources.sinks import new_path

#: Least distance that is told apart from none, so that copies have a finite density.
FLOOR = 1e-9

#: Links up to which one task joins components.
FEW = 200_000

#: Sides of blocks at most, and the share of a matrix from which on its distances are made as a matrix.
SIDES, MANY = 16, 0.05

EDGE = "comp long, w double, a long, b long"
BAND = "kind string, id long, other long, size long, members array<long>, x double, y double"


def units(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, vec): vectors with a direction; those that are null, zero or not finite are left out."""
    x = F.col(vec).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    ok = x.isNotNull() & ~F.coalesce(bad, F.lit(True))
    kind = df.schema[vec].dataType.elementType.simpleString()
    return df.filter(ok).withColumn("_norm", norm).filter("_norm > 0").select(F.col(key).cast("long").alias("id"), F.col(vec).cast(f"array<{kind if kind == 'float' else 'double'}>").alias("vec"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine distances, to nine digits, so that equal ones stay equal however they are summed."""
    return np.maximum(np.round(1 - x @ y.T, 9), 0)


class Block:
    """A block's points: cell, ids in order, unit vectors in double and single precision, and what is told of them besides."""

    def __init__(self, row: object, kind: str) -> None:
        self.cell, self.sub, self.ids = row["cell"], row["sub"], np.asarray(row["ids"])
        self.x = _unit(np.frombuffer(row["raw"], kind).reshape(len(self.ids), -1))
        self.rough = self.x.astype(np.float32)
        self.more = {c: np.asarray(row[c]) for c in ("d", "comp", "core", "best") if c in row}


def _slack(b: Block) -> float:
    """What a distance made in single precision may be off by: each product by a few units of that, and so each of their sums."""
    return (b.x.shape[1] + 8) * 1.2e-7 + 1e-8


def near(a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): pairs of points of two blocks that are no further apart than p[i] or q[j], among others if there are many; of a block with itself no point meets itself.

    Products in single precision tell which may be; only these are told in double precision.
    """
    s, slack = a.rough @ b.rough.T, _slack(a)
    close = (s >= (1 - p - slack).astype(np.float32)[:, None]) | (s >= (1 - q - slack).astype(np.float32)[None])
    if a is b:
        np.fill_diagonal(close, False)
    if "comp" in a.more and np.count_nonzero(close) > 1000:
        close &= a.more["comp"][:, None] != b.more["comp"][None]
    i, j = np.divmod(np.flatnonzero(close), close.shape[1])
    if len(i) > close.size * MANY:
        return i, j, distances(a.x, b.x)[i, j]
    d = [np.zeros(0), *(np.einsum("ij,ij->i", a.x[i[k : k + 65_536]], b.x[j[k : k + 65_536]]) for k in range(0, len(i), 65_536))]
    return i, j, np.maximum(np.round(1 - np.concatenate(d), 9), 0)


class Blocks:
    """Blocks (side, cell, sub, ids, raw) as a table, their vectors' type, how many sides they lie on, and the least distance between each two cells."""

    def __init__(self, rows: DataFrame, kind: str, sides: int, low: np.ndarray) -> None:
        self.rows, self.kind, self.sides, self.low = rows, kind, sides, low

    def each(self, told: DataFrame | None, within: bool, found: Callable[[list[Block], list[Block]], Iterator[pd.DataFrame]], shape: str) -> DataFrame:
        """Runs ``found`` on the blocks of every two sides, or of each side alone (``within``, twice the same list); told: more arrays (cell, sub, ...) of each block, in the order of its ids."""
        rows, sides, kind = self.rows if told is None else self.rows.join(told, ["cell", "sub"]), self.sides, self.kind
        pairs = [(p, q) for p in range(sides) for q in range(p, sides) if (p == q) == within]
        to = F.broadcast(rows.sparkSession.createDataFrame([(side, n) for n, pair in enumerate(pairs) for side in sorted(set(pair))], "side int, pair int"))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            parts = [[Block(r, kind) for _, r in g.sort_values(["cell", "sub"]).iterrows()] for _, g in group.groupby("side")]
            return pd.concat([*found(parts[0], parts[-1])] or [pd.DataFrame({c.split()[0]: [] for c in shape.split(", ")})])

        # four places for each pair, so that few pairs share one
        return rows.join(to, "side").repartition(4 * max(1, len(pairs)), "pair").groupBy("pair").applyInPandas(run, shape)


def in_blocks(points: DataFrame, pivots: int, block: int) -> Blocks:
    """Blocks of points in order of their ids.

    ``pivots`` points, a bounded sample, name the cells; a cell that holds more than ``block`` points has several
    blocks. Only pivots and the cells' counts and radii, a row each, are brought together.
    """
    some = points.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").toPandas()["vec"]
    mid, kind = _unit(np.stack(some.to_numpy())), {"float": "<f4"}.get(points.schema["vec"].dataType.elementType.simpleString(), "<f8")

    def dealt_to(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(np.stack(b["vec"].to_numpy()))
                c = (x @ mid.T).argmax(1)
                yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "cell": c, "r": np.sqrt(((x - mid[c]) ** 2).sum(1))})

    dealt = kept(points.mapInPandas(dealt_to, f"id long, vec {points.schema['vec'].dataType.simpleString()}, cell int, r double"))
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).orderBy("cell").toPandas()
    names = [(int(c), k, math.ceil(n / block)) for c, n in zip(cells["cell"], cells["n"], strict=True) for k in range(math.ceil(n / block))]
    sides = max(1, min(SIDES, len(names), -(-int(cells["n"].sum()) // (4 * block))))
    where = points.sparkSession.createDataFrame([(c, k, n, at * sides // len(names)) for at, (c, k, n) in enumerate(names)], "cell int, sub int, subs int, side int")
    radius = np.zeros(len(mid))
    radius[cells["cell"]] = cells["r"]
    low = np.maximum(0, np.sqrt(np.maximum(((mid[:, None] - mid[None]) ** 2).sum(2), 0)) - radius[:, None] - radius[None] - 1e-9) ** 2 / 2

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"cell": [key[0]], "sub": [key[1]], "ids": [rows["id"].to_numpy()], "raw": [np.stack(rows["vec"].to_numpy()).astype(kind).tobytes()]})

    split = dealt.join(F.broadcast(where.select("cell", "subs").distinct()), "cell").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    blocks = split.select("cell", "sub", "id", "vec").groupBy("cell", "sub").applyInPandas(packed, "cell int, sub int, ids array<long>, raw binary")
    return Blocks(kept(blocks.join(F.broadcast(where.select("cell", "sub", "side")), ["cell", "sub"])), kind, sides, low)


def _least(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least d of each id."""
    order = np.lexsort((d, ids))
    ids, d = ids[order], d[order]
    first = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    ok = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0)) < k
    return ids[ok], d[ok]


def core_distances(blocks: Blocks, k: int) -> DataFrame:
    """(id, core): distance of each point from its ``k``-th nearest other one, or the furthest if there are fewer.

    First among the points of its side; then only nearer ones are looked for.
    """
    low, shape = blocks.low, "id long, d double"

    def found(mine: list[Block], others: list[Block]) -> Iterator[pd.DataFrame]:
        within, every = mine is others, mine if mine is others else mine + others
        most = [np.array(b.more["d"], float) if "d" in b.more else _within_block(b, k) for b in every]
        held = [(np.zeros(0, int), np.zeros(0)) for _ in every]
        for x, a in enumerate(mine):
            for y, b in list(enumerate(every))[x if within else len(mine) :]:
                if low[a.cell, b.cell] > max(most[x].max(), most[y].max()):
                    continue
                i, j, d = near(a, b, most[x], most[y])
                # a block with itself has each pair both ways
                for of, at in ((x, i), (y, j))[: 1 if a is b else 2]:
                    at, least = held[of] = _least(np.append(held[of][0], at), np.append(held[of][1], d), k)
                    last = np.flatnonzero(np.bincount(at, minlength=len(most[of])) == k)
                    ends = np.searchsorted(at, last, "right") - 1
                    most[of][last] = np.minimum(most[of][last], least[ends])
        for b, (at, d) in zip(every, held, strict=True):
            yield pd.DataFrame({"id": b.ids[at], "d": d})

    inner = kept(blocks.each(None, True, found, shape))
    both = inner
    if blocks.sides > 1:
        far = inner.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(3.0).alias("d"))
        points = blocks.rows.select("cell", "sub", F.explode("ids").alias("id")).join(far, "id", "left").fillna(3.0, ["d"])
        both = inner.unionByName(blocks.each(_told(points, "d"), False, found, shape))
    ranked = both.selectExpr("id", "d", "row_number() over (partition by id order by d) as r").filter(F.col("r") <= k)
    return kept(ranked.groupBy("id").agg(F.max("d").alias("core")))


def _told(points: DataFrame, *columns: str) -> DataFrame:
    """Columns of points (cell, sub, id, ...) as arrays of each block, in the order of its ids."""
    t = points.groupBy("cell", "sub").agg(F.array_sort(F.collect_list(F.struct("id", *columns))).alias("t"))
    return t.select("cell", "sub", *[F.col(f"t.{c}").alias(c) for c in columns])


def _within_block(b: Block, k: int) -> np.ndarray:
    """No less than the distance of each point from its ``k``-th nearest one of the block."""
    if len(b.ids) <= k:
        return np.full(len(b.ids), 3.0)
    s = b.rough @ b.rough.T
    np.fill_diagonal(s, -3)
    return 1 - np.partition(s, len(b.ids) - k, axis=1)[:, len(b.ids) - k].astype(float) + _slack(b)


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of what is linked; one task joins links up to a checked number, rounds of joins those beyond it."""
    if links.count() > FEW:
        return components(links)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in zip(rows["a"], rows["b"], strict=True):
            a, b = find(int(a)), find(int(b))
            up[max(a, b)] = min(a, b)
        return pd.DataFrame({"node": list(up), "root": [find(x) for x in list(up)]}, dtype="int64")

    return kept(links.select("a", "b", F.lit(1).alias("one")).groupBy("one").applyInPandas(run, "node long, root long"))


def _firsts(comp: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Least edge of each component; equal ones by their ends."""
    order = np.lexsort((hi, lo, w, comp))
    first = np.append(True, comp[order][1:] != comp[order][:-1])[: len(order)]
    return [x[order[first]] for x in (comp, w, lo, hi)]


def spanning_tree(blocks: Blocks, cores: DataFrame) -> DataFrame:
    """(a, b, w): the minimum spanning tree of mutual reachability; equal weights are ordered by their ends.

    In each round components first look within their points' sides, then for edges that are
    no longer than what they found; so their number halves at least.
    """
    low = blocks.low

    def found(mine: list[Block], others: list[Block]) -> Iterator[pd.DataFrame]:
        within, every = mine is others, mine if mine is others else mine + others
        names, at = np.unique(np.concatenate([b.more["comp"] for b in every]), return_inverse=True)
        of = np.split(at, np.cumsum([len(b.ids) for b in every])[:-1])
        most = np.full(len(names), 3.0)
        for b, c in zip(every, of, strict=True):
            if not within:
                np.minimum.at(most, c, b.more["best"])
                continue
            # no less than the least edge within the block
            s = b.rough @ b.rough.T
            s[c[:, None] == c[None]] = -3
            to = s.argmax(1)
            ok = s[np.arange(len(s)), to] > -3
            w = np.maximum(1 - s[np.arange(len(s)), to].astype(float) + _slack(b), np.maximum(b.more["core"], b.more["core"][to]))
            np.minimum.at(most, c[ok], w[ok])
        edges = []
        for x, a in enumerate(mine):
            for y, b in list(enumerate(every))[x if within else len(mine) :]:
                p, q = (np.where(z.more["core"] <= most[of[k]], most[of[k]], -1.0) for k, z in ((x, a), (y, b)))
                if low[a.cell, b.cell] > max(p.max(), q.max()):
                    continue
                i, j, d = near(a, b, p, q)
                w = np.maximum(d, np.maximum(a.more["core"][i], b.more["core"][j]))
                lo, hi = np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])
                for c in (of[x][i], of[y][j]):
                    ok = (w <= most[c]) & (of[x][i] != of[y][j])
                    edges.append(_firsts(c[ok], w[ok], lo[ok], hi[ok]))
                    np.minimum.at(most, edges[-1][0], edges[-1][1])
        if edges:
            comp, w, lo, hi = _firsts(*(np.concatenate(z) for z in zip(*edges, strict=True)))
            yield pd.DataFrame({"comp": names[comp], "w": w, "a": lo, "b": hi})

    places = kept(blocks.rows.select("cell", "sub", F.explode("ids").alias("id")).join(cores, "id"))
    state, tree, least = kept(places.select("id", F.col("id").alias("comp"))), None, F.min(F.struct("w", "a", "b")).alias("e")
    while True:
        now = kept(places.join(state, "id"))
        best = inner = kept(blocks.each(_told(now, "comp", "core"), True, found, EDGE).groupBy("comp").agg(least))
        if blocks.sides > 1:
            have = now.join(inner.select("comp", F.col("e.w").alias("best")), "comp", "left").fillna(3.0, ["best"])
            outer = blocks.each(_told(have, "comp", "core", "best"), False, found, EDGE).groupBy("comp").agg(least)
            best = inner.unionByName(outer).groupBy("comp").agg(F.min("e").alias("e"))
        new = kept(best.select("e.*").distinct())
        if not new.limit(1).count():
            return tree if tree is not None else new.select("a", "b", "w")
        tree = kept(new.select("a", "b", "w") if tree is None else tree.unionByName(new.select("a", "b", "w")))
        end = state.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        links = new.join(state.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(end, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        roots = _joined(kept(links))
        state = kept(state.join(roots, state["comp"] == roots["node"], "left").select("id", F.coalesce("root", "comp").alias("comp")))
        # a round that finds nothing has no bound, so it would compare all blocks
        if state.select("comp").distinct().limit(2).count() < 2:
            return tree


def _read_band(band: int, least: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Joins the components of a band of edges in order; tells what changed.

    ``tip``: a component (id, its cluster, size, members while it is small, mass x, worth y of the clusters below);
    ``moved``: its old name; ``fell``: a point and the cluster it left; ``cluster``: one that ended (its parent, stability x, worth y below).
    """

    def run(edges: pd.DataFrame, tips: pd.DataFrame) -> pd.DataFrame:
        out, name, state = [], {}, {}
        for t in tips.itertuples():
            small = pd.isna(t.other)
            state[t.id] = (t.size, [int(m) for m in t.members] if small else None, None if small else int(t.other), t.x, t.y)

        def find(c: int) -> int:
            while name.get(c, c) != c:
                name[c] = c = name.get(name[c], name[c])
            return c

        for k, e in enumerate(edges.sort_values(["w", "a", "b"]).itertuples()):
            a, b, dense = find(e.ca), find(e.cb), 1 / max(e.w, FLOOR)
            (na, ma, ka, xa, ya), (nb, mb, kb, xb, yb) = (state.pop(c, (1, [c], None, 0.0, 0.0)) for c in (a, b))
            n, new = na + nb, band << 32 | k
            if ka is not None and kb is not None:
                worth = 0.0
                for c, size, x, y in ((ka, na, xa, ya), (kb, nb, xb, yb)):
                    out.append(("cluster", c, new, size, None, x - size * dense, y))
                    worth += max(x - size * dense, y)
                made = (n, None, new, n * dense, worth)
            elif ka is not None or kb is not None:
                c, x, y, left = (ka, xa, ya, mb) if ka is not None else (kb, xb, yb, ma)
                out += [("fell", m, c, None, None, None, None) for m in left]
                made = (n, None, c, x + len(left) * dense, y)
            elif n >= least:
                out += [("fell", m, new, None, None, None, None) for m in ma + mb]
                made = (n, None, new, n * dense, 0.0)
            else:
                made = (n, ma + mb, None, 0.0, 0.0)
            name[max(a, b)] = min(a, b)
            state[min(a, b)] = made
        out += [("tip", c, k, n, m, x, y) for c, (n, m, k, x, y) in state.items()]
        out += [("moved", c, find(c), None, None, None, None) for c in list(name) if find(c) != c]
        told = pd.DataFrame(out, columns=["kind", "id", "other", "size", "members", "x", "y"])
        return told.astype({"id": "Int64", "other": "Int64", "size": "Int64"})

    return run


def condensed(tree: DataFrame, least: int, band: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) in which each point was last, and (cluster, parent, stability, below) of all but the root.

    One task reads at most ``band`` edges, between two weights; later edges then name
    the components that it left. Small ones keep their points, fewer than ``least``.
    """
    spark = tree.sparkSession
    edges = kept(tree.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    n = edges.count()
    if not n:
        return spark.createDataFrame([], "id long, cluster long"), spark.createDataFrame([], "cluster long, parent long, stability double, below double")
    tips, told = spark.createDataFrame([], BAND), None
    row = kept(edges.orderBy("w", "a", "b").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = row.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("at") - F.col("first")
    edges = kept(row.join(parts.select("part", "first", before.alias("before")), "part").select("a", "b", "w", "ca", "cb", F.floor(place / band).alias("band")))
    for k in range(math.ceil(n / band)):
        here = edges.filter(F.col("band") == k)
        ends = here.select(F.explode(F.array("ca", "cb")).alias("id")).distinct()
        left, right = (t.withColumn("one", F.lit(1)).groupBy("one") for t in (here, tips.join(ends, "id", "left_semi")))
        made = kept(left.cogroup(right).applyInPandas(_read_band(k, least), BAND))
        moved = made.filter("kind = 'moved'").select("id", "other")
        edges = edges.filter(F.col("band") > k)
        for c in ("ca", "cb"):
            edges = edges.join(moved.select(F.col("id").alias(c), F.col("other").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = kept(edges)
        tips = kept(tips.join(ends, "id", "left_anti").unionByName(made.filter("kind = 'tip'")))
        found = made.filter("kind in ('fell', 'cluster')")
        told = kept(found if told is None else told.unionByName(found))
    fell = told.filter("kind = 'fell'").select("id", F.col("other").alias("cluster"))
    ended = told.filter("kind = 'cluster'").select(F.col("id").alias("cluster"), F.col("other").alias("parent"), F.col("x").alias("stability"), F.col("y").alias("below"))
    return fell, ended


def chosen(ended: DataFrame) -> DataFrame:
    """(cluster, top): the topmost cluster above each one, or itself, that is worth no less than all below it together; the root never is.

    Paths upward are doubled in each round, so their number grows with the depth's logarithm. Rounds are written and read again, as a checkpoint
    keeps what the planner has inferred of its columns, which doubles with each round too.
    """
    spark = ended.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = new_path(spark, "paths")
        df.write.parquet(path)
        return spark.read.parquet(path)

    now = written(ended.select("cluster", F.col("parent").alias("up"), F.when(F.col("stability") >= F.col("below"), F.col("cluster")).alias("top")))
    while True:
        above = now.select(F.col("cluster").alias("c2"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        new = written(now.join(above, F.col("up") == F.col("c2"), "left").select("cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")))
        if not new.filter("up is not null").limit(1).count():
            return new.select("cluster", "top")
        now = new


def density_clusters(df: DataFrame, key: str, vec: str, least: int = 2, neighbours: int = 2, pivots: int = 64, block: int = 2048, band: int = 500_000) -> DataFrame:
    """(key, cluster): hierarchical density clusters by cosine distance, named by their least key; -1 is noise.

    ``least`` points make a cluster, ``neighbours`` tell how dense a point lies. Clusters are those whose excess of mass
    is no less than that of the clusters within them. Keys are distinct; vectors that are null, zero
    or not finite are noise. Work grows with the square of the points where cells can't be told apart.
    """
    points = kept(units(df, key, vec))
    rows = df.select(F.col(key).cast("long").alias(key))
    if points.limit(2).count() < 2:
        return rows.select(key, F.lit(-1).cast("long").alias("cluster"))
    blocks = in_blocks(points, min(pivots, 1 + points.count() // (block // 4)), block)
    tree = spanning_tree(blocks, core_distances(blocks, neighbours))
    fell, ended = condensed(tree, least, band)
    found = fell.join(chosen(ended), "cluster").filter("top is not null").select("id", "top")
    name = found.groupBy("top").agg(F.min("id").alias("name"))
    found = found.join(name, "top").select(F.col("id").alias("_id"), "name")
    return rows.join(found, rows[key] == found["_id"], "left").select(key, F.coalesce("name", F.lit(-1)).alias("cluster"))

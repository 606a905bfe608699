"""SimHash near-duplicates by a self-join of a binary trie of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm import shingles
from sigmill.llm.common import aside, written
from sigmill.llm.components import Forest, connected_components

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text as a signed number; 0 without words.

    Words lose the case of A-Z; shingles count as often as they occur; fewer words
    than a shingle has make one shingle.
    """
    return _majority(shingles.hashes(text, words, seed))


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 16):  # a long text never unpacks as a whole
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (long) of every row; written, as each text is hashed once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("th"), F.col("text").cast("string").alias("text"))
    return _hashed(slim, words).drop("th")


def _hashed(slim: DataFrame, words: int) -> DataFrame:
    """doc_id, th and fp of rows with ``doc_id``, ``th`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], ["doc_id", "th", "fp"])

    return written(slim.mapInArrow(run, "doc_id long, th long, fp long"), "fingerprints")


def trie_pairs(x: np.ndarray, y: np.ndarray, depth: int, budget: int, same: bool, leaf: int = 256, most: int = 1 << 16, start: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``x`` and ``y`` that differ in at most ``budget`` bits.

    Both are sorted, so a run of either is a trie node: its members share their first
    ``depth`` bits. Pairs of nodes are followed down together; a step into unlike
    children costs one bit of the budget, and pairs without budget are dropped. Small
    pairs of nodes are compared member by member. Deepest first, at most ``most``
    pairs of nodes at a time, so memory stays bounded. ``start`` gives the pairs of
    nodes to begin with (bounds of each, bits that differ) if not the two wholes.
    """
    one = np.uint64(1)
    if start is None:
        start = tuple(np.array([v]) for v in (0, len(x), 0, len(y), 0))
    stack = [(depth, start)] if len(x) and len(y) else []
    while stack:
        depth, node = stack.pop()
        if len(node[0]) > most:
            half = len(node[0]) // 2
            stack += [(depth, tuple(v[:half] for v in node)), (depth, tuple(v[half:] for v in node))]
            continue
        al, ah, bl, bh, d = node
        size = (ah - al) * (bh - bl)
        small = (size <= leaf) | (depth >= BITS)
        for lo in range(0, int(small.sum()), max(1, 4 * most // leaf)):
            s = np.flatnonzero(small)[lo : lo + max(1, 4 * most // leaf)]
            k = np.repeat(np.arange(len(s)), size[s])
            off = np.arange(len(k)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
            wide = (bh - bl)[s][k]
            i, j = al[s][k] + off // wide, bl[s][k] + off % wide
            near = np.bitwise_count(x[i] ^ y[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        al, ah, bl, bh, d = (v[~small] for v in node)
        if not len(al):
            continue
        bit = np.uint64(BITS - 1 - depth)

        def split(z: np.ndarray, lo: np.ndarray) -> np.ndarray:
            return np.searchsorted(z, ((z[lo] >> bit) | one) << bit)

        am, bm = np.minimum(split(x, al), ah), np.minimum(split(y, bl), bh)
        twin = same & (al == bl)
        kids = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1)]
        kids.append(tuple(v[~twin] for v in (am, ah, bl, bm, d + 1)))
        down = tuple(np.concatenate(v) for v in zip(*kids, strict=True))
        live = (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= budget)
        stack.append((depth + 1, tuple(v[live] for v in down)))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(mask: int, budget: int) -> list[int]:
    """``mask`` with one more run of its free bits each: these are cut into one run more than ``budget``."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    ends = [len(free) * k // (budget + 1) for k in range(budget + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]


def _leading(fp: np.ndarray, mask: int) -> np.ndarray:
    """Fingerprints with the bits of ``mask`` moved in front of all others."""
    out = np.zeros_like(fp)
    at = [b for b in range(BITS) if not mask >> b & 1] + [b for b in range(BITS) if mask >> b & 1]
    for to, b in enumerate(at):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(to)
    return out


def links(nodes: DataFrame, budget: int = 2, per_node: int = 8192) -> DataFrame:
    """(u, v): links that join up the same components as all pairs within ``budget`` bits.

    ``nodes`` holds distinct fingerprints ``fp``. The bits are cut into ``budget`` + 1 runs;
    two fingerprints within the budget agree on one run at least, so with each run in
    front in turn they share a subtree of that trie. Subtrees are joined with
    themselves, many small ones in a task. A subtree with more than ``per_node`` members is
    cut once more, its free bits into runs; one that is crowded still, as a group of near copies is, is
    dealt out in tiles, pairs of parts of about ``per_node`` members, whose work grows with the square of
    that one subtree. So no task holds a crowded subtree, whatever the prefixes. Tasks return
    forests: links grow with members, not pairs.
    """
    found, rows, masks = [], nodes.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    for _ in range(2):
        ways = {m: _blocks(m, budget) for m in masks}
        to = F.create_map(*[x for m, kids in ways.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)).cast("long") for k in kids]))])
        each = rows.select("fp", F.explode(F.element_at(to, F.col("mask"))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        count = written(each.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "subtrees")
        each = each.join(count, ["mask", "key"])
        found.append(_joined(each.filter(F.col("n") <= per_node), count.filter(F.col("n") <= per_node).agg(F.sum("n")).first()[0] or 0, budget, per_node))
        masks = [r.mask % (1 << BITS) for r in count.filter(F.col("n") > per_node).select("mask").distinct().collect()]  # so many as there are ways to cut bits, whatever the table
        if not masks:
            break
        rows = written(each.filter(F.col("n") > per_node), "crowded")
    else:
        found.append(_tiled(rows, budget, per_node))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _tiled(each: DataFrame, budget: int, per_node: int) -> DataFrame:
    """Forest links of crowded subtrees: every two parts of one, and each with itself, are one group."""
    parts = F.ceil(F.col("n") / per_node).cast("int")
    cut = each.withColumns({"part": F.pmod(F.xxhash64("fp"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    cut = cut.select("mask", "key", "fp", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp, part, same = rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy(), key[2] == key[3]
        x = np.sort(fp[part == key[2]])
        y = x if same else np.sort(fp[part == key[3]])
        out, shift = (x, 0) if same else (np.concatenate([x, y]), len(x))
        forest = Forest(len(out))
        for i, j in trie_pairs(x, y, 0, budget, same):
            forest.add(i, j + shift)
        root = forest.roots()
        far = root != np.arange(len(out))
        return pd.DataFrame({"u": out[far].view(np.int64), "v": out[root[far]].view(np.int64)})

    return cut.groupBy("mask", "key", "a", "b").applyInPandas(join, "u long, v long")


def _joined(each: DataFrame, members: int, budget: int, per_node: int) -> DataFrame:
    """Forest links of subtrees of up to ``per_node`` members each, dealt out to tasks by mask and key."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mask = int(key[0]) % (1 << BITS)
        depth, fp = mask.bit_count(), rows["fp"].to_numpy().view(np.uint64)
        x = _leading(fp, mask)
        order = np.argsort(x)
        x, fp = x[order], fp[order].view(np.int64)
        first = np.flatnonzero(np.append(True, x[1:] >> np.uint64(BITS - depth) != x[:-1] >> np.uint64(BITS - depth)))
        last = np.append(first[1:], len(x))
        first, last = first[last - first > 1], last[last - first > 1]
        forest = Forest(len(x))
        for i, j in trie_pairs(x, x, depth, budget, True, start=(first, last, first, last, np.zeros(len(first), np.int64))):
            forest.add(i, j)
        root = forest.roots()
        far = root != np.arange(len(x))
        return pd.DataFrame({"u": fp[far], "v": fp[root[far]]})

    tasks = max(1, -(-members // (4 * per_node)))
    dealt = each.select("fp", "mask", F.pmod(F.xxhash64("mask", "key"), F.lit(tasks)).alias("b"))
    return dealt.groupBy("mask", "b").applyInPandas(join, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable.

    Equal fingerprints fold into one node first, so groups of copies of any size cost
    one member. Null and empty texts have fingerprint 0 and link as any other. Rows
    that repeat a doc_id stay rows of their own; null ids count for nothing in the
    least, and a component of null ids alone has a null id. An empty table stays empty.
    """
    fps = fingerprints(docs, words)
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = written(connected_components(links(nodes, budget)), "roots")
    named = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    class_of = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(written(class_of, "classes"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, budget: int = 2, similarity: float | None = None) -> DataFrame:
    """Documents without all but one of each group of near-duplicates, columns as they came.

    Near-duplicates differ in at most ``budget`` bits or, where ``similarity`` is given,
    have sets of shingles with at least that Jaccard similarity.

    Rows are told apart by doc_id and a hash of the text: unlike texts under one id, or
    without any, stay rows of their own. A group keeps its least doc_id (null comes last)
    and of that the least hash; rows equal in both are copies, of which one stays.
    """
    if similarity is not None:
        return _keep_one_like(docs, words, budget, similarity)
    rows = _hashed(_keyed(docs), words)
    classes = written(rows.groupBy("fp").agg(F.min(_key(rows)).alias("least")), "nodes")
    roots = written(connected_components(links(classes, budget)), "roots")
    return _kept(docs, rows, classes.join(roots, classes["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least"))


def _keep_one_like(docs: DataFrame, words: int, budget: int, similarity: float) -> DataFrame:
    slim = _keyed(docs)
    often, rank = shingles.frequent(slim, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            fp, node, size, first, maps = [], [], [], [], [np.zeros((0, shingles.MAP), np.int64)]
            for t in b.column("text").to_pylist():
                h = shingles.hashes(t, words)
                u = np.unique(h)
                fp.append(_majority(h))
                node.append(int(np.uint64(xxhash.xxh64_intdigest(u.tobytes())).view(np.int64)))
                size.append(len(u))
                first.append(shingles.prefix(u, similarity, often, rank).view("<i8"))
                maps.append(shingles.parities(u)[None])
            told = [pa.array(fp, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            told += [pa.array(c) for c in np.concatenate(maps).T.copy()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *told], ["doc_id", "th", "fp", "node", "size", "prefix", *shingles.MAP_COLUMNS])

    kinds = ", ".join(f"{c} long" for c in shingles.MAP_COLUMNS)
    rows = written(slim.mapInArrow(run, f"doc_id long, th long, fp long, node long, size long, prefix array<long>, {kinds}"), "profiles")
    classes = rows.groupBy("fp", "node").agg(F.min(_key(rows)).alias("least")).withColumn("class", F.xxhash64("fp", "node"))
    classes = written(classes, "classes")
    one_of = [F.first(c).alias(c) for c in ("size", "prefix", *shingles.MAP_COLUMNS)]
    sets = written(rows.groupBy("node").agg(*one_of, F.min("th").alias("th")), "sets")
    edges = None
    for by, found in (("fp", links(classes.select("fp").distinct(), budget)), ("node", shingles.like_pairs(sets, slim, words, similarity))):
        least = written(classes.groupBy(by).agg(F.min("class").alias("class")), "least")
        of = [least.select(F.col(by).alias(c), F.col("class").alias(f"class_{c}")) for c in ("u", "v")]
        pairs = found.join(of[0], "u").join(of[1], "v").select(F.col("class_u").alias("u"), F.col("class_v").alias("v"))
        same = classes.select(F.col("class").alias("u"), by).join(least, by).select("u", F.col("class").alias("v"))
        pairs = pairs.unionByName(same)
        edges = pairs if edges is None else edges.unionByName(pairs)
    roots = written(connected_components(edges), "roots")
    return _kept(docs, rows, classes.join(roots, classes["class"] == roots["node"], "left").select(F.coalesce("root", "class").alias("root"), "least"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


def _key(rows: DataFrame) -> Column:
    return F.struct(rows["doc_id"].isNull().alias("none"), rows["doc_id"].alias("doc_id"), rows["th"].alias("th"))


def _kept(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is the least of its ``root``; one of each key. ``rows`` holds all keys."""
    least = classes.groupBy("root").agg(F.min("least").alias("least"))
    ids = written(least.select(F.col("least.doc_id").alias("_kept"), F.col("least.th").alias("_hash")), "kept")
    docs, (key, text), back = aside(docs, "doc_id", "text")
    same = F.col(key).cast("long").eqNullSafe(F.col("_kept")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_hash"))
    left = docs.join(ids.hint("merge"), same, "left_semi")
    again = rows.groupBy("doc_id", "th").count().filter("count > 1")
    again = again.join(ids, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("th") == F.col("_hash")), "left_semi")
    return (left.dropDuplicates([key, text]) if again.limit(1).count() else left).select(*back)


def document_components(docs: DataFrame) -> DataFrame:
    """Digest over ``documents``: fingerprint and component of each."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

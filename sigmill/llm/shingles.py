"""Pairs of texts with like sets of word shingles, by a prefix-filtered join with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import written
from sigmill.llm.components import connected_components

# Share of texts in the sample for frequent shingles, its least count, and the longest list.
SAMPLE, OFTEN, MOST = 16, 8, 50_000
#: Nodes of a token that all others of the token are compared with first.
STARS = 8
#: Words of 64 bits in a set's parity map.
MAP = 4
MAP_COLUMNS = [f"b{k}" for k in range(MAP)]


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z without case; fewer words make one run, none none."""
    w = (text or "").encode().lower().split()
    if not w:
        return []
    return [b" ".join(r) for r in zip(*(w[k:] for k in range(words)), strict=False)] if len(w) >= words else [b" ".join(w)]


def hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(text, words)], "<u8")


def prefix(h: np.ndarray, similarity: float, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """First hashes of a set, of which two sets with ``similarity`` share one at least.

    All sets are put in one order: hashes that aren't ``often`` (sorted) by value, the
    others behind them by ``rank``.
    """
    at = np.zeros(len(h), np.int64)
    if len(often):
        k = np.minimum(np.searchsorted(often, h), len(often) - 1)
        at = np.where(often[k] == h, rank[k] + 1, 0)
    return h[np.lexsort((h, at))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def parities(h: np.ndarray) -> np.ndarray:
    """Parity map of a set of hashes: a bit for each remainder, set if an odd count of members has it.

    Two maps differ in no more bits than the sets have members that only one of them
    holds, so the maps rule out pairs without their texts, and never a wrong one.
    """
    odd = np.bincount((h & np.uint64(64 * MAP - 1)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def frequent(slim: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of shingles that many texts of a sample hold.

    It only puts them last in the order of prefixes, so a shingle that is missed costs
    time but no pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tok": np.concatenate([np.zeros(0, "<u8"), *(np.unique(hashes(t, words)) for t in b["text"])]).view("<i8")})

    some = slim.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0).select("text").mapInPandas(run, "tok long")
    top = some.groupBy("tok").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "tok").limit(MOST).collect()
    h = np.array([r.tok for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def like_pairs(nodes: DataFrame, slim: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v) node links that join up the same components as all pairs of at least ``similarity``.

    ``nodes`` has a row for each distinct set: node, size, prefix, parity map, and th, the
    hash of one of its texts in ``slim``. Tokens that only one node has meet no one and are
    left out before anything is joined to them. Nodes of a token are first compared with a few of them; what
    is in one component then isn't compared again, so a large group of near copies costs
    few pairs. Candidates must share as many prefix hashes as the similarity needs, with maps
    no further apart than it allows, and
    are then decided by the exact Jaccard similarity of the sets of shingles.
    """
    each = nodes.select("node", F.explode("prefix").alias("tok"))
    w = W.partitionBy("tok").orderBy(F.xxhash64("node"), "node")
    each = each.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("tok"))).filter("n > 1")
    each = written(each.select("node", "tok", F.row_number().over(w).alias("at")), "shared-tokens")
    told = nodes.select("node", "size", (F.col("size") - F.size("prefix")).alias("rest"), *MAP_COLUMNS)
    each = written(each.join(told, "node"), "tokens")
    first = candidates(each.withColumn("root", F.col("node")), each.filter(F.col("at") <= STARS).withColumn("root", F.col("node")), similarity, whole=False)
    first = written(first, "first-pairs")
    one = written(verified(first, nodes, slim, words, similarity), "first-links")
    each = each.join(connected_components(one), "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = written(each, "rooted")
    second = candidates(each, each, similarity, whole=True).join(first, ["u", "v"], "left_anti")
    return one.unionByName(verified(written(second, "second-pairs"), nodes, slim, words, similarity))


def candidates(each: DataFrame, stars: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """(u, v) pairs with a common token whose sizes, maps, and common tokens if ``whole``, allow the similarity."""
    s = stars.select("tok", *[F.col(c).alias(f"_{c}") for c in ("node", "size", "rest", "at", "root", *MAP_COLUMNS)])
    near = F.least("size", "_size") >= similarity * F.greatest("size", "_size") - 1e-6
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in MAP_COLUMNS), F.lit(0))
    near &= apart <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("_size")) + 1e-6
    pairs = each.join(s, "tok").filter((F.col("_at") < F.col("at")) & (F.col("root") != F.col("_root")) & near)
    need = similarity / (1 + similarity) * (F.col("size") + F.col("_size")) - 1e-6
    pairs = pairs.groupBy(F.least("node", "_node").alias("u"), F.greatest("node", "_node").alias("v"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("common"), F.first(need).alias("need"), F.first(F.greatest("rest", "_rest")).alias("rest"))
    # Of the set whose prefix ends first, all that is in common lies in both prefixes or behind its own.
    return (pairs.filter("common + rest >= need") if whole else pairs.filter("2 * common + rest >= need")).select("u", "v")


def verified(pairs: DataFrame, nodes: DataFrame, slim: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts have an exact Jaccard similarity of at least ``similarity``."""
    used = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    used = nodes.select("node", "th").join(used, "node")
    texts = written(slim.join(used, "th").groupBy("node").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[like(x, y, words) >= similarity for x, y in zip(b["a"], b["b"], strict=True)], ["u", "v"]]

    return both.mapInPandas(run, "u long, v long")


def like(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the sets of shingles."""
    x, y = set(shingles(a, words)), set(shingles(b, words))
    return len(x & y) / len(x | y) if x or y else 1.0

"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

A shard is a bounded, seeded part of the distinct vectors of one length. Its graph is built by greedy
searches that propose neighbours, of which relaxed pruning keeps diverse ones. Every query is
searched in every shard of its length, by a beam; what is found is scored exactly and merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import written

#: Lengths of vectors up to which their counts of shards go to every executor.
BROADCAST_LENGTHS = 100_000


class Graph(NamedTuple):
    """How graphs are built and searched.

    ``degree`` edges a node, proposed by searches of ``build_beam``; an edge is dropped if
    a kept one leads ``relax`` times nearer to its end. Queries keep ``beam`` candidates and begin at
    ``starts`` nodes and as many of the longest vectors, ``block`` of them in a task. A shard holds ``shard`` vectors at most, and fewer where ``shard_bytes`` are reached.
    """

    degree: int = 32
    build_beam: int = 48
    relax: float = 1.2
    beam: int = 96
    starts: int = 64
    shard: int = 8192
    shard_bytes: int = 64 << 20
    block: int = 8192


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with a component more, by which all have one length: nearest by distance is then largest by inner product."""
    x = x / np.abs(x).max()
    norm = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(0, norm.max() - norm))]).astype(np.float32)


def greedy(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, at_once: int = 4) -> np.ndarray:
    """The ``beam`` nodes found nearest to each query, nearest first (-1: none).

    All queries go in step: each looks at its nearest open candidates until none is open. ``met``
    marks what a query has come upon, so each node is measured once.
    """
    n, norm = len(queries), (x * x).sum(1)
    beam = min(beam, len(x))
    met = np.full((n, len(x)), -1, np.int16)
    ids, far, done = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32), np.ones((n, beam), bool)
    rows, new = np.arange(n), np.tile(starts, (n, 1))
    while len(rows):
        place = np.arange(new.shape[1], dtype=np.int16)
        fresh = (new >= 0) & (met[rows[:, None], new] < 0)
        r, c = np.nonzero(fresh)
        met[rows[r], new[r, c]] = place[c]
        own = met[rows[r], new[r, c]] == place[c]  # of a step's equal nodes, the last one written counts
        r, c = r[own], c[own]
        node = new[r, c]
        new_far = np.full(new.shape, np.inf, np.float32)
        new_far[r, c] = norm[node] - 2 * np.einsum("kd,kd->k", x[node], queries[rows[r]])
        i, f, d = np.hstack([ids[rows], new]), np.hstack([far[rows], new_far]), np.hstack([done[rows], ~np.isfinite(new_far)])
        best = np.argpartition(f, beam - 1, axis=1)[:, :beam]
        i, f, d = (np.take_along_axis(v, best, 1) for v in (i, f, d))
        rank = np.where(d, np.inf, f)
        pick = np.argpartition(rank, min(at_once, beam) - 1, axis=1)[:, :at_once]
        live = np.isfinite(np.take_along_axis(rank, pick, 1))
        np.put_along_axis(d, pick, True, 1)
        ids[rows], far[rows], done[rows] = i, f, d
        nodes = np.where(live, np.take_along_axis(i, pick, 1), -1)
        keep = live.any(1)
        rows, nodes = rows[keep], nodes[keep]
        new = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(rows), nodes.shape[1] * edges.shape[1])
    order = np.argsort(far, axis=1, kind="stable")
    return np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(ids, order, 1), -1)


def pruned(x: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Robust pruning of all ``nodes`` in step: the nearest option stays, and takes out those that it leads to.

    An option goes if ``relax`` times its distance from a kept one is no more than its distance from the node.
    """
    order = np.sort(options, axis=1)
    twin = np.hstack([np.zeros((len(order), 1), bool), order[:, 1:] == order[:, :-1]])
    options = np.where(twin | (order == nodes[:, None]), -1, order)
    v = x[options]
    far = ((v - x[nodes][:, None]) ** 2).sum(2)
    far[options < 0] = np.inf
    best = np.argsort(far, axis=1, kind="stable")[:, : 2 * degree]
    options, far = np.take_along_axis(options, best, 1), np.take_along_axis(far, best, 1)
    v = x[options]
    square = (v * v).sum(2)
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for k in range(degree):
        p = far.argmin(1)
        left = np.isfinite(far[rows, p])
        if not left.any():
            break
        out[left, k] = options[rows, p][left]
        between = square + square[rows, p][:, None] - 2 * np.einsum("nkd,nd->nk", v, v[rows, p])
        far[(relax * relax * between <= far) | (np.arange(far.shape[1]) == p[:, None])] = np.inf
    return out


def built(x: np.ndarray, g: Graph, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of a shard's graph over ``x``: nodes are put in by growing batches, then looked at once more.

    A batch is searched in the graph so far; its pruned neighbours become edges, and edges
    back are added to them, which are pruned again where there are too many.
    """
    n, rng = len(x), np.random.default_rng(seed)
    order = rng.permutation(n)
    edges = np.full((n, g.degree), -1)
    first = order[: g.degree + 1]
    for i in first:
        others = first[first != i]
        edges[i, : len(others)] = others
    middle = ((x - x.mean(0)) ** 2).sum(1)
    starts = np.unique(np.append(first[: g.starts - 1], first[middle[first].argmin()]))
    at = len(first)
    while at < n:
        batch = order[at : at + min(1024, max(64, at // 3))]
        _put(x, edges, starts, batch, g, 1.0)
        at += len(batch)
    for at in range(0, n, 1024):
        _put(x, edges, starts, order[at : at + 1024], g, g.relax)
    longest = x[:, -1].argsort(kind="stable")[: g.starts]  # they are lifted least, and lie far from the rest
    return edges, np.unique(np.concatenate([order[: g.starts - 1], [middle.argmin()], longest]))


def _put(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, batch: np.ndarray, g: Graph, relax: float) -> None:
    found = greedy(x, edges, starts, x[batch], g.build_beam)
    edges[batch] = pruned(x, batch, np.hstack([found, edges[batch]]), g.degree, relax)
    to, of = edges[batch].ravel(), np.repeat(batch, g.degree)
    of, to = of[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    nodes, begin, n = np.unique(to, return_index=True, return_counts=True)
    for wide in (True, False):  # nodes that very many lead to are few, and don't widen the rest
        pick = (n > 2 * g.degree) == wide
        if not pick.any():
            continue
        back = np.full((pick.sum(), n[pick].max()), -1)
        row = np.repeat(np.arange(pick.sum()), n[pick])
        place = np.concatenate([np.arange(k) for k in n[pick]])
        back[row, place] = of[np.repeat(begin[pick], n[pick]) + place]
        for k in range(0, len(back), 512):
            some = nodes[pick][k : k + 512]
            edges[some] = pruned(x, some, np.hstack([edges[some], back[k : k + 512]]), g.degree, relax)


def usable(vec: str) -> Column:
    """Not null, not zero, every component there and finite."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(cls, dim, vec, ids, known): each distinct vector once, with its ``most`` least ids, of which no search can use more.

    Ranks are limited in each task before they are shuffled, so copies of any number are no
    group of their own. Rows that repeat id and vector count once; null ids come last, as 0 that isn't known.
    """
    each = rows.groupBy("cls", "id").agg(F.first("vec").alias("vec"))
    ranked = each.withColumn("k", F.row_number().over(W.partitionBy("cls").orderBy(F.asc_nulls_last("id")))).filter(F.col("k") <= most)
    made = ranked.groupBy("cls").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list(F.struct("k", "id"))).alias("ids"))
    ids, known = F.transform("ids", lambda x: F.coalesce(x["id"], F.lit(0))), F.transform("ids", lambda x: x["id"].isNotNull())
    return made.select("cls", F.size("vec").alias("dim"), "vec", ids.alias("ids"), known.alias("known"))


def shard_counts(made: DataFrame, g: Graph) -> DataFrame:
    """(of_dim, shards) for each length; as lengths are few, they are sent to every executor unless there are many."""
    room = F.greatest(F.lit(64), F.least(F.lit(g.shard), F.floor(F.lit(g.shard_bytes) / (8 * F.col("dim")))))
    sizes = made.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.select(F.col("dim").alias("of_dim"), F.ceil(F.col("n") / room).cast("int").alias("shards")), "lengths")
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_LENGTHS else sizes


def index(made: DataFrame, sizes: DataFrame, g: Graph) -> DataFrame:
    """(dim, shard, ids, begin, vecs, edges, starts): a row for each shard, its graph built.

    Vectors are dealt to the shards of their length by a hash, so each is an even sample of them.
    """
    dealt = made.join(sizes, F.col("dim") == F.col("of_dim")).withColumn("shard", F.pmod(F.xxhash64("cls"), "shards").cast("int"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        x = np.stack(rows["vec"].to_numpy()).astype("<f8")
        edges, starts = built(lifted(x), g)
        begin = np.cumsum([0, *(len(i) for i in rows["ids"])])
        told = {"dim": [key[0]], "shard": [key[1]], "raw": [x.tobytes()], "edges": [edges.astype("<i4").tobytes()], "starts": [starts.astype("<i4").tobytes()]}
        ids, known = (np.concatenate(rows[c].to_list()) for c in ("ids", "known"))
        return pd.DataFrame(told | {"ids": [ids], "known": [known], "begin": [begin.astype(np.int64)]})

    shape = "dim int, shard int, raw binary, edges binary, starts binary, ids array<long>, known array<boolean>, begin array<long>"
    dealt = dealt.select("dim", "shard", "cls", "vec", "ids", "known").repartition(_tasks(sizes), "dim", "shard")
    return written(dealt.groupBy("dim", "shard").applyInPandas(run, shape), "graphs")


def _tasks(sizes: DataFrame, blocks: int = 1) -> int:
    """Tasks that shards times blocks are dealt to: about one each, as long as there are cores for them."""
    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    return int(min(2 * shards * blocks, 8 * sizes.sparkSession.sparkContext.defaultParallelism))


def _searcher(g: Graph, k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query": [], "vec_id": [], "known": [], "score": []}
        if len(graphs) and len(queries):
            one, dim = graphs.iloc[0], key[0]
            x = np.frombuffer(one["raw"]).reshape(-1, dim)
            edges, starts = np.frombuffer(one["edges"], "<i4").reshape(len(x), -1).astype(np.int64), np.frombuffer(one["starts"], "<i4").astype(np.int64)
            ids, known, begin = np.asarray(one["ids"]), np.asarray(one["known"]), np.asarray(one["begin"])
            flat = lifted(x)
            for at in range(0, len(queries), 256):
                some = queries.iloc[at : at + 256]
                q = np.stack(some["vec"].to_numpy()).astype("<f8")
                flat_q = np.column_stack([q / np.abs(q).max(1, keepdims=True), np.zeros(len(q))]).astype(np.float32)
                found = greedy(flat, edges, starts, flat_q, max(g.beam, k + 1))
                for row, (query_id, name) in enumerate(zip(some["query_id"], some["query"], strict=True)):
                    cls = found[row][found[row] >= 0]
                    score = np.einsum("kd,d->k", x[cls], q[row])
                    n = begin[cls + 1] - begin[cls]
                    place = np.repeat(begin[cls] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    score = np.repeat(score, n)
                    other = ~known[place] | (ids[place] != query_id)
                    place, score = place[other], score[other]
                    best = np.lexsort((ids[place], ~known[place], -score))[:k]
                    out["query_id"].append(np.full(len(best), query_id))
                    out["query"] += [name] * len(best)
                    out["vec_id"].append(ids[place[best]])
                    out["known"].append(known[place[best]])
                    out["score"].append(score[best])
        join = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        vec_id = pd.array(join(out["vec_id"], np.int64), "Int64")
        vec_id[~join(out["known"], bool)] = None
        return pd.DataFrame({"query_id": join(out["query_id"], np.int64), "query": pd.Series(out["query"], dtype=object), "vec_id": vec_id, "score": join(out["score"], float)})

    return run


def nearest(table: DataFrame, is_query: Column, key: str = "vec_id", vec: str = "embedding", k: int = 20, g: Graph = Graph()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest to each query by inner product, in double precision.

    Only vectors of one length are compared. Vectors that are null, zero, or hold null or non-finite
    components take no part. A query's own row is every row of its id; null ids are no queries, and come
    last among equal scores. Rows that repeat id and vector count once; an id with unlike vectors is a
    query for each. With fewer candidates than ``k``, all are found. An empty table stays empty;
    other columns are left behind, whatever their names.
    """
    rows = table.filter(usable(vec)).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vec), lambda v: v.cast("double") + 0.0).alias("vec"), is_query.alias("asks"))
    rows = written(rows.withColumn("cls", F.md5(F.to_json(F.struct("vec")).cast("binary"))), "vectors")
    made = written(classes(rows, k + 1), "vector-classes")
    sizes = shard_counts(made, g)
    asked = rows.filter("asks and id is not null").groupBy("id", "cls").agg(F.first("vec").alias("vec"))
    asked = written(asked.select(F.col("id").alias("query_id"), F.col("cls").alias("query"), "vec", F.size("vec").alias("dim")), "asked")
    blocks = math.ceil(asked.count() / g.block) or 1
    part, every = F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).cast("int"), F.sequence(F.lit(0), F.lit(blocks - 1))
    by, n = ["dim", "shard", "part"], _tasks(sizes, blocks)
    of = index(made, sizes, g).withColumn("part", F.explode(every)).repartition(n, *by)
    to = asked.withColumn("part", part).join(sizes, F.col("dim") == F.col("of_dim"))
    to = to.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("query_id", "query", "vec", "dim", "shard", "part").repartition(n, *by)
    found = of.groupBy(*by).cogroup(to.groupBy(*by)).applyInPandas(_searcher(g, k), "query_id long, query string, vec_id long, score double")
    found = written(found, "found")
    best = W.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def document_neighbours(table: DataFrame) -> DataFrame:
    """Digest of the search of ``embeddings``: rows whose vec_id is divisible by 20 against all others."""
    return nearest(table, F.col("vec_id") % 20 == 0)

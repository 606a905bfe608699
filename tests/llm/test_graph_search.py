import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import graph_search as S

SF = "/root/testdata/sf0.1"


def fit(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute(rows, every, k=20):
    """Every query against every row, plainly: {(query_id, vector): [(vec_id, score)]}."""
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if fit(v)))
    out = {}
    for i, v in rows:
        if i is None or i % every:
            continue
        near = [(float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in rows if j != i and len(w) == len(v)]
        near.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out.setdefault(i, []).append([(j, s) for s, j in near[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in near[0]}) for q, near in want.items())
    return hits / sum(len(near[0]) for near in want.values())


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, n string").repartition(3)


def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 20)
    for g in (S.Graph(), S.Graph(shard=512, block=37)):
        got = S.nearest(df, F.col("vec_id") % 20 == 0, g=g)
        told = found(got)
        assert set(told) == set(want) and all(len(x) == 20 for x in told.values())
        assert recall(told, want) >= 0.95
        vec = {k: np.array(v, float) for k, v in rows}
        assert all(s == pytest.approx(vec[q] @ vec[j], abs=1e-12) for q, near in told.items() for j, s in near)


def test_vectors_of_unlike_norms_and_clusters(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 24)) * 4
    x = np.concatenate([middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.05, rng.normal(size=(1000, 24)) * rng.lognormal(0, 1, size=(1000, 1))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.permutation(x))]
    assert recall(found(S.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows, 20)) >= 0.9


def test_few_rows_are_found_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(15)]
    rows += [(40, [1.0, 2.0]), (41, [3.0, -1.0]), (60, [1.0] * 7), (80, None), (81, []), (100, [0.0, 0.0]), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0])]
    rows += [(2, rows[0][1]), (2, rows[0][1]), (None, rows[3][1]), (None, [5.0, 5.0]), (120, [1.0, 2.0]), (120, [1.0, 2.0]), (2**53 + 1, [9.0, 9.0])]
    want = brute(rows, 20)
    got = found(S.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    for q, near in want.items():
        if near[0]:
            assert [j for j, _ in got[q]] == [j for j, _ in near[0]] and [s for _, s in got[q]] == pytest.approx([s for _, s in near[0]])
        else:
            assert q not in got


def test_copies_of_very_many(spark):
    """Copies fold to one node; the least ids among them are told."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(2000)] + [(2000 + i, [float(c) for c in rng.normal(size=3) / 9]) for i in range(200)]
    got = found(S.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert [j for j, _ in got[0]] == list(range(1, 21)) and [j for j, _ in got[20]] == list(range(20))


def test_empty_and_clashing_names(spark):
    ask = F.col("vec_id") % 20 == 0
    assert S.nearest(table(spark, []), ask).count() == 0 and S.nearest(table(spark, [(20, None), (40, [1.0])]), ask).count() == 0
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(60)]
    names = "id vec cls asks k ids dim n of_dim shards shard raw edges starts known begin query_id query part score rank".split()
    plain, clash = (S.nearest(t, ask) for t in (table(spark, rows), table(spark, rows).withColumns({c: F.lit("mine") for c in names})))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, clash.collect()))

"""Each vector's nearest other one, against all pairs in double precision, with copies, multiples and vectors that are near to none."""

import numpy as np
import pytest

from sigmill.operators import nearest
from sigmill.registry import oracle_sql, queries
from tests.harness import difference


def table(rng, n, dims):
    x = rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + n // 4] = x[: n // 4] + 0.1 * rng.normal(size=(n // 4, dims))
    x[-n // 8 :] = x[0]
    x[5] = 2 * x[0]
    return x.astype(np.float32)


def all_pairs(ids, x, least):
    x = x.astype(float)
    c = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    np.fill_diagonal(c, -2)
    return {ids[i]: c[i].max() for i in range(len(ids)) if c[i].max() >= least}, c


@pytest.mark.parametrize("block,tile", [(7, 3), (64, 16), (8192, 4096)])
def test_nearest_equals_all_pairs(spark, block, tile):
    rng = np.random.default_rng(block)
    x = table(rng, 160, 8)
    ids = [int(i) for i in rng.permutation(160)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + bad, "k long, v array<float>").repartition(3)
    got = {r.id: (r.other, r.c) for r in nearest.nearest_others(df, "k", "v", 0.8, block, 16, tile).collect()}
    want, c = all_pairs(ids, x, 0.8)
    at = {k: i for i, k in enumerate(ids)}
    assert got.keys() == want.keys() and 40 < len(want) < 160
    for k, (other, cos) in got.items():
        assert other != k and cos == pytest.approx(want[k], abs=1e-12) and c[at[k], at[other]] >= want[k] - 1e-12
    # of copies, which are equally near, the least key is taken
    copies = sorted(ids[i] for i in range(160) if np.array_equal(x[i], x[0]))
    assert all(got[k][0] in (copies[0] if k != copies[0] else copies[1], ids[5]) for k in copies)


def test_clusters_with_null_vectors_equal_sql(spark, tmp_path):
    x = table(np.random.default_rng(3), 80, 6)
    # copies and multiples stand for one tie that SQL leaves open, unlike ones are told
    rows = [(int(i), v.tolist()) for i, v in enumerate(x[:70]) if i != 5] + [(100, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    assert difference(queries()["d04_vector_clusters"](spark, str(tmp_path)), oracle_sql()["d04_vector_clusters"], str(tmp_path)) == ""

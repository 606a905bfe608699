import numpy as np

from sigmill.llm import embedding_dedup as E


def brute(rows, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for o, (_, v) in zip(ok, rows)]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (k, _), c in zip(rows, comp):
        least[c] = min(k, least.get(c, k))
    return sorted((k, m, least[c], least[c] == k) for (k, _), m, c in zip(rows, n, comp))


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, n string").repartition(3)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 12))
    near = base + rng.normal(size=base.shape) * 0.12
    vecs = np.concatenate([base, near, base[:20], base[:1].repeat(30, 0)]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vecs)]
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] + [1.0] * 11), (904, [None] + [1.0] * 11), (905, [float("inf")] * 12), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (908, [2.0, 4.0]), (909, [3e38] * 12)]
    got = E.near_vectors(table(spark, rows), block=32, lead=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert E.near_vectors(table(spark, [])).count() == 0
    assert E.near_vectors(table(spark, [(1, None)])).collect()[0].kept


def test_vectors_of_very_many_lengths(spark):
    rows = [(n, [1.0] * n) for n in range(1, 1201)] + [(5000 + n, [2.0] * n) for n in range(1, 1201, 7)]
    got = E.near_vectors(table(spark, rows))
    twins = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    want = {k: ((1, n) if n % 7 == 1 else (0, n)) for k, v in rows for n in [len(v)]}
    assert twins == want


def test_large_and_null_keys(spark):
    rows = [(2**53 + 1, [1.0, 0.0]), (2**53 + 3, [0.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 0.01])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in E.near_vectors(table(spark, rows)).collect())
    assert got == [(0, 0, 0), (0, 1, 2**53 + 1), (2**53 + 1, 1, 2**53 + 1), (2**53 + 3, 0, 2**53 + 3)]

"""Density clusters against a plain version: full matrix, sorted edges, the tree read from its root down."""

import time

import numpy as np
import pytest

from sigmill.operators import density as D
from sigmill.registry import queries

SF = "/root/testdata/sf0.001"


def brute(ids, x, least=2, k=2):
    n = len(ids)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(np.round(1 - x @ x.T, 9), 0)
    core = np.sort(d + np.diag([9.0] * n), axis=1)[:, min(k, n - 1) - 1]
    edges = sorted((max(d[i, j], core[i], core[j]), *sorted((ids[i], ids[j]))) for i in range(n) for j in range(i))
    group, tree = {i: i for i in ids}, []
    for w, a, b in edges:
        if group[a] != group[b]:
            tree.append((w, a, b))
            old, new = group[b], group[a]
            group = {i: new if g == old else g for i, g in group.items()}
    label = {i: -1 for i in ids}

    def sides(points, inner):
        """What the heaviest edge of a subtree splits it into."""
        w, a, b = inner[-1]
        beside, near = {p: [] for p in points}, {a}
        for _, p, q in inner[:-1]:
            beside[p].append(q)
            beside[q].append(p)
        todo = [a]
        while todo:
            for q in beside[todo.pop()]:
                if q not in near:
                    near.add(q)
                    todo.append(q)
        return 1 / max(w, D.FLOOR), [(s, [e for e in inner[:-1] if e[1] in s]) for s in (near, set(points) - near)]

    def grow(points, inner, birth):
        """(worth, clusters chosen) of a cluster that begins with ``points``."""
        mass, everyone = 0.0, set(points)
        while True:
            if not inner:  # one point left
                return max(mass - len(everyone) * birth, 0), [everyone]
            dense, two = sides(points, inner)
            big = [s for s in two if len(s[0]) >= least]
            if len(big) == 2:
                mass += len(points) * dense
                below = [grow(*s, dense) for s in two]
                own, sub = mass - len(everyone) * birth, sum(b[0] for b in below)
                return (sub, below[0][1] + below[1][1]) if sub > own or birth == 0 else (own, [everyone])
            if not big:
                mass += len(points) * dense
                return mass - len(everyone) * birth, [everyone] if birth else []
            mass += (len(points) - len(big[0][0])) * dense
            points, inner = big[0]

    if n >= 2:
        for c in grow(set(ids), tree, 0.0)[1]:
            for i in c:
                label[i] = min(c)
    return label


def run(spark, ids, x, **more):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    return {r.id: r.cluster for r in D.density_clusters(df, "id", "v", **more).collect()}


@pytest.mark.parametrize("least,k,band", [(2, 2, 500_000), (5, 3, 40)])
def test_against_plain_version(spark, least, k, band):
    rng = np.random.default_rng(least)
    middle = rng.normal(size=(6, 8))
    x = np.concatenate([middle[rng.integers(0, 6, 70)] + rng.normal(size=(70, 8)) * rng.choice([0.05, 0.3], size=(70, 1)), rng.normal(size=(20, 8))])
    x[5] = x[6] = x[7]
    ids = rng.permutation(1000)[:90]
    got = run(spark, ids, x, least=least, neighbours=k, pivots=5, block=16, band=band)
    want = brute([int(i) for i in ids], x, least, k)
    assert got == want and len(set(want.values())) > 3 and -1 in want.values()


def test_odd_vectors_and_few_points(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {r.id: r.cluster for r in D.density_clusters(df, "id", "v").collect()} == {i: -1 for i in range(1, 7)}
    assert {r.cluster for r in D.density_clusters(df.filter("id = 1"), "id", "v").collect()} == {-1}
    assert D.density_clusters(df.filter("id > 9"), "id", "v").count() == 0


def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {r.vec_id: r.cluster for r in queries()["d04_density_clusters"](spark, SF).collect()}
    assert got == brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))


def test_deep_paths_take_few_seconds(spark):
    n = 4000
    ended = spark.createDataFrame([(i, i + 1 if i < n else n + 7, 1.0, 0.5 if i % 1000 == 0 and i else 2.0) for i in range(n + 1)], "cluster long, parent long, stability double, below double")
    began = time.perf_counter()
    got = {r.cluster: r.top for r in D.chosen(ended).collect()}
    assert time.perf_counter() - began < 60
    assert set(got.values()) == {n} and len(got) == n + 1


def test_sides_are_few_and_cores_exact(spark, monkeypatch):
    monkeypatch.setattr(D, "SIDES", 3)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(5, 8))[rng.integers(0, 5, 300)] + 0.1 * rng.normal(size=(300, 8)), rng.normal(size=(100, 8))])
    x[5] = x[6] = x[7]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    blocks = D.in_blocks(D.units(df, "id", "v"), 7, 16)
    assert blocks.sides == 3 and blocks.rows.count() > 20
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sort(np.maximum(np.round(1 - u @ u.T, 9), 0) + np.diag([9.0] * 400), axis=1)[:, 2]
    got = {r.id: r.core for r in D.core_distances(blocks, 3).collect()}
    assert len(got) == 400 and max(abs(got[i] - want[i]) for i in got) < 2e-9

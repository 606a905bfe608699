import numpy as np
import pytest

import corpus_pipeline as P

from sigmill.llm import shingles, simhash


def sets(rows):
    return [set(shingles.shingles(t, 5)) for _, t in rows]


def edited(rng, base, n):
    t = list(base)
    for k in rng.choice(len(t), n, replace=False):
        t[k] = f"new{rng.integers(1 << 30)}"
    return " ".join(t)


@pytest.mark.parametrize("often", [3, 8])
def test_keeps_one_of_each_group_with_like_shingles(spark, monkeypatch, often):
    monkeypatch.setattr(shingles, "OFTEN", often)
    rng, rows = np.random.default_rng(5), []
    passage = [f"p{k}" for k in range(40)]  # in all texts of a third of the groups
    for g in range(30):
        base = [f"w{rng.integers(300)}" for _ in range(rng.integers(60, 240))] + passage * (g % 3 == 0)
        for n in rng.integers(0, 8, 4 if g else 40):
            rows.append((len(rows), edited(rng, base, n)))
    rows += [(1000, "one two"), (1001, "One  two"), (1002, ""), (1003, None)]
    s, fps = sets(rows), [simhash.fingerprint(t, 5) % 2**64 for _, t in rows]
    comp, far = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            like = len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])
            far += like and (fps[i] ^ fps[j]).bit_count() > 3
            if (like or (fps[i] ^ fps[j]).bit_count() <= 3) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert far > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in simhash.keep_one(docs, 5, 3, 0.8).collect())
    assert got == sorted(rows[c][0] for c in set(comp))


def test_prefixes_of_like_sets_meet():
    rng = np.random.default_rng(6)
    often, rank = np.sort(rng.choice(500, 60, replace=False)).astype(np.uint64), rng.permutation(60)
    for _ in range(500):
        a = np.unique(rng.integers(0, 500, rng.integers(1, 90))).astype(np.uint64)
        b = np.setdiff1d(a, rng.choice(a, rng.integers(0, 1 + len(a) // 5)))
        if len(b) and len(b) >= 0.8 * len(a):
            x, y = (shingles.prefix(v, 0.8, often, rank) for v in (a, b))
            assert len(np.intersect1d(x, y))


def test_pipeline_stage_against_exact_similarity(spark):
    """Bits and exact similarity by brute force; tests/llm/test_pipeline.py knows bits alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in P.STAGES[:2]:
        docs = P.written(stage(spark, docs, ""), "test")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    s, fps, comp, more = sets(rows), [simhash.fingerprint(t, 5) % 2**64 for _, t in rows], list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            bits, like = (fps[i] ^ fps[j]).bit_count() <= P.BUDGET, len(s[i] & s[j]) >= P.SIMILARITY * len(s[i] | s[j])
            more += like and not bits
            if (bits or like) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert more
    got = sorted((r.doc_id, r.text) for r in P.STAGES[2][1](spark, docs, "").collect())
    assert got == [r for i, r in enumerate(rows) if comp[i] == i]

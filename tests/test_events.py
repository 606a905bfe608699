"""Events in passes against all pairs of rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions import text as X
from sigmill.operators import events
from tests.test_duplicates import norm
from tests.test_trends import plain_ratio


@pytest.mark.parametrize(
    "title, want",
    [
        ("Show HN: The Acme Corp ships v1.2.3 of its API", ["api", "the acme corp", "v1.2.3"]),
        ('New "quoted part " by Rust, AI and US', ["quoted part", "rust"]),
        ("Why Bo Knows How", ["why bo knows how"]),
        ("How it Is. Who ABCDEFG", []),
        ("", []),
        (None, []),
    ],
)
def test_key_entities(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(X.key_entities(F.col("t"))).first()[0] == want


def all_pairs(rows, entities):
    """{key: event} of rows (k, title, address): every pair of rows is looked at."""
    out, rest = {}, []
    for k, t, u in rows:
        same = [r[0] for r in rows if u is not None and r[2] == u]
        if len(same) > 1:
            out[k] = min(same), "url"
        elif norm(t):
            rest.append((k, norm(t), entities[k]))
    parent = {k: k for k, _, _ in rest}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s, e), (b, t, f) in itertools.combinations(rest, 2):
        j = len(e & f) / len(e | f) if e and f else 0
        if (j >= 0.75 or (j >= 0.5 and plain_ratio(s, t) >= 0.70)) if len(e) >= 2 and len(f) >= 2 else plain_ratio(s, t) >= 0.80:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    roots = [find(k) for k, _, _ in rest]
    return out | {k: (r, "title") for (k, _, _), r in zip(rest, roots) if roots.count(r) > 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["Acme Corp", "Blue Sky", "API", "SDK", "v1.2", "v3.4", "GPU", "Red Hat", "CPU", "Deep Mind"]
    words = ["ships a thing", "gone", "is open to all who come", "slow and quiet", "x"]
    make = lambda: " ".join([*rng.permutation(names)[: rng.choice([0, 1, 2, 3, 4])], *rng.permutation(words)[: rng.integers(0, 4)]])
    titles = [make() for _ in range(60)]
    for t in titles[:30]:
        c = list(t)
        for _ in range(rng.integers(0, 4)):
            if c:
                c[rng.integers(0, len(c))] = rng.choice(list("abz "))
        titles += ["".join(c), t.upper() if rng.random() < 0.2 else t]
    titles += ["", None, "  ", "B a", "a b", "A b"]
    rows = [(i, None if t is None else str(t), None if rng.random() < 0.6 else f"https://site/{rng.integers(0, 30)}") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, title string, u string").repartition(3)
    entities = {r.id: set(r.e) for r in df.select("id", X.key_entities(F.col("title")).alias("e")).collect()}
    got = events.event_groups(df, "id", "title", F.col("u")).collect()
    want = all_pairs(rows, entities)
    assert {r.id: (r.event, r["pass"]) for r in got} == want and len(got) == len(want)
    assert {p for _, p in want.values()} == {"url", "title"}


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, title string, u string")
    assert events.event_groups(df, "id", "title", F.col("u")).count() == 0

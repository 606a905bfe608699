"""Merging of phrases into trends, and similar titles, against plain versions in order."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from sigmill.functions.phrases import TERMS
from sigmill.operators import similar, trends
from sigmill.registry import queries

SF = "/root/testdata/sf0.001"


def in_order(rows, limit=30):
    """Phrases one after another, as the rule is told."""
    sets = defaultdict(set)
    for k, phrases in rows:
        for p in set(phrases or []):
            sets[p].add(k)
    shared = {p: s for p, s in sets.items() if len(s) >= 2 and p not in trends.GENERIC}
    shared = shared or {p: s for p, s in sets.items() if len(s) >= 2 and (p in TERMS or "-" in p)}
    groups, used = [], set()
    for p in sorted(shared, key=lambda p: (-len(shared[p]), p)):
        s = shared[p]
        if len(s - used) < 2 and len(s) < 3:
            continue
        for g in groups:
            if len(s & g) / min(len(s), len(g)) > 0.5:
                g |= s
                break
        else:
            groups.append(set(s))
        used |= s
    out, of = [], {k: set(ps or []) for k, ps in rows}
    for g in groups:
        held = Counter(p for k in g for p in of[k] if p in shared or p in TERMS)
        name = min(held, key=lambda p: (-held[p] * (1 + 0.5 * len(p.split("-"))), p))
        if "-" in name or name in TERMS:
            out.append((name, len(g), min(g)))
    return sorted(out, key=lambda r: (-r[1], r[0], r[2]))[:limit]


@pytest.mark.parametrize("few", [0, 200_000])
def test_merge_equals_phrases_in_order(spark, few):
    rng = np.random.default_rng(2)
    words = ["rust", "tool", "data", "go-fast", "a-b-c", "x-y", "plain", "redis", *(f"w{i}-z" for i in range(12))]
    rows = [(i, [str(w) for w in rng.choice(words, rng.integers(0, 4), replace=False)]) for i in range(70)]
    rows += [(100, None), (101, []), (102, ["rust", "rust"])]
    df = spark.createDataFrame(rows, "id long, p array<string>").repartition(3)
    got = [tuple(r) for r in trends.trend_groups(df, "id", "p", few=few).collect()]
    assert got == in_order(rows) and len(got) > 4


def test_merge_of_wide_words_alone_and_of_none(spark):
    df = spark.createDataFrame([(1, ["edge"]), (2, ["edge"]), (3, ["tool"]), (4, ["tool"])], "id long, p array<string>")
    assert [tuple(r) for r in trends.trend_groups(df, "id", "p").collect()] == [("edge", 2, 1)]
    assert trends.trend_groups(df.filter("id > 9"), "id", "p").count() == 0


def test_query_equals_phrases_in_order(spark):
    from sigmill.plans.topics import topics

    rows = [(r.id, r.topics) for r in topics(spark, SF).collect()]
    assert [tuple(r) for r in queries()["d03_merged_trends"](spark, SF).collect()] == in_order(rows)


def plain_ratio(a, b):
    """Longest common subsequence by the usual table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def test_ratios(spark):
    rng = np.random.default_rng(1)
    texts = ["", "a", "é😀x", "x" * 64, "xy" * 32, "x" * 65, "b" * 300, *("".join(rng.choice(list("abc d"), rng.integers(1, 90))) for _ in range(60))]
    import pandas as pd

    a, b = texts, list(reversed(texts))
    got = similar.ratios(pd.Series(a), pd.Series(b)).tolist()
    assert got == pytest.approx([plain_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)])


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9])
def test_similar_titles_equal_all_pairs(spark, least):
    rng = np.random.default_rng(int(least * 10))
    titles = ["".join(rng.choice(list("abcdef  "), n)).strip() for n in rng.integers(1, 40, 60)]
    for t in list(titles):
        for _ in range(2):
            c = list(t)
            for _ in range(rng.integers(0, 1 + len(t) // 3)):
                at = rng.integers(0, len(c) + 1)
                c[at : at + rng.integers(0, 2)] = rng.choice(list("abcdefg "), rng.integers(0, 2))
            titles.append("".join(c))
    titles += ["B a", "a b", "", None, "  ", "x", "xy", "xyz", "yz", titles[0], "one " * 200, "one " * 199 + "two"]
    norm = [" ".join(sorted((t or "").lower().split())) for t in titles]
    first = {}
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    want = {(i, j) for t, i in first.items() for u, j in first.items() if i < j and t and u and plain_ratio(t, u) >= least}
    want |= {(first[t], i) for i, t in enumerate(norm) if t and first[t] != i}
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string").repartition(3)
    got = similar.title_pairs(df, "id", "title", least).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_phrases_take_time_in_proportion(spark):
    import time

    from pyspark.sql import functions as F

    from sigmill.functions.phrases import topic_phrases

    words = [f"telling{i}" for i in range(20_000)]
    df = spark.createDataFrame([(0, "Rust tools, edge"), (1, " ".join(words)), (2, ""), (3, None), (4, "alone")], "id long, title string")
    begin = time.perf_counter()
    got = {r.id: r.p for r in df.select("id", topic_phrases(F.col("title")).alias("p")).collect()}
    assert time.perf_counter() - begin < 40
    assert got[0] == ["edge", "rust", "rust-tool", "tool-edge"]
    assert got[1] == sorted(f"{a}-{b}" for a, b in zip(words, words[1:])) and got[2] == [] and got[3] is None and got[4] == []

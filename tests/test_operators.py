"""Operators that SQL can't express, and edge cases, against brute force on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions import scoring as S
from sigmill.functions import text as X
from sigmill.operators import dedup, graph, joins, rows, similar, windows
from sigmill.operators.aggregates import calibration_bins, index_p90, pick_by_place


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("a, b", [("", ""), ("abc", ""), ("kitten", "sitting"), ("aaaa", "aa"), ("abcdef" * 9, "badcfe" * 8)])
def test_indel_ratio(a, b):
    assert similar.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_title_pairs_reach_the_same_groups_as_all_pairs(spark):
    titles = ["Alpha beta gamma", "beta alpha gamma", "alpha beta gamma!", "Alpha beta", "x", "", None, "Delta epsilon zeta eta", "delta epsilon zeta etas", "alpha beta gamma"]
    got = {frozenset((r.a, r.b)) for r in similar.title_pairs(spark.createDataFrame(list(enumerate(titles)), "id int, title string"), "id", "title", 0.8).collect()}
    key = lambda t: " ".join(sorted((t or "").lower().split()))
    want = {frozenset((i, j)) for i, j in itertools.combinations(range(len(titles)), 2) if key(titles[i]) and key(titles[j]) and similar.indel_ratio(key(titles[i]), key(titles[j])) >= 0.8}
    assert got <= want
    close = lambda edges: {frozenset(c) for c in closure(edges, range(len(titles)))}
    assert close(got) == close(want)


def closure(edges, nodes):
    comp = {n: {n} for n in nodes}
    for e in edges:
        a, *b = tuple(e)
        if b:
            union = comp[a] | comp[b[0]]
            for n in union:
                comp[n] = union
    return comp.values()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = {n: min(c) for c in closure([frozenset(e) for e in edges], nodes | {n for e in edges for n in e}) for n in c if n in nodes}
    assert got == want


def test_event_groups(spark):
    t = [(1, "Acme Corp ships v1.2 of API"), (2, "API v1.2 by Acme Corp"), (3, "Other Thing is 3.4"), (4, "nothing here"), (5, "SDK 9.9 and API v1.2 from Acme Corp")]
    got = {r.id: r.event_group for r in dedup.event_groups(spark.createDataFrame(t, "id int, title string"), "id", "title").collect()}
    assert got[1] == got[2] and got[3] == 3 and 4 not in got


def test_event_groups_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    names = ["Acme Corp", "Blue Sky", "API", "SDK", "v1.2", "v3.4", "GPU", "Red Hat", "CPU", "Deep Mind"]
    rows_ = [(i, " and ".join(rng.permutation(names)[: rng.integers(1, 6)])) for i in range(70)] + [(100 + i, f"word {i}") for i in range(5)]
    df = spark.createDataFrame([(int(i), str(t)) for i, t in rows_], "id long, title string")
    sets, first = {}, {}
    for r in df.select("id", "title", X.entities(F.col("title")).alias("e")).collect():
        if len(r.e) >= 2:
            sets.setdefault(frozenset(r.e), []).append(r.id)
            first.setdefault(frozenset(r.e), r.title)
    key = lambda t: " ".join(sorted(t.lower().split()))
    links = []
    for a, b in itertools.combinations(sets, 2):
        j = len(a & b) / len(a | b)
        if j >= 0.75 or (j >= 0.5 and similar.indel_ratio(key(first[a]), key(first[b])) >= 0.70):
            links.append(frozenset((min(sets[a]), min(sets[b]))))
    comp = {n: min(c) for c in closure(links, {min(v) for v in sets.values()}) for n in c}
    want = {i: comp[min(v)] for v in sets.values() for i in v}
    assert len(set(want.values())) < len(sets)
    assert {r.id: r.event_group for r in dedup.event_groups(df, "id", "title").collect()} == want


URLS = [
    ("https://github.com/Owner/Repo.git", "github.com/owner/repo", "github_repo"),
    ("http://github.com/Owner/Repo/issues/3?utm_source=x#top", "github.com/owner/repo", "github_repo"),
    ("https://dev.to/User/Some-Slug", "dev.to/user/some-slug", "article"),
    ("https://www.producthunt.com/posts/Thing?ref=a", "producthunt.com/posts/thing", "product"),
    ("https://www.indiehackers.com/post/Abc", "indiehackers.com/post/abc", "article"),
    ("https://me.substack.com/p/Hello", "me.substack.com/p/hello", "article"),
    ("https://www.reddit.com/r/Sub/comments/abC/slug/", "reddit.com/r/sub/comments/abC", "discussion"),
    ("https://news.ycombinator.com/item?id=1", None, "wrapper"),
    ("https://a.example.com/x/?ref=1&k=2", "a.example.com/x", "other"),
    ("", None, "no_url"),
    (None, None, "no_url"),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS], "url string")
    got = df.select(X.canonical_url(F.col("url")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(c, k) for _, c, k in URLS]


@pytest.mark.parametrize("url, want", [("http://a.b/c?utm_source=1", "https://a.b/c"), ("https://a.b/c?x=1&ref=2&y=3#f", "https://a.b/c?x=1&y=3"), ("", None)])
def test_clean_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(X.clean_url(F.col("u"))).first()[0] == want


def test_index_p90_differs_from_the_discrete_percentile(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 7)], "k string, v int")
    got = {r.k: r.p for r in pick_by_place(df, ["k"], "v", {"p": index_p90()}).collect()}
    assert got == {"a": 18, "b": 7}


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0, True), (0.3, True), (0.29, False), (1.0, True), (0.999, False)], "c double, a boolean")
    assert sorted((r.bin, r.n) for r in calibration_bins(df, "c", "a").collect()) == [(0, 1), (2, 1), (3, 1), (9, 2)]


@pytest.mark.parametrize("series, stages", [([0.5], ["emerging"]), ([0.5, 0.54], ["emerging", "peaking"]), ([0.3, 0.37], ["emerging", "rising"]), ([0.005, 0.5], ["emerging", "stable"]), ([0.5, 0.3], ["emerging", "declining"]), ([0.4, 0.2], ["emerging", "fading"])])
def test_lifecycle_stages(spark, series, stages):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(series)], "trend_id int, k int, momentum double").select("trend_id", "momentum", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("day"), F.lit(3).alias("n"))
    assert [r.stage for r in windows.lifecycle(df).orderBy("day").collect()] == stages


def test_upsert_and_update(spark):
    old, new = (spark.createDataFrame(v, "k int, v string") for v in ([(1, "a"), (2, "b")], [(2, "c"), (3, None)]))
    assert sorted((r.k, r.v or "") for r in rows.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "")]
    assert sorted((r.k, r.v) for r in rows.update_by_key(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]
    assert rows.append_new(old, new, ["k"]).count() == 3


def test_saturation_ignores_unknown_parts(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (0.2, 0.8)], "a double, b double")
    got = [r[0] for r in df.select(S.saturation([(F.col("a"), 0.3), (F.col("b"), 0.1)])).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None and got[2] == pytest.approx(0.35)


def test_fallback_filter(spark):
    df = spark.createDataFrame([(1, 5), (1, 1), (2, 1)], "k int, v int")
    assert sorted(map(tuple, rows.filter_or_all(df, F.col("v") > 3, ["k"]).collect())) == [(1, 5), (2, 1)]

import hashlib

import numpy as np
import pytest

from sigmill.llm import suffix_dedup as S


def brute(rows, least=100):
    """First place of every string, over rows in order; rows with one key are one text."""
    first, out = {}, []
    for key, raw in rows:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            if first.setdefault(raw[s : s + least], (key, s)) != (key, s):
                gone[s : s + least] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words, k))
    shared = [prose(int(rng.integers(14, 60))) for _ in range(6)]
    texts = ["", "short", "a" * 99, "a" * 100, "b" * 350, "ab" * 130]
    for _ in range(n):
        t = prose(int(rng.integers(5, 150)))
        for _ in range(int(rng.integers(0, 3))):
            p = shared[int(rng.integers(6))]
            a, b = sorted(rng.integers(0, len(p), 2))
            at = int(rng.integers(0, len(t)))
            t = t[:at] + (p if rng.random() < 0.6 else p[a:b]) + t[at:]
        texts.append(t)
        if rng.random() < 0.2:
            texts.append(t)
        if rng.random() < 0.2:
            i = int(rng.integers(0, len(t)))
            texts.append(t[:i] + "#" + t[i + 1 :])
    return [texts[i] for i in rng.permutation(len(texts))]


def test_groups_of_a_transform():
    rng = np.random.default_rng(0)
    segs = [rng.integers(97, 99, int(rng.integers(0, 60))).astype(np.uint8).tobytes() for _ in range(40)]
    raw = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.uint16) + 1, 0) for x in segs] + [[0]]).astype(np.uint16)
    order, group = S.bwt_groups(raw, 8)
    at = {}
    for o, g in zip(order, group):
        w = raw[o : o + 8]
        if len(w) == 8 and w.all():
            at.setdefault(bytes(w.astype(np.uint8)), set()).add(int(g))
    assert all(len(g) == 1 for g in at.values())
    assert len({next(iter(g)) for g in at.values()}) == len(at)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, doc int").repartition(3)
    got = sorted(tuple(r) for r in S.document_repeats(docs).collect())
    assert got == brute([(i, t.encode()) for i, t in enumerate(texts)])


def test_long_text_in_pieces(spark):
    rng = np.random.default_rng(4)
    t = "".join(rng.choice(list("abcdefgh "), 1_300_000))
    t = t + t[500_000:700_100]
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = S.document_repeats(docs).collect()[0]
    assert (r.n_removed, r.n_spans) == (200_100, 1)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long), (3, None), (3, ""), (5, long), (5, long), (6, "x" + long), (6, "y" + long)]
    got = S.document_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    n = len(long)
    assert by == [(0, n, 0), (3, 0, 0), (3, 0, 0), (5, n, n), (5, n, n), (6, n + 1, n), (6, n + 1, n)]
    assert S.document_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("per_text", [1, 4])
def test_anchors_with_many_surroundings_are_cut_by_windows(spark, per_text):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = made(3, 25) + [f"{rng.integers(1 << 40)} {passage} {rng.integers(1 << 40)}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = S.remove_repeats(docs, per_text=per_text)
    got = sorted((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == brute([(i, t.encode()) for i, t in enumerate(texts)])

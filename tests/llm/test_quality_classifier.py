"""Scores of the discriminant against a plain NumPy version over statistics that Python counts itself."""

import math
import re
import unicodedata
import zlib

import numpy as np

from sigmill.llm import quality_classifier as Q

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def statistics(text):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    n, letters = len(w) + 10, len(SPACE.sub("", t))
    chars = letters + 50
    count = lambda keep: sum(map(keep, t))
    return [
        math.log1p(len(w)),
        math.log1p(chars / n),
        math.log1p(10 * count(lambda c: c in "#*$%&|<>") / n),
        math.log1p(10 * count(lambda c: c in "!?") / n),
        math.log1p(10 * count(lambda c: c == "|") / n),
        math.sqrt(count(lambda c: c in ".,") / n),
        math.sqrt(count(lambda c: unicodedata.category(c) == "Lu") / chars),
        math.sqrt(count(lambda c: unicodedata.category(c) == "Nd") / chars),
        math.log(len(set(w)) + 10) / math.log(n),
        math.sqrt(sum(a == b for a, b in zip(w, w[1:])) / n),
        math.sqrt(sum(len(x) <= 3 for x in w) / n),
        math.log1p(count(lambda c: c == "\n") / n * 20),
    ]


def brute(docs, labels, shrink=0.1, ridge=1e-3):
    x = {d: np.array(statistics(t)) for d, t in docs}
    own = [[x[d] for d, y in labels if y == c and zlib.crc32(str(d).encode()) % 3 != 1] for c in (0, 1)]
    mean = [np.mean(v, 0) for v in own]
    cov = [np.cov(np.array(v).T, bias=True) for v in own]
    n = [len(v) for v in own]
    pooled = sum(k * c for k, c in zip(n, cov)) / sum(n)
    out = {}
    for d, v in x.items():
        logs = []
        for c in (0, 1):
            s = (1 - shrink) * cov[c] + shrink * pooled + ridge * np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-9)
            e = v - mean[c]
            logs.append(-0.5 * e @ np.linalg.solve(s, e) - 0.5 * np.linalg.slogdet(s)[1] + math.log(n[c] / sum(n)))
        out[d] = 1 / (1 + math.exp(-max(-500, min(500, logs[1] - logs[0]))))
    return out


def test_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    assert set(got) == set(want) and len(want) >= 200
    assert max(abs(got[d].score - want[d]) for d in want) < 1e-6
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for d, r in got.items())


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "A b B a a a!", "Ü É 1２３ ß\n\nx | y | z ## $", "word " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.x for r in Q.add_statistics(docs).collect()}
    for k, t in enumerate(texts):
        assert np.allclose(got[k], statistics(t), atol=1e-9), t

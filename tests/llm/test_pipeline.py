import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.harness import duck

import corpus_pipeline as P

from sigmill.llm.queries import oracle_sql
from tests.llm.test_packing import reference

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

def words(t):
    return (t or "").encode().split()

def brute_lines(docs):
    """Windows of three worded lines, in order of doc_id; later ones go."""
    seen, out = {}, []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        rows = r["text"].split("\n")
        at = [i for i, x in enumerate(rows) if words(x)]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(rows[i] for i in at[k : k + 3])
            if seen.setdefault(w, (r["doc_id"], k)) != (r["doc_id"], k):
                gone |= set(at[k : k + 3])
        t = "\n".join(x for i, x in enumerate(rows) if i not in gone)
        if words(t) or not gone:
            out.append(r | {"text": t, "n_chars": len(t)})
    return out

def brute_copies(docs):

    def runs_of(t):
        w = T_lower(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    def like(a, b):
        return len(a & b) >= P.SIMILARITY * len(a | b)

    def fp(t):
        import xxhash

        w = T_lower(t)
        runs = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w]
        h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0

    def T_lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()

    docs = sorted(docs, key=lambda r: r["doc_id"])
    fps, runs, comp = [fp(r["text"]) for r in docs], [runs_of(r["text"]) for r in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if comp[i] != comp[j] and ((fps[i] ^ fps[j]).bit_count() <= P.BUDGET or like(runs[i], runs[j])):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [r for i, r in enumerate(docs) if comp[i] == i]

def brute_mix(docs):
    docs = [r | {"n": len(words(r["text"])), "h": hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()} for r in docs]
    names = sorted({r["source"] for r in docs if r["source"] is not None}) + [None] * any(r["source"] is None for r in docs)
    size = {s: sum(r["n"] for r in docs if r["source"] == s) for s in names}
    weight, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    pool, free = 1.5 * sum(size.values()), set(names)
    while free:
        level = pool / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        pool -= sum(2 * size[s] for s in full)
        free -= full
    out = []
    for s in names:
        own, run = sorted((r for r in docs if r["source"] == s), key=lambda r: (r["h"], r["n"])), 0
        whole = int(target[s] // size[s]) if size[s] else 0
        for r in own:
            extra = size[s] > 0 and run + r["n"] / 2 <= target[s] - whole * size[s] and target[s] > whole * size[s]
            run += r["n"]
            out += [r] * (whole + extra)
    return out

@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        before = docs
        docs = P.written(stage(spark, docs, SF), "test")
        out.append((before, docs))
    return out

def dicts(df):
    return [{c: r[c] for c in COLUMNS} for r in df.collect()]

def same(got, want):
    key = lambda r: tuple((r[c] is not None, r[c]) for c in COLUMNS)
    assert sorted(map(key, got)) == sorted(key(r) for r in want)

def test_stages_against_brute_force(stages):
    assert all(after.columns == COLUMNS for _, after in stages[:-1])
    names, rows = duck(oracle_sql()["op9_quality_rules"], SF)
    kept = {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    same(dicts(stages[0][1]), [r for r in dicts(stages[0][0]) if r["doc_id"] in kept])
    same(dicts(stages[1][1]), brute_lines(dicts(stages[1][0])))
    same(dicts(stages[2][1]), brute_copies(dicts(stages[2][0])))
    same(dicts(stages[3][1]), brute_mix(dicts(stages[3][0])))

def test_packed_stage_covers_every_token(stages):
    docs, pieces = stages[4][0].collect(), stages[4][1].collect()
    ids, total = reference(), 0
    tokens = {r.doc_id: [*ids(r.text), 1] for r in docs}
    lengths = {d: len(t) for d, t in tokens.items()}
    total = sum(lengths[r.doc_id] for r in docs)
    assert sum(p.length for p in pieces) == total
    spans = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    at = 0
    for s, n in spans:
        assert s == at
        at += n
    assert all(p.doc_tokens == lengths[p.doc_id] for p in pieces)
    assert all(p.ids_crc32 == zlib.crc32(np.array(tokens[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    starts = Counter((p.doc_id, p.start) for p in pieces)
    assert all(starts[d, 0] == n for d, n in Counter(r.doc_id for r in docs).items())

def test_run_equals_stages(spark, stages):
    assert P.run(spark, SF).count() == stages[4][1].count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b\nc d\ne f " * 9, "en", None, 1), (2, "a b\nc d\ne f " * 9, "en", None, 1)]])
def test_stages_take_odd_rows_and_extra_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    clash = docs.selectExpr("*", "1 as n_words", "2 as _size", "3 as node", "'x' as repeats", "4 as th")
    for given in (docs, clash):
        now = given
        for name, stage in P.STAGES:
            now = P.written(stage(spark, now, ""), "odd")
            if name != "packing":
                assert now.columns == given.columns

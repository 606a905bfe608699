import numpy as np
import pytest
import xxhash

from sigmill.llm import simhash


def slow(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    runs = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w]
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t ", "A", "a B", "a b c d é É", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == slow(text)


@pytest.mark.parametrize("same", [True, False])
def test_trie_finds_every_pair(same):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    x = np.unique(np.concatenate([base, near]))
    y = x if same else np.unique(near ^ np.uint64(1))
    want = {(i, j) for i in range(len(x)) for j in range(len(y)) if (not same or i < j) and int(x[i] ^ y[j]).bit_count() <= 2}
    got = [(int(i), int(j)) for a, b in simhash.trie_pairs(x, y, 0, 2, same, leaf=16, most=64) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


def brute(rows):
    fp = [slow(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(d, least.get(c, d))
    return sorted((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fp, comp))


def test_components(spark):
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rng = np.random.default_rng(2)
    rows = [(0, None), (1, ""), (2, "one"), (3, "one"), (3, "one")]
    for d in range(4, 60):
        t = list(rng.choice(words, 120)) if d % 3 else rows[-1][1].split()
        if d % 3 == 2:
            t[int(rng.integers(0, len(t)))] = "other"
        rows.append((d, " ".join(t)))
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in simhash.document_components(docs).collect())
    assert got == brute(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.document_components(none).count() == 0


def test_many_subtrees(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 300)
    near = base ^ (1 << rng.integers(0, 62, 300))
    nodes = spark.createDataFrame([(int(v),) for v in {*base.tolist(), *near.tolist()}], "fp long")
    got = {frozenset(r) for r in simhash.links(nodes, 2, per_node=16).collect()}
    assert all(frozenset((int(a), int(b))) in got for a, b in zip(base, near))


@pytest.mark.parametrize("per_node", [4, 40, 8192])
@pytest.mark.parametrize("budget", [2, 3])
def test_links_join_what_all_pairs_join(spark, per_node, budget):
    from sigmill.llm.components import Forest, connected_components

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    crowd = np.uint64(12345) ^ (rng.integers(0, 2**9, 150).astype(np.uint64) << np.uint64(30))  # one crowded subtree
    step = lambda a: a ^ (np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64))
    fp = np.unique(np.concatenate([base, step(step(base)), step(step(step(base))), crowd, [0, 2**64 - 1]]).astype(np.uint64))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= budget)
    forest = Forest(len(fp))
    forest.add(i, j)
    signed = fp.view(np.int64)
    nodes = spark.createDataFrame([(int(f),) for f in signed], "fp long")
    root = {r.node: r.root for r in connected_components(simhash.links(nodes, budget, per_node)).collect()}
    got, want = {}, {}
    for f, r in zip(signed.tolist(), forest.roots().tolist()):
        got.setdefault(root.get(f, f), set()).add(f)
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_large_ids_stay_exact_beside_null(spark):
    rows = [(2**53 + 1, "a b c"), (2**53 + 3, "d e f g"), (None, "h i")]
    got = simhash.document_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i) for i, _ in rows}

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.harness import difference

from sigmill.llm import merkle
from sigmill.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """All levels of a tree, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def beside(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((level[k ^ 1] if (k ^ 1) < len(level) else "", k % 2))
        k //= 2
    return out


def brute(rows):
    leaf_of = lambda r: sha("".join(map(told, (r[0], r[3], r[2], r[4], r[1]))))
    of = defaultdict(list)
    for r in rows:
        of[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = [up([x[2] for x in sorted(of[g], key=lambda x: x[:3])]) for g in langs]
    top = up([t[-1][0] for t in trees])
    out = []
    for g, (lang, tree) in enumerate(zip(langs, trees, strict=True)):
        for k, (*_, leaf, r) in enumerate(sorted(of[lang], key=lambda x: x[:3])):
            way = beside(tree, k) + beside(top, g)
            altered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf_of((*r[:4], r[4] + 1)) if altered else leaf
            for h, right in way:
                at = sha(h + at if right else at + h)
            out.append((r[0], leaf, tree[-1][0], top[-1][0], sha("".join(h for h, _ in way)), at, at == top[-1][0]))
    return sorted(map(repr, out))


def plain(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_equals_plain_trees(spark, stride):
    rows = [(i, f"text {i}", f"l{i % 3}" if i % 5 else "l0", f"s{i % 4}", i) for i in range(1, 150)]
    rows += [(900, "", None, None, None), (901, None, None, "s", 5), (None, None, None, None, None), (None, None, None, None, None), (902, "é😀" * 9, "one leaf", "", 0)]
    rows += [(7, "text 7", "l1", "s3", 7), (7, "other text", "l1", "s3", 7), (2**53 + 1, "x" * 300_000, "l2", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert plain(merkle.document_proofs(docs, stride=stride)) == brute(rows)


def test_one_language_of_equal_rows_and_one_row(spark):
    for rows in ([(1, "same", "en", "s", 4)] * 37, [(1, "same", None, "s", 4)]):
        assert plain(merkle.document_proofs(spark.createDataFrame(rows, SCHEMA), stride=2)) == brute(rows)


def test_empty_and_clashing_names(spark):
    assert merkle.document_proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, f"t{i}", "ab"[i % 2], "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = "m_row m_part m_at m_first m_before m_n m_of m_lang pos grp height digest leaf altered n level block proof up subroot root none".split()
    assert plain(merkle.document_proofs(docs.withColumns({c: F.lit("mine") for c in names}))) == brute(rows)


def test_equals_sql(spark):
    assert difference(queries()["op13_merkle"](spark, SF), oracle_sql()["op13_merkle"], SF) == ""

"""Odd rows for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.harness import difference

from sigmill.llm import embedding_dedup, licenses, line_dedup, mixing, packing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup
from sigmill.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
LONG = "word number one two three " * 4000
ROWS = [
    (1, "a b c d e f g h " * 6, "en", "s1", 5),
    (1, "a b c d e f g h " * 6, "en", "s1", 5),
    (2, None, None, None, None),
    (None, "no id here", "en", None, 1),
    (None, None, None, "s2", None),
    (3, "", "de", "s2", 0),
    (4, " \n\t\r\n ", "de", "s2", 6),
    (5, LONG, "en", "s1", len(LONG)),
    (6, LONG, "en", "s3", len(LONG)),
    (7, "one line\ntwo line\nthree line\nfour line", "en", "s1", 3),
    (7, "one line\ntwo line\nthree line\nlast", "en", "s1", 3),
    (8, "x\none line\ntwo line\nthree line\n\ny", "fr", "s1", 3),
    (9, "MIT License\n\nReleased under the MIT License. Licensed under the Apache License, Version 2.0.", "fr", "s4", 3),
    (10, "é" * 300 + "😀", "fr", "s4", 301),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda s, d: packing.document_pieces(d),
    "op2": lambda s, d: mixing.document_mix(d),
    "op3": lambda s, d: quality_classifier.classify(d, labels(s, [(1, 1, 0), (3, 0, None), (5, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, 1)])),
    "op4": lambda s, d: suffix_dedup.document_repeats(d),
    "op5": lambda s, d: line_dedup.document_lines(d),
    "op6": lambda s, d: sharding.document_shards(d),
    "op7": lambda s, d: licenses.document_licenses(d),
    "op8": lambda s, d: simhash.document_components(d),
    "op9": lambda s, d: quality_rules.document_rules(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_and_empty_tables(spark, odd, empty, name):
    clash = odd.withColumns({c: F.lit("mine") for c in ("size", "doc", "part", "fp", "shard", "slot", "kept", "n_words", "target", "spans", "h", "score")})
    plain, again = ([tuple(r) for r in RUNS[name](spark, t).collect()] for t in (odd, clash))
    order = lambda rows: sorted(map(repr, rows))
    if name != "op1":
        assert len(plain) == len(ROWS) and order(plain) == order(again)
    assert RUNS[name](spark, empty).count() == 0


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0])]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    clash = plain.withColumns({c: F.lit("mine") for c in ("key", "vec", "cls", "n", "kept", "block", "n_links", "component_id")})
    a, b = (sorted(repr(tuple(r)) for r in embedding_dedup.near_vectors(t).collect()) for t in (plain, clash))
    assert a == b and len(a) == len(rows)


@pytest.mark.parametrize("name", sorted(set(RUNS) - {"op3"}))
def test_large_ids_stay_exact_beside_null(spark, name):
    ids = [2**53 + 1, 2**53 + 3, None]
    docs = spark.createDataFrame([(i, f"text number {k} of three", "en", "s", 1) for k, i in enumerate(ids)], SCHEMA).coalesce(1)
    assert {r.doc_id for r in RUNS[name](spark, docs).select("doc_id").collect()} == set(ids)


def test_large_ids_of_scores(spark):
    ids = [2**53 + 1, 2**53 + 3, None, *range(40)]
    docs = spark.createDataFrame([(i, f"text number {k} of three" * (k % 5), "en", "s", 1) for k, i in enumerate(ids)], SCHEMA).coalesce(1)
    got = quality_classifier.classify(docs, labels(spark, [(i, i % 2, 0) for i in range(40)])).collect()
    assert {r.doc_id for r in got} == set(ids)


def test_filters_over_verdicts_are_cheap_on_a_long_text(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "s", 1)], SCHEMA)
    quality_rules.apply_rules(docs).filter("kept").count()
    began = time.perf_counter()
    assert quality_rules.apply_rules(docs).filter("kept").count() == 0
    assert time.perf_counter() - began < 30


def test_mix_keeps_limits(spark, odd):
    got = mixing.document_mix(odd).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in got) and all(r.target <= 2 * r.source_size for r in got)


def test_mix_meets_targets(spark):
    rows = [(i, f"{'w ' * (i % 7 + 1)}", f"s{min(i % 9, 4)}") for i in range(3000)]
    got = mixing.document_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in got))


def test_mix_is_clamped_and_all_zero(spark):
    got = mixing.document_mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert all(r.taken == 0 and r.target == 0 for r in got)


def test_shards(spark, odd):
    got = sharding.document_shards(odd).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1


def test_slots_of_null_and_repeated_keys(spark):
    rows = [(None, f"text {i % 40}") for i in range(700)] + [(5, "same")] * 600 + [(i, "x" * (i % 9)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.document_shards(docs).collect()
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    nulls = sorted((r.slot, r.size) for r in got if r.doc_id is None)
    assert [x for _, x in nulls] == sorted(x for _, x in nulls) and len({r.shard for r in got if r.doc_id is None}) == 1


def test_a_new_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"))
    got = sharding.assign_shards(ids, "doc_id", sharding.equal_tree(40), sharding.equal_tree(41, built=40)).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40} and 700 < len(moved) < 1300
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and 800 < min(sizes.values()) and max(sizes.values()) < 1200


@pytest.mark.parametrize("shards", [41, 42, 45])
def test_every_further_shard_takes_rows_only_into_itself(spark, shards):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    got = sharding.assign_shards(ids, "doc_id", sharding.equal_tree(shards, built=40), sharding.equal_tree(shards + 1, built=40)).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {shards} and len(moved) > 300


def test_weights_move_rows_only_through_the_changed_subtrees(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    heavy = [1.0] * 40
    heavy[9] = 3.0
    tree, other = sharding.equal_tree(40), sharding.Tree(heavy)
    got = sharding.assign_shards(ids, "doc_id", tree, other).collect()
    for r in got:
        if r.shard != r.grown_shard:
            assert tree.region(r.grown_shard) == 1  # only the region that grew takes rows
    share = Counter(r.grown_shard for r in got)
    assert 2.3 < share[9] / (20_000 / 42) < 3.7


def test_lines_by_hand(odd):
    got = {r.kept_sha256: r.n_removed for r in line_dedup.document_lines(odd).filter("doc_id in (7, 8)").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[sha("x\n\ny")] == 3
    assert sorted(got.values()) == [0, 3, 3]


def test_licenses_by_hand(spark, odd):
    got = {r.doc_id: r for r in licenses.document_licenses(odd).filter("doc_id = 9").collect()}
    assert (got[9].sentence_ids, got[9].licenses) == ("mit-title,mit-notice,apache-notice", "Apache-2.0,MIT")
    bsd = [licenses.SENTENCES[i][0] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    two, turned = "\n".join(bsd[:3]), "\n".join(bsd[2::-1])
    rows = [(1, "\n".join(bsd)), (2, two), (3, turned)]
    got = {r.doc_id: r.licenses for r in licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: ""}


def test_rule_order_changes_work_not_verdicts(odd):
    found = quality_rules.add_statistics(odd)
    rules = quality_rules.further_rules()
    one, two = (found.select(quality_rules.cascade(r).isNull().alias("k")).collect() for r in (rules, rules[::-1]))
    assert [r.k for r in one] == [r.k for r in two]
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    want = quality_rules.apply_rules(odd).filter("kept").count()
    assert kept.count() == want


def test_classifier_on_held_out_rows(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, known).join(known, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) > 0


def test_classifier_without_classes(spark, odd):
    assert zlib.crc32(b"8") % 3 != 1 == zlib.crc32(b"3") % 3
    got = {r.score for r in quality_classifier.classify(odd, labels(spark, [(8, 1, 0)])).collect()}
    assert got == {1.0}
    assert {r.score for r in quality_classifier.classify(odd, labels(spark, [(3, 1, 0)])).collect()} == {0.5}  # held out
    assert {r.score for r in quality_classifier.classify(odd, labels(spark, [])).collect()} == {0.5}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(queries()[name](spark, SF), oracle_sql()[name], SF) == ""


def test_near_copies_keep_one_row_of_a_repeated_id(spark, odd):
    kept = simhash.keep_one(odd)
    assert Counter(r.doc_id for r in kept.collect())[1] == 1


def test_near_copies_keep_unlike_texts_under_one_id_or_none(spark):
    rows = [(7, "one two three four"), (7, "five six seven eight"), (None, "nine ten eleven"), (None, "twelve thirteen fourteen"), (None, "nine ten eleven"), (8, "one two three four")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = {(7, "one two three four"), (7, "five six seven eight"), (None, "nine ten eleven"), (None, "twelve thirteen fourteen")}
    assert Counter(map(tuple, kept.collect())) == Counter(want)

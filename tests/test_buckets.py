"""Tables in buckets against a dict: what changes, what isn't touched, what a dying or second writer leaves."""

import random

import pytest
from pyspark.sql import functions as F

from sigmill.sources import buckets, sinks

SCHEMA = "id long, part string, v long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(spark, held):
    return spark.createDataFrame([(*k, v) for k, v in held.items()], SCHEMA)


def test_changes_against_a_dict(spark):
    rng, path = random.Random(5), sinks.new_path(spark, "buckets")
    key = lambda: (rng.choice([None, *range(40)]), rng.choice(["a", None]))
    want = {key(): rng.randrange(100) for _ in range(30)}
    want[3, "a"] = None
    buckets.replace(made(spark, want), path, ["id", "part"], buckets=8, files=2)
    for step in range(8):
        new = {key(): rng.randrange(100) for _ in range(rng.randrange(0, 6))}
        if step % 4 == 0:
            got, want = buckets.merge(made(spark, new), path), {**want, **new}
        elif step % 4 == 1:
            got, want = buckets.append_missing(made(spark, new), path), {**new, **want}
        elif step % 4 == 2:
            got, want = buckets.update(made(spark, new), path), {k: new.get(k, v) for k, v in want.items()}
        else:
            got, want = buckets.delete(spark, path, F.col("v") < 20), {k: v for k, v in want.items() if v is None or v >= 20}
        assert rows(got) == rows(buckets.read(spark, path)) == sorted(((*k, v) for k, v in want.items()), key=repr)
    buckets.vacuum(spark, path, 1)
    assert len(buckets.versions(spark, path)) == 1 and rows(buckets.read(spark, path)) == rows(got)


def test_only_touched_buckets_are_rewritten(spark):
    path = sinks.new_path(spark, "buckets")
    first = buckets.replace(spark.range(1000).selectExpr("id", "'a' as part", "id as v"), path, ["id"], buckets=16)
    before = set(first.inputFiles())
    after = set(buckets.merge(spark.createDataFrame([(7, "b", 0)], SCHEMA), path).inputFiles())
    assert len(before) == len(after) == 16 and len(before - after) == len(after - before) == 1
    assert rows(buckets.read(spark, path, 1)) == rows(first) and first.filter("id = 7").first().v == 7
    added = set(buckets.append_missing(spark.createDataFrame([(5000, "n", 1)], SCHEMA), path).inputFiles())
    assert after < added and len(added - after) == 1
    assert set(buckets.delete(spark, path, F.col("id") == -1).inputFiles()) == added


def test_a_failed_change_and_a_second_writer(spark):
    path = sinks.new_path(spark, "buckets")
    held = buckets.replace(spark.createDataFrame([(1, "a", 1), (2, "a", 2)], SCHEMA), path, ["id"], buckets=4)
    bad = spark.createDataFrame([(1, "a", 5)], SCHEMA).withColumn("v", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        buckets.merge(bad, path)
    assert rows(buckets.read(spark, path)) == rows(held) and buckets.versions(spark, path) == [1]
    version, listed = buckets._listed(spark, path)
    buckets.merge(spark.createDataFrame([(1, "b", 6)], SCHEMA), path)
    with pytest.raises(buckets.ChangedMeanwhile):
        buckets._changed(spark, path, version, listed, spark.createDataFrame([(2, "c", 7)], SCHEMA), [0, 1, 2, 3])
    assert rows(buckets.read(spark, path)) == [(1, "b", 6), (2, "a", 2)]
    buckets.vacuum(spark, path)
    assert rows(buckets.read(spark, path)) == [(1, "b", 6), (2, "a", 2)]


def test_violations_on_a_written_table(spark):
    path, parents = sinks.new_path(spark, "buckets"), spark.createDataFrame([(1,), (2,)], "id long")
    buckets.replace(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], SCHEMA), path, ["id"])
    out = buckets.append_missing(spark.createDataFrame([(1, "b", 2), (3, "b", 2), (3, "c", 2)], SCHEMA), path)
    assert {r.rule: r.rows for r in sinks.violations(out, ["id"], parents, "id").collect()} == {"unique": 0, "foreign key": 1}

"""Sinks on small tables: what is added, and what constraints would refuse."""

from sigmill.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_append(spark):
    path = sinks.new_path(spark, "test")
    make = lambda data: spark.createDataFrame(data, "id long, v string")
    assert rows(sinks.append(make([(1, "a"), (2, None)]), path)) == [(1, "a"), (2, None)]
    assert rows(sinks.append(make([(2, "x")]), path)) == [(1, "a"), (2, "x"), (2, None)]


def test_violations(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (7, 1)], "id long, k int")
    got = {r.rule: r.rows for r in sinks.violations(child, ["id", "k"], spark.createDataFrame([(1,), (2,)], "id long"), "id").collect()}
    assert got == {"unique": 1, "foreign key": 1}
    none = {r.rule: r.rows for r in sinks.violations(child.limit(0), ["id", "k"], child.select("id"), "id").collect()}
    assert none == {"unique": 0, "foreign key": 0}

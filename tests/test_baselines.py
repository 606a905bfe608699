"""Baselines against sorted lists of all rows."""

import random

from sigmill.operators import baselines


def p90(values):
    return sorted(values)[9 * len(values) // 10]


def test_chain_equals_sorted_lists(spark):
    rng, rows = random.Random(4), []
    for source, most in (("big", 40), ("mid", 12), ("few", 4), ("dry", 4)):
        for slot in range(30):
            rows += [(source, slot, rng.choice([0, 5, 900, 5000, 10**6]) + rng.randrange(1 + 3000 * (slot % 2))) for _ in range(rng.randrange(most))]
    rows += [("zero", 1, 0)] * 25 + [(None, 1, 3), ("few", None, 3), ("dry", 2, None)]
    stored = [("few", s, rng.randrange(15, 30), rng.randrange(100)) for s in range(30)] + [("dry", 1, 50, 7), ("dry", 2, 50, 8)]
    counted = spark.createDataFrame(rows, "source string, slot int, value long").groupBy("source", "slot", "value").count().withColumnRenamed("count", "c")
    got = {(r.source, r.slot): (r.p90, r.sample_size, r.method) for r in baselines.chain(counted, spark.createDataFrame(stored, "source string, slot int, n long, p90 long"), 5, {"dry": 33}).collect()}
    want, full = {}, [r for r in rows if None not in r]
    for source, slot in {r[:2] for r in full}:
        batch = [v for s, t, v in full if (s, t) == (source, slot)]
        span = [v for s, t, v in full if s == source and slot - 5 < t <= slot]
        old = sorted((p, n) for s, t, n, p in stored if s == source and slot - 5 < t <= slot and n >= 20)
        if len(batch) >= 20:
            want[source, slot] = max(p90(batch), 1), len(batch), "batch_current"
        elif len(span) >= 60:
            want[source, slot] = max(p90(span), 1), len(span), "rolling_14d"
        elif len(old) >= 3:
            want[source, slot] = old[len(old) // 2][0], sum(n for _, n in old), "snapshot_median"
        else:
            want[source, slot] = 33 if source == "dry" else 100, 0, "bootstrap"
    assert got == want and len({w[2] for w in want.values()}) == 4


def test_no_rows(spark):
    none = spark.createDataFrame([], "source string, slot int, value long, c long")
    assert baselines.chain(none, spark.createDataFrame([], "source string, slot int, n long, p90 long"), 5, {"a": 1}).count() == 0

"""Calibration by what was known at the time, against a loop over predictions in the order of time."""

import random
from fractions import Fraction

from sigmill.operators import calibration

SCHEMA = "id long, kind string, raw double, half_width double, made_at int, resolved_at int, actual boolean"


def plain(rows):
    out = {}
    for i, kind, raw, half, at, _, _ in rows:
        if raw is None:
            out[i] = (None,) * 5
            continue
        before = [] if at is None else [r for r in rows if r[1] == kind and r[2] is not None and r[5] is not None and r[6] is not None and r[5] < at]
        b = min(round(raw * 1000) // 100, 9)
        mine = [r[6] for r in before if min(round(r[2] * 1000) // 100, 9) == b]
        times = None
        if len(before) >= 20 and len(mine) >= 5:
            times = int(Fraction(sum(mine), len(mine)) / Fraction(2 * b + 1, 20) * 1000 + Fraction(1, 2)) / 1000
        sure = raw if times is None else max(0.01, min(0.99, raw * times))
        ratio = sure / raw if raw else 1.0
        out[i] = times, sure, max(0, (raw - half) * ratio), min(1, (raw + half) * ratio), sure >= 0.5
    return out


def test_equals_a_loop_over_time(spark):
    rng, rows = random.Random(11), []
    for i in range(400):
        kind, at = rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(20)])
        done = None if rng.random() < 0.2 else (at or 0) + rng.randrange(1, 5)
        rows.append((i, kind, rng.choice([None, 0.0, 1.0, rng.randrange(1001) / 1000, 0.3, 0.9]), 0.25, at, done, None if rng.random() < 0.1 else rng.random() < 0.6))
    want = plain([r for r in rows if r[1] is not None]) | {r[0]: x for r in rows if r[1] is None for x in [plain([q for q in rows if q[1] is None])[r[0]]]}
    got = {r.id: (r.multiplier, r.confidence, r.low, r.high, r.predicted) for r in calibration.calibrated(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert set(got) == set(want) and sum(v[0] is not None for v in want.values()) > 50
    for i, w in want.items():
        for x, y in zip(got[i], w, strict=True):
            assert x == y or abs(x - y) < 1.1e-3, (rows[i], got[i], w)


def test_nothing_known_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a", 0.4, 0.1, 5, 5, True)] * 30, SCHEMA)
    assert {tuple(r)[-5:] for r in calibration.calibrated(one).collect()} == {(None, 0.4, 0.3, 0.5, False)}
    assert calibration.calibrated(one.limit(0)).count() == 0

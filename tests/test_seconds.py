"""Queries over the seconds of events, held against their SQL on times that lie close to borders."""

import duckdb
import pytest
from tests.harness import difference

from sigmill import registry

COLUMNS = "event_id, ts, user_id, event_type, value, props"


def events(tmp_path, rows):
    """A folder whose events are rows (event_id, ts, user_id)."""
    told = ", ".join(f"({e}, {f'timestamp {t!r}' if t else 'null'}, {'null' if u is None else u})" for e, t, u in rows)
    sql = f"select e::bigint as event_id, t::timestamp as ts, u::bigint as user_id, 'error' as event_type, 1.0::double as value, '{{\"k\": 1}}' as props from (values {told}) v(e, t, u)"
    duckdb.connect().execute(f"copy ({sql}) to '{tmp_path}/events.parquet' (format parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["m03_time_decay", "m13_inclusive_span"])
def test_days_by_borders_of_seconds(spark, tmp_path, name):
    times = ["2024-01-24 00:00:00.4", "2024-01-23 23:59:59.9", "2024-01-25 00:00:00", "2024-01-31 00:00:00.5", "2024-02-09 10:00:00.7", None]
    sf = events(tmp_path, [(k, t, k % 2) for k, t in enumerate(times)] + [(k + 10, t, 2) for k, t in enumerate(times[:3])] + [(20, times[0], 3), (21, times[2], 3)])
    assert difference(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf) == ""


def test_alerts_by_nearest_second(spark, tmp_path):
    rows = [
        (9, "2024-01-01 00:00:00.2", 1), (3, "2024-01-01 00:00:00.4", 1), (4, "2024-01-01 23:59:59.6", 1),  # 9 is first of its second; 4 is a day behind
        (12, "2024-01-01 00:00:00.6", 2), (13, "2024-01-02 00:00:00.7", 2), (14, "2024-01-02 00:00:00.3", 2),
        (20, "2024-01-01 00:00:00.5", 3), (21, "2024-01-01 23:59:59.5", 3), (22, "2024-01-02 00:00:01.5", 3),  # halves to the even second
        (31, None, 4), (30, None, 4), (40, None, 5), (41, "2024-01-01 00:00:00", 5),
        (50, "2024-01-03 00:00:00", None), (51, "2024-01-01 00:00:00", None), (52, "2024-01-08 00:00:00", None),
    ]
    sf = events(tmp_path, rows)
    name = "j17_alerts_within_a_day"
    assert difference(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf) == ""

"""Every registered query against its SQL; those without against a brute-force version or for shape."""

import pytest
from tests.harness import difference

from sigmill import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), SQL[name], SF) == ""


def test_only_these_have_no_sql():
    assert sorted(set(QUERIES) - set(SQL)) == ["d01_matched_pairs", "d01_three_passes", "d02_event_groups", "d02_events_in_passes", "d03_merged_trends", "d04_density_clusters", "j10_title_similarity_pairs", "j11_entity_and_title_groups"]

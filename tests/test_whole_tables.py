"""Queries that use their whole tables, beside older ones whose SQL is limited to a part."""

import pytest

from sigmill import registry
from sigmill.sources.tables import signals

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["w03_running_distinct_all", "k02_append_skip_duplicates_all", "k03_upsert_all"])
def test_every_signal_has_a_row(spark, name):
    got = [r.id for r in registry.queries()[name](spark, SF).select("id").collect()]
    assert sorted(got) == sorted(r.id for r in signals(spark, SF).select("id").collect())


def test_every_query_vector_is_searched(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").collect()}
    assert {r.query_id for r in registry.queries()["j13_vector_top_k_all"](spark, SF).collect()} == ids and len(ids) > 1

"""Pairs of customers and parts: what is told of a pair is read once, what is told of a post is made for posts."""

from sigmill.registry import queries


def test_ranked_pairs_join_items_and_orders_twice(spark):
    plan = queries()["d30_personal_rank_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # once for pairs with what was returned of them, once for outcomes of parts
    assert plan.count("Relation [l_orderkey") == 2

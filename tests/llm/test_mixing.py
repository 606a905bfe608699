from collections import Counter

import pytest

from sigmill.llm import mixing
from sigmill.llm.queries import oracle_sql
from tests.harness import difference

SCHEMA = "doc_id long, text string, source string"


def tables():
    ten = "w " * 10
    spread = [(100 + i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(300)]
    return {
        "repeated key": [(1, ten, "a")] * 1000 + [(2, ten, "b")] * 10 + spread,
        "null keys": [(None, ten, "a")] * 1000 + spread,
        "null keys of many sizes": [(None, "w " * (1 + i % 50), "a") for i in range(1000)] + spread,
        "null keys and sources": [(None, ten, None)] * 500 + [(None, None, None)] * 50 + spread,
    }


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("name", sorted(tables()))
def test_repeated_and_null_keys_meet_their_targets(spark, monkeypatch, tmp_path, name, few):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = tables()[name]
    spark.createDataFrame(rows, SCHEMA).toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source").repartition(4)
    assert difference(mixing.document_mix(docs), oracle_sql()["op2_mixing"], str(tmp_path)) == ""
    sized = docs.select("source", mixing.word_count(docs["text"]).alias("size"), "doc_id")
    got = mixing.mix(sized).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.repeats <= 2
        taken[r.source] += r.repeats * r.size
        most[r.source] = max(most[r.source], r.size)
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 for s in target)

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sigmill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(special=True):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not special
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "  \n\n x", "don't I'LL 12３ ²", "<|endoftext|>", "a  <|endoftext|>\n <|endoftext|><|endoftext", "日本 😀é́", "a" * 3000, "\t \r\n", "\x00\x85\xa0z"]
LONG = [" " * 3_000_000 + "x", "y" + "\n" * 3_000_000, " \n" * 600_000 + "<|endoftext|>z", "a" * 1_500_000, " " * 49_990 + "b"]


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_tokenizers(spark, special):
    want, got = reference(special), packing.encoder(PATH, special)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    for t in [*ODD, *LONG, *(r.text for r in docs)]:
        assert list(got(t)) == list(want(t))


def test_long_white_space_and_special_tokens_in_the_query(spark):
    texts = [*ODD, LONG[0], LONG[2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: len(reference()(t)) + 1 for i, t in enumerate(texts)}
    assert {r.doc_id: r.doc_tokens for r in packing.document_pieces(docs).select("doc_id", "doc_tokens").distinct().collect()} == want


@pytest.mark.parametrize("size", [16, 2048])
def test_round_trip(spark, size):
    ids = reference()
    texts = [None, "", "one two", "one two", "long text with many words " * 300, *[f"number {i}" for i in range(40)]]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(5)
    tokens = packing.tokenize(docs, PATH)
    want = {i: [*ids(t or ""), 1] for i, t in enumerate(texts)}
    got, seqs = packing.pieces(tokens, size).collect(), {r.sequence_id: r.ids for r in packing.sequences(tokens, size).collect()}
    total = sum(map(len, want.values()))
    assert sorted(seqs) == list(range(-(-total // size)))
    assert [len(seqs[s]) for s in sorted(seqs)] == [size] * (total // size) + [total % size] * bool(total % size)
    seen = {i: [None] * len(x) for i, x in want.items()}
    for r in got:
        part = seqs[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        assert all(x is None for x in seen[r.doc_id][r.start : r.start + r.length])
        seen[r.doc_id][r.start : r.start + r.length] = part
    assert seen == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    tokens = packing.tokenize(none, PATH)
    assert packing.pieces(tokens).count() == 0 and packing.sequences(tokens).count() == 0

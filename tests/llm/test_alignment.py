import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigmill.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["hello world", "hello world", "Don't stop", " two  spaces ", "\n\ttabs", "é😀 ﬁ", "a▁b", "<|endoftext|> <s> </s>", "", None, "x", "日本語のテキスト", "hello world " * 400, "word\x00zero", "<0x41>"]


def brute(rows):
    """By the file's own libraries, byte by byte, every pair of occurrences looked at through the bytes it covers."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found, count = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        a = [(i, bytes(byte[c] for c in vocab[i])) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            found.append((doc_id, None))
            continue
        own = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        pairs = [(a[i][0], b[j][0]) for i, j in sorted(set(zip(*own, strict=True)))]
        count.update(pairs)
        groups, i, j, la, lb = [], [], [], 0, 0
        qa, qb = list(a), list(b)
        while qa or qb:
            if la <= lb and qa:
                t, x = qa.pop(0)
                i.append(str(t))
                la += len(x)
            else:
                t, x = qb.pop(0)
                j.append(str(t))
                lb += len(x)
            if la == lb:
                groups.append(",".join(i) + "|" + ",".join(j))
                i, j = [], []
        found.append((doc_id, (len(a), len(b), groups, pairs)))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, told in found:
        if told is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = told
        best = sum(count[p] == most[p[1]] for p in pairs)
        out.append((doc_id, n_a, n_b, len(groups), len(pairs), best, sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(map(repr, out))


def plain(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("small", [1_000_000, 3])
def test_equals_brute_force(spark, small, monkeypatch):
    """Pair counts and measures sent to every executor, and shuffled beside their hot keys."""
    monkeypatch.setattr(alignment, "HOT_SHARE", 10)
    rows = [*enumerate(TEXTS), (3, "hello world"), (3, "other text"), (None, "hello world"), (None, None), (2**53 + 1, "hello world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert plain(alignment.document_alignment(docs, small=small)) == brute(rows)


def test_equals_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert plain(alignment.document_alignment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == brute(rows)


def test_long_texts(spark):
    rows = [(1, " " * 1_200_000 + "x"), (2, "ab " * 400_000), (3, "z" * 300_000)]
    got = {r.doc_id: r for r in alignment.document_alignment(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for r in got.values():
        assert r.n_a and r.n_links == r.n_a + r.n_b - r.n_groups


def test_empty_and_clashing_names(spark):
    assert alignment.document_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(alignment.document_alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()) == 2
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    names = "tid copies n_a n_b n_groups n_links groups_sha256 pairs times pair in_texts count best most b p n_best count_sum".split()
    assert plain(alignment.document_alignment(docs.withColumns({c: F.lit("mine") for c in names}))) == brute(list(enumerate(TEXTS)))

"""Packing by concatenate and cut: one long stream of tokens, cut into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import written

#: Fixed value: how byte-level BPE cuts a text before it merges.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space, or of anything else, that the faster library isn't given.
LONG_RUN = re.compile(r"(?<!\s)\s{50000}|(?<!\S)\S{50000}")

#: Rows of totals (one for each task of the first pass) up to which they are sent to every executor.
BROADCAST_ROWS = 1_000_000

TOKENS = "part int, doc_id long, n long, before long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PARTS = "sequence_id long, offset long, ids binary, whole boolean"


def byte_names() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character; its value by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_byte_level(told: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the usual cuts and merges in the order of their ids."""
    cuts, model = told.get("pre_tokenizer") or {}, told["model"]
    if cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space") or not cuts.get("use_regex", True) or told.get("normalizer"):
        return False
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in odd):
        return False
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(t, -1) for t in made]
    return ids[:1] != [-1] and all(a < b for a, b in zip(ids, ids[1:], strict=False)) and all(c in model["vocab"] for c in byte_names())


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> Callable[[str], list[int]]:
    """Ids of a text under the tokenizer file at ``path``; nothing is put around the text.

    Strings of special tokens that stand in a text become those tokens, as the file's library
    does it, or are plain text if not ``special``. Byte-level BPE files whose merges stand in the
    order of their ids (the usual case) are run by a faster library with the same
    vocabulary; tests hold the two equal. Any other file is run by its own library, and so
    are texts with a run of letters or of white space too long for the faster one.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not special
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = told.get("added_tokens", [])
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    if not _plain_byte_level(told) or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) or not all(t.get("special") for t in added):
        return slow
    import tiktoken

    names, marks = byte_names(), {t["content"]: t["id"] for t in added}
    ranks = {bytes(names[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in marks}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    border = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if special and marks else None

    def ids(text: str) -> list[int]:
        if LONG_RUN.search(text):
            return slow(text)
        if not border or not border.search(text):
            return fast(text)
        out, at = [], 0
        for m in border.finditer(text):
            out += [*fast(text[at : m.start()]), marks[m[0]]]
            at = m.end()
        return out + fast(text[at:])

    return ids


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """First pass: ids of every document with ``end_id`` behind, and places in its partition.

    ``before`` counts the partition's tokens ahead of the document. The table is
    written, so partition numbers and places stay as they are from here on.
    Null text is empty: such a document is its end id alone. Ids take 32 bits each.
    Rows that repeat a doc_id or a text are documents of their own; null ids stay null;
    an empty table has no tokens; other columns are left behind, whatever their names.
    A text of any length is one row: ids are as large as its bytes, about.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.array([*encode(t or ""), end_id], "<u4") for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            out = [pa.array(np.full(len(n), part, np.int32)), b.column("doc_id"), pa.array(n), pa.array(at), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["part", "doc_id", "n", "before", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, TOKENS), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Second pass: adds ``first``, the place of a document's first token in the whole stream.

    Only the partitions' totals are summed in one place: a row for each task of the
    first pass. They are sent to every executor if they are few enough, and joined by
    Spark's own choice beyond that.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("_n"))
    base = totals.select("part", (F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_base"))
    base = written(base, "bases")
    return tokens.join(F.broadcast(base) if base.count() <= BROADCAST_ROWS else base, "part").select("doc_id", "n", "ids", (F.col("_base") + F.col("before")).alias("first"))


def _cuts(first: int, n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) in the document of each piece that the windows' borders leave."""
    at = 0
    while at < n:
        to = min(n, at + size - (first + at) % size)
        yield at, to
        at = to


def pieces(tokens: DataFrame, size: int = 2048) -> DataFrame:
    """One row for each piece of a document that lies in one window."""
    names = PIECES.replace(" long", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            n, ids, first = (b.column(c).to_pylist() for c in ("n", "ids", "first"))
            for k, at in enumerate(first):
                for s, e in _cuts(at, n[k], size):
                    of.append(k)
                    rows.append((s, e - s, zlib.crc32(ids[k][4 * s : 4 * e]), n[k], (at + s) // size, (at + s) % size))
            told = np.array(rows, np.int64).reshape(-1, len(names) - 1)
            # ids stay in Arrow: pandas would turn a column with nulls into doubles
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(c) for c in told.T.copy())], names)

    return placed(tokens).mapInArrow(run, PIECES)


def sequences(tokens: DataFrame, size: int = 2048) -> DataFrame:
    """The packed sequences: sequence_id, ids (array of int); only the last may be short.

    A task puts together the windows that lie within what it reads. Windows across a
    border of tasks leave boundary records, which are grouped by window: at most
    ``size`` tokens meet, however many tasks there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, window, offset = [], -1, 0

        def flush() -> tuple:
            raw = b"".join(held)
            return window, offset, raw, offset == 0 and len(raw) == 4 * size

        for b in batches:
            rows = []
            for n, raw, first in zip(b["n"], b["ids"], b["first"], strict=True):
                for s, e in _cuts(first, n, size):
                    at = first + s
                    if at // size != window or at % size != offset + sum(map(len, held)) // 4:
                        if held:
                            rows.append(flush())
                        held, window, offset = [], at // size, at % size
                    held.append(raw[4 * s : 4 * e])
            yield pd.DataFrame(rows, columns=["sequence_id", "offset", "ids", "whole"])
        if held:
            yield pd.DataFrame([flush()], columns=["sequence_id", "offset", "ids", "whole"])

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sequence_id": b["sequence_id"], "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in b["ids"]]})

    cut = written(placed(tokens).mapInPandas(run, PARTS), "windows")
    edge = cut.filter("not whole").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = edge.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return cut.filter("whole").select("sequence_id", "ids").unionByName(joined).mapInPandas(ids, "sequence_id long, ids array<int>")


def document_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of the packing of ``documents``: a row for each piece."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pieces(tokenize(docs, str(path)))

"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which of another.

Equal texts meet by their full text, are tokenised and aligned once, and count as often as
they occur; what was found for a text is then told to every document that holds it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import written
from sigmill.llm.packing import byte_names, encoder

#: Rows of pair counts up to which all of them go to every executor (16 bytes each).
BROADCAST_PAIRS = 1_000_000

#: Beyond that, only keys with more than one row in so many do: there can't be more of them than this.
HOT_SHARE = 10_000

ALIGNED = "tid binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Side(NamedTuple):
    """A tokenizer: ids of a text, and for every id its bytes and their number."""

    encode: Callable[[str], list[int]]
    raw: list[bytes]
    size: np.ndarray


@lru_cache(maxsize=4)
def byte_level(path: str) -> Side:
    """Byte-level BPE over the text with a space ahead; strings of special tokens are plain text."""
    ids = encoder(path, special=False)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    names, raw = byte_names(), [b""] * (1 + max([*told["model"]["vocab"].values(), *(t["id"] for t in told.get("added_tokens", []))]))
    for token, i in told["model"]["vocab"].items():
        raw[i] = bytes(names[c] for c in token) if all(c in names for c in token) else token.encode()
    return Side(lambda text: ids(" " + text), raw, np.array([len(x) for x in raw]))


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Side:
    """A SentencePiece model, which puts the space ahead itself; ``<0xHH>`` is a byte, U+2581 a space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    name = sp.id_to_piece
    raw = [bytes([int(name(i)[3:5], 16)]) if sp.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return Side(lambda text: sp.encode(text, num_threads=1), raw, np.array([len(x) for x in raw]))


def cut_at(text: str, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of both sides and the byte offsets at which their tokens end; None if either isn't the text's bytes."""
    want, out = (" " + text).encode("utf-8", "surrogatepass"), []
    for side in (a, b):
        ids = side.encode(text)
        if b"".join([side.raw[i] for i in ids]) != want:
            return None
        ids = np.array(ids, np.int64)
        out += [ids, np.cumsum(side.size[ids])]
    return tuple(out)


def links(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """(A id << 32 | B id) of every two token occurrences whose bytes overlap: one for each run between ends."""
    ends = np.union1d(ends_a, ends_b)
    return ids_a[np.searchsorted(ends_a, ends)] << 32 | ids_b[np.searchsorted(ends_b, ends)]


@lru_cache(maxsize=1)
def _digits(ids: int) -> np.ndarray:
    """A row for each id: its decimal digits, zero bytes before them, and room for a mark behind."""
    width = len(str(ids))
    rows = np.frombuffer("".join(f"{i:>{width}} " for i in range(ids)).encode(), np.uint8).reshape(ids, width + 1)
    return np.where(rows == ord(" "), 0, rows)


def groups(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, ids: int) -> tuple[int, bytes]:
    """Number of groups between offsets where both sides end, and their text ``a1,a2|b1;a3|b2``; all ids are below ``ids``."""
    at = np.searchsorted(ends_b, ends_a)
    ends = ends_b[at] == ends_a
    last_a, last_b = np.flatnonzero(ends), at[ends]
    group_a, group_b = np.cumsum(ends) - ends, np.zeros(len(ids_b), np.int64)
    group_b[last_b[:-1] + 1] = 1
    group_b = np.cumsum(group_b)
    # a token stands behind those of its side, and behind the other side's of the groups before (A) or up to its own (B)
    place_a = np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]
    place_b = np.arange(len(ids_b)) + (last_a + 1)[group_b]
    rows = np.empty((len(ids_a) + len(ids_b), _digits(ids).shape[1]), np.uint8)
    for place, own, last, mark in ((place_a, ids_a, last_a, "|"), (place_b, ids_b, last_b, ";")):
        rows[place] = _digits(ids)[own]
        rows[place, -1] = ord(",")
        rows[place[last], -1] = ord(mark)
    return len(last_a), rows[rows != 0].tobytes()[:-1]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each distinct text: what its alignment is, its pairs of ids and how often each is linked.

    Texts are shuffled whole, so equal ones meet exactly, copies of any number being folded before
    they travel; ``tid`` is the text's sha256. Null and empty texts are left out. A text is
    worked on at once, in memory in proportion to it.
    """
    names, kinds = [c.split()[0] for c in ALIGNED.split(", ")], [pa.binary(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces_of(b_path)
        most = max(len(a.raw), len(b.raw))
        for batch in batches:
            out = []
            for tid, copies, text in zip(*(batch.column(c).to_pylist() for c in ("tid", "copies", "text")), strict=True):
                if (cut := cut_at(text, a, b)) is None:
                    out.append((tid, copies, 0, 0, 0, 0, "", [], []))
                    continue
                pairs, times = np.unique(links(*cut), return_counts=True)
                n, told = groups(*cut, most)
                out.append((tid, copies, len(cut[0]), len(cut[2]), n, int(times.sum()), hashlib.sha256(told).hexdigest(), pairs, times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return written(texts.select(_tid(F.col("text")).alias("tid"), "copies", "text").mapInArrow(run, ALIGNED), "aligned")


def _tid(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def met(rows: DataFrame, told: DataFrame, key: str, weight: str, small: int) -> DataFrame:
    """Inner join of ``rows`` with ``told``, one row a ``key``, of which ``weight`` rows exist.

    ``told`` goes to every executor if it has no more than ``small`` rows. Beyond that only
    keys of more than a ``HOT_SHARE``-th of all rows do, of which there are no more than
    ``HOT_SHARE``; all others shuffle, none being large.
    """
    n, total = told.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= small:
        return rows.join(F.broadcast(told.drop(weight)), key)
    hot = F.col(weight) * HOT_SHARE > total
    some = F.broadcast(told.filter(hot).select(key))
    cold = rows.join(some, key, "left_anti").join(told.filter(~hot).drop(weight).hint("merge"), key)
    return rows.join(F.broadcast(told.filter(hot).drop(weight)), key).unionByName(cold)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, in_texts, count, best): links of each pair of ids over all documents; best is that of its B id."""
    each = texts.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    count = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.count(F.lit(1)).alias("in_texts"), F.sum(F.col("p.times") * F.col("copies")).alias("count"))
    count = written(count, "pair-counts")
    best = count.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most"))
    return written(count.join(best, F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("pair", "in_texts", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def measures(texts: DataFrame, counts: DataFrame, small: int = BROADCAST_PAIRS) -> DataFrame:
    """(tid, n_best, count_sum) of each text that has links."""
    each = texts.select("tid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("tid", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    each = met(each, counts, "pair", "in_texts", small)
    return each.groupBy("tid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def document_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, small: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each document: its tokens, groups and links under two tokenizers, and how common the links are.

    Documents of null or empty text, and those whose tokens don't give back the text, have zeros.
    Rows that repeat a doc_id or a text stay rows, null ids stay null, an empty table stays empty and
    other columns are left behind, whatever their names.
    """
    if a_path is None or b_path is None:
        import public_tokenizers as known

        a_path, b_path = a_path or known.path("byte_bpe_50k.json"), b_path or known.path("piece_bpe_32k.model")
    texts = aligned(docs, str(a_path), str(b_path))
    told = texts.drop("pairs", "times").join(measures(texts, pair_counts(texts), small), "tid", "left")
    told = written(told, "measures")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tid(F.nullif(F.col("text").cast("string"), F.lit(""))).alias("tid"))
    slim = written(slim, "texts-of")
    found = met(slim.filter("tid is not null"), told, "tid", "copies", HOT_SHARE)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = found.select("doc_id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], "groups_sha256")
    none = slim.filter("tid is null").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in out.columns[1:-1]], F.lit("").alias("groups_sha256"))
    return out.unionByName(none)

"""Removal of repeated byte strings, from intervals of a Burrows-Wheeler transform.

A string of ``least`` bytes that occurs twice holds the same anchor in both places: the
run of ``GRAM`` bytes with the least hash in it. So texts need not be brought together
whole. Anchors with a hash of their surroundings (the bytes that any string holding the
anchor can reach) are dealt out by the anchor's hash; equal surroundings fold into one class,
of which all but the first place are repeats; where an anchor has unlike surroundings, one copy of
each goes into a text of about a megabyte, in whose transform intervals of suffixes that
share ``least`` bytes are found. Strings that hold an anchor reach half of what they can to its left or to its
right, so surroundings are dealt by what they have on one side: those that share neither side with any other can't
hold a repeat and are left out. A side with more unlike surroundings than such a text
holds is cut by the strings of ``least`` bytes around it instead, each dealt by its own hash,
so no anchor gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import written

GRAM = 32
#: Bytes of text that are hashed at a time; a longer text is taken in pieces.
PIECE = 1 << 20
NULL_ID = -(2**63)
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, powers of the base and of its inverse, modulo 2^64."""
    size = PIECE + 4096
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return np.random.default_rng(11).integers(1, 2**64, 256, np.uint64), *out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def _slide(best, a: np.ndarray, width: int) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    t, w = a, 1
    while 2 * w <= width:
        t, w = best(t[:-w], t[w:]), 2 * w
    return t if w == width else best(t[: len(t) - (width - w)], t[width - w :])


def anchors(buf: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(at, left, right, h, g, gl, gr) of the anchors of texts that stand one behind another in ``buf``.

    ``ends[i]`` is where the text of byte i ends. ``left`` and ``right``: how far strings
    that hold the anchor can reach; ``h`` hashes the anchor, ``g`` all that can be reached, ``gl`` and
    ``gr`` the anchor with the near half of either side, 0 where the text doesn't reach so far.
    """
    width = least - GRAM + 1
    if len(buf) < least:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int32, np.int32))
    values, power, inverse = _tables()
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * power[: len(buf)], out=prefix[1:])
    gram = (prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(buf) - GRAM + 1]
    rank = (_mix(gram) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(np.minimum, rank, width)
    starts = np.arange(len(low))
    low = np.where(starts + least <= ends[: len(low)], low, np.uint32(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint32), low, np.zeros(width - 1, np.uint32)])
    at = np.flatnonzero(_slide(np.maximum, padded, width) == rank)
    end = ends[at]
    first = np.searchsorted(ends, end, "left")  # ends never fall, so a text starts where its end first shows
    left, right = np.minimum(width - 1, at - first), np.minimum(least, end - at)
    reach = (prefix[at + right] - prefix[at - left]) * inverse[at - left]
    half = (least - GRAM) // 2

    def side(ok: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.where(ok, a, at), np.where(ok, b, at)
        return np.where(ok, (_mix((prefix[b] - prefix[a]) * inverse[a]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0)).view(np.int32)

    gl, gr = side(left >= half, at - half, at + GRAM), side(right >= least - half, at, at + least - half)
    return at, left, right, _mix(gram[at]), _mix(_mix(reach) + (left * 65536 + right).astype(np.uint64) * ODD), gl, gr


def _pieces(texts: Iterator[tuple[int, bytes]], margin: int) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Groups of (row, offset, from, to, bytes) of about PIECE bytes: short texts together, long ones cut.

    Anchors from ``from`` to ``to`` of the bytes count; the rest is what they can reach.
    """
    held, size = [], 0
    for row, raw in texts:
        for s in range(0, max(len(raw), 1), PIECE // 2):
            a, b = max(0, s - margin), min(len(raw), s + PIECE // 2 + margin)
            if size + b - a > PIECE and held:
                yield held
                held, size = [], 0
            held.append((row, a, s - a, min(len(raw), s + PIECE // 2) - a, raw[a:b]))
            size += b - a
    if held:
        yield held


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted and joined where they meet or overlap."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.flatnonzero(np.append(new[1:], True))
    return s[new], e[last]


def places(docs: DataFrame, least: int) -> DataFrame:
    """Anchors (span false) and bytes known to be repeats (span true) of every text.

    Rows come in order of doc_id in each task, so of equal surroundings in one task the
    first stays an anchor and the others are spans at once: a passage that stands
    everywhere leaves a task once, whatever the count of its copies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.uint64)
        for b in batches:
            doc, part = b["doc"].to_numpy(), b["part"].to_numpy()
            for group in _pieces(((i, (t or "").encode()) for i, t in enumerate(b["text"])), least):
                size = np.array([len(p[4]) for p in group])
                base = np.cumsum(size) - size
                at, left, right, h, g, gl, gr = anchors(np.frombuffer(b"".join(p[4] for p in group), np.uint8), np.repeat(base + size, size), least)
                k = np.searchsorted(base, at, "right") - 1
                k = np.searchsorted(base, base[k], "right") - 1
                row, off, lo, hi = (np.array([p[c] for p in group])[k] for c in range(4))
                at = at - base[k]
                own = (at >= lo) & (at < hi)
                at, left, right, h, g, gl, gr, row = (v[own] for v in (at + off, left, right, h, g, gl, gr, row))
                if not len(at):
                    continue
                both = _mix(h + g * ODD)
                known, first = np.unique(both, return_index=True)
                spot = np.minimum(np.searchsorted(seen, known), max(len(seen) - 1, 0))
                fresh = seen[spot] != known if len(seen) else np.ones(len(known), bool)
                seen = np.sort(np.concatenate([seen, known[fresh]]))
                keep = np.zeros(len(at), bool)
                keep[first[fresh]] = True
                out = [pd.DataFrame({"h": h[keep].view(np.int64), "g": g[keep].view(np.int64), "doc": doc[row[keep]], "part": part[row[keep]], "at": at[keep], "reach": left[keep] * 65536 + right[keep], "gl": gl[keep], "gr": gr[keep], "span": False})]
                for r in np.unique(row[~keep]):
                    these = ~keep & (row == r) if len(group) < 50 else np.flatnonzero(~keep & (row == r))
                    s, e = merged((at - left)[these], (at + right)[these])
                    spread = _mix(s.astype(np.uint64) * ODD + np.uint64(row[these][0])).view(np.int64)  # spans belong to no anchor: their keys only spread them
                    out.append(pd.DataFrame({"h": spread, "g": s, "doc": doc[r], "part": part[r], "at": s, "reach": e - s, "gl": np.int32(0), "gr": np.int32(0), "span": True}))
                yield pd.concat(out)

    ordered = docs.sortWithinPartitions("doc", "part")
    return ordered.mapInPandas(run, "h long, g long, doc long, part long, at long, reach long, gl int, gr int, span boolean")


def compared(found: DataFrame, least: int) -> DataFrame:
    """(doc, part, s, n, w): spans known to be repeats, with ``w`` empty, and surroundings to compare, each named in ``w``.

    Sorted by surroundings and place within an anchor: whatever follows an equal one is
    a repeat. Of the rest, those go on whose near half on one side is that of another
    too: ``w`` has the side's key, and where the bytes begin and how many there are that strings which reach
    that half can hold.
    """
    of, half = W.partitionBy("h", "span"), (least - GRAM) // 2
    again = F.lag("g").over(of.orderBy("g", "doc", "part", "at")) == F.col("g")
    w = found.withColumns({"again": ~F.col("span") & F.coalesce(again, F.lit(False)), "many": ~F.col("span") & (F.min("g").over(of) != F.max("g").over(of))})
    known = F.col("span") | F.col("again")
    w = w.filter(known | F.col("many"))
    shared = lambda c: ~known & (F.col(c) != 0) & (F.sum((~known).cast("int")).over(W.partitionBy("h", "span", c)) > 1)
    w = w.withColumns({"is_l": shared("gl"), "is_r": shared("gr")}).filter(known | F.col("is_l") | F.col("is_r"))
    left, right = F.floor(F.col("reach") / 65536), F.col("reach") % 65536
    s = F.when(F.col("span"), F.col("at")).otherwise(F.col("at") - left)
    n = F.when(F.col("span"), F.col("reach")).otherwise(left + right)

    def asked(side: int, c: str, before: Column, behind: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(side), "h", c).alias("h"), (F.col("at") - before).cast("long").alias("s"), (before + behind).cast("long").alias("n"))

    sides = F.array_compact(F.array(F.when(F.col("is_l"), asked(0, "gl", left, F.least(right, F.lit(least - half)))), F.when(F.col("is_r"), asked(1, "gr", F.least(left, F.lit(half)), right))))
    return written(w.select("doc", "part", s.cast("long").alias("s"), n.cast("long").alias("n"), sides.alias("w")), "repeats")


def bwt_groups(raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each the number of its group: those that share ``least`` bytes.

    ``raw`` holds bytes plus 1, and 0 behind each text. Intervals of suffixes that share a string
    grow from the empty string by one byte in front at a time, breadth first, so the
    common prefix that ends at an interval's right border is known by the step in which
    the border is first seen. Borders not seen in ``least`` steps lie within a group.
    """
    n = len(raw)
    order, rank = _suffixes(raw)
    before = raw[order - 1]
    to = np.empty(n, np.int64)  # last-to-first: where the suffix one byte longer stands
    to[np.arange(n)] = rank[order - 1]
    by = np.argsort(to)  # places in the transform, in order of (byte, place)
    same = before[by[1:]] == before[by[:-1]]
    after, ahead = np.full(n, n), np.full(n, -1)
    after[by[:-1][same]] = by[1:][same]
    ahead[by[1:][same]] = by[:-1][same]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    lb, rb = np.array([0]), np.array([n - 1])
    for _ in range(least):
        size = rb - lb + 1
        if not len(size):
            break
        k = np.repeat(np.arange(len(size)), size)
        i = np.arange(len(k)) + (lb - np.cumsum(size) + size)[k]
        byte = before[i] > 0
        lows, highs = to[i[byte & (ahead[i] < lb[k])]], to[i[byte & (after[i] > rb[k])]]
        lows.sort()
        highs.sort()
        new = ~border[highs + 1]
        lb, rb = lows[new], highs[new]
        border[rb + 1] = True
    return order, np.cumsum(border[:n]) - 1


def _suffixes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, from keys of seven bytes on; the text goes round.

    A round joins the ranks of three neighbouring stretches to one key, or of two in
    a text whose ranks are too large for three.
    """
    n = len(raw)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key * np.uint64(257) + np.roll(raw, -k).astype(np.uint64)
    width, times = 7, 3 if n < 1 << 21 else 2
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1 or width >= n:
            break
        key = rank
        for k in range(1, times):
            key = key * n + np.roll(rank, -k * width)
        width *= times
    rank[order] = np.arange(n)
    return order, rank


def repeats_in(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Spans (doc, part, s, n) that equal strings of earlier places cover, among the rows' bytes."""
    rows = rows.sort_values(["doc", "part", "s"], kind="stable")
    doc, part, start = (rows[c].to_numpy() for c in ("doc", "part", "s"))
    size = np.array([len(x) for x in rows["raw"]])
    raw = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.uint16) + 1, 0) for x in rows["raw"]]).astype(np.uint16)
    base = np.cumsum(size + 1) - size - 1
    raw = np.append(raw, np.uint16(0))
    order, group = bwt_groups(raw, least)
    seg = np.searchsorted(base, order, "right") - 1
    at = order - base[seg]
    whole = at + least <= size[seg]
    seg, at, group = seg[whole], at[whole], group[whole]
    place = start[seg] + at
    text = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])))[seg]  # rows are in order of place
    by = np.lexsort((place, text, group))
    seg, at, group, place, text = (v[by] for v in (seg, at, group, place, text))
    head = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    gone = (text != text[first]) | (place != place[first])
    text, place, seg = text[gone], place[gone], seg[gone]
    by = np.lexsort((place, text))
    text, place, seg = text[by], place[by], seg[by]
    new = np.append(True, (text[1:] != text[:-1]) | (place[1:] > place[:-1] + least)) if len(text) else np.zeros(0, bool)
    last = np.append(new[1:], True) if len(text) else new
    return pd.DataFrame({"doc": doc[seg[new]], "part": part[seg[new]], "s": place[new], "n": place[last] + least - place[new]})


def windows_of(cut: DataFrame, least: int) -> DataFrame:
    """(w, doc, part, s): every string of ``least`` bytes of the rows, by a hash of 128 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            rows = [(xxhash.xxh3_128_digest(raw[k : k + least]), doc, part, s + k) for doc, part, s, raw in zip(b["doc"], b["part"], b["s"], b["raw"], strict=True) for k in range(len(raw) - least + 1)]
            yield pd.DataFrame(rows, columns=["w", "doc", "part", "s"])

    return cut.select("doc", "part", "s", "raw").mapInPandas(run, "w binary, doc long, part long, s long")


def window_repeats(cut: DataFrame, least: int) -> DataFrame:
    """Spans of the rows' strings of ``least`` bytes that occur at an earlier place too.

    The first place of a string is found by partial sums, then joined back from written
    tables, so that Spark can split a string that is everywhere.
    """
    each = written(windows_of(cut, least), "hot-windows")
    place = F.struct("doc", "part", "s")
    first = written(each.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "hot-firsts")
    later = each.join(first.hint("merge"), "w").filter(place != F.col("first"))
    return later.select("doc", "part", "s", F.lit(least).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, least: int = 100, per_text: int = 6000) -> DataFrame:
    """(doc, part, s, n): spans of bytes to remove; they may overlap."""
    work = compared(places(docs, least), least)
    asked = work.filter(F.size("w") > 0)
    count = asked.agg(F.sum(F.size("w"))).first()[0]
    done = work.filter(F.size("w") == 0).drop("w")
    if not count:
        return done
    hot = written(asked.select(F.explode("w.h").alias("h")).groupBy("h").count().filter(F.col("count") > 2 * per_text).select("h"), "hot-anchors")
    wanted = asked.groupBy("doc", "part").agg(F.flatten(F.collect_list("w")).alias("w"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, part, text, w in zip(b["doc"], b["part"], b["text"], b["w"], strict=True):
                raw = (text or "").encode()
                rows += [(r["h"], doc, part, r["s"], raw[r["s"] : r["s"] + r["n"]]) for r in w]
            yield pd.DataFrame(rows, columns=["h", "doc", "part", "s", "raw"])

    cut = docs.join(wanted, ["doc", "part"]).mapInPandas(fetch, "h long, doc long, part long, s long, raw binary")
    if hot.limit(1).count():
        cut = written(cut, "surroundings")
        done = done.unionByName(window_repeats(cut.join(hot.hint("merge"), "h", "left_semi"), least))
        cut = cut.join(hot.hint("merge"), "h", "left_anti")
    dealt = cut.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(-(-count // per_text))))
    more = dealt.groupBy("b").applyInPandas(lambda rows: repeats_in(rows, least), "doc long, part long, s long, n long")
    return done.unionByName(more)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 100, per_text: int = 6000) -> DataFrame:
    """Every row with n_bytes, spans (start, end of the removed bytes) and kept (binary) added.

    A byte goes if a string of ``least`` bytes that covers it starts earlier too: in a lesser
    doc_id (null first), or before it in the same text. Null text is empty; texts
    shorter than ``least`` stay whole. Texts that share a doc_id are told apart, in order of a hash; rows
    that repeat doc_id and text are one document and end alike. An empty table stays
    empty. Columns named like the added ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text).cast("string").alias("text"))
    alone = not slim.groupBy("doc").count().filter("count > 1").limit(1).count()
    part = F.lit(0).cast("long") if alone else F.xxhash64("text")
    slim = slim.withColumn("part", part)
    once = slim if alone else slim.dropDuplicates(["doc", "part"])
    spans = repeated_spans(once, least, per_text).groupBy("doc", "part").agg(F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))
    rows = docs.select(*[F.col(c).alias(f"_in_{c}") for c in names], F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("part", part).join(spans, ["doc", "part"], "left")

    @F.pandas_udf("struct<n_bytes: long, spans: array<struct<start: long, end: long>>, kept: binary>")
    def cut(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, n in zip(text, starts, sizes, strict=True):
            raw = (t or "").encode()
            if s is None or not len(s):
                out.append((len(raw), [], raw))
                continue
            s, n = np.asarray(s, np.int64), np.asarray(n, np.int64)
            a, e = merged(s, s + n)
            kept = b"".join(raw[x:y] for x, y in zip([0, *e], [*a, len(raw)], strict=True))
            out.append((len(raw), [{"start": int(x), "end": int(y)} for x, y in zip(a, e, strict=True)], kept))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    return rows.withColumn("_cut", cut("text", "s", "n")).select(*[F.col(f"_in_{c}").alias(c) for c in names], "_cut.*")


def document_repeats(docs: DataFrame) -> DataFrame:
    """Digest over ``documents``: bytes, removed bytes and spans, and hash of what is kept."""
    out = remove_repeats(docs.select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

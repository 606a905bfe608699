"""Merkle manifest of a dataset: a tree for each language, and one over their roots.

Only every few levels of the trees are kept. A proof runs down from the root: the
levels missing between two kept ones are made anew for one aligned subtree at a time,
from the kept nodes below, and dropped when its siblings have been told.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import written

#: What a row is made of, in the order in which it is hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels from one kept level to the next: a subtree between them has up to 64 nodes at its foot.
STRIDE = 6

#: Begin of a step of a proof: the other node stands to the left, to the right, or isn't there.
LEFT, RIGHT, NONE = "<", ">", "="


class Manifest(NamedTuple):
    """``leaves`` (grp, pos, leaf and the row's own columns), ``groups`` (lang, grp, n),
    the kept ``levels`` of the trees of languages and of the ``top`` tree over them."""

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]


def told(value: Column) -> Column:
    """A value as it is hashed: its bytes behind their count, or ``-`` for null."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[told(fields[f]) for f in FIELDS]), 256)


def climb(digests: list[str], steps: int) -> list[list[str]]:
    """The nodes of ``steps`` levels above ``digests``, theirs first; a node without a neighbour is hashed alone."""
    out = [digests]
    for _ in range(steps):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[k : k + 2]).encode()).hexdigest() for k in range(0, len(low), 2)])
    return out


def steps_of(levels: list[list[str]], k: int) -> list[str]:
    """What stands beside the ancestors of the ``k``-th node, from its own level up."""
    out = []
    for level in levels[:-1]:
        beside = k ^ 1
        out.append((LEFT if beside < k else RIGHT) + level[beside] if beside < len(level) else NONE)
        k >>= 1
    return out


def numbered(df: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its group by ``order``, from 0.

    Rows are sorted by range and written; the places at which groups begin in each
    range are summed up, a row for each range and group. So a group of any size is
    spread, and rows that are equal in ``order`` too, as their numbers break ties.
    """
    key = [group] if group else []
    rows = written(df.withColumn("m_row", F.monotonically_increasing_id()), f"{name}-rows").orderBy(*key, *order, "m_row")
    rows = written(rows.withColumn("m_part", F.spark_partition_id()).withColumn("m_at", F.monotonically_increasing_id()), f"{name}-sorted")
    spans = rows.groupBy(*key, "m_part").agg(F.min("m_at").alias("m_first"), F.count(F.lit(1)).alias("m_n"))
    before = W.partitionBy(*key or [F.lit(0)]).orderBy("m_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("m_before", F.coalesce(F.sum("m_n").over(before), F.lit(0)))
    spans = spans.select(*[F.col(k).alias(f"m_{k}") for k in key], F.col("m_part").alias("m_of"), "m_first", "m_before")
    on = F.col("m_part") == F.col("m_of")
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
    return rows.join(spans, on).withColumn("pos", F.col("m_before") + F.col("m_at") - F.col("m_first")).select(*df.columns, "pos")


def height_of(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def kept_levels(leaves: DataFrame, name: str, stride: int = STRIDE) -> list[DataFrame]:
    """(grp, height, pos, digest) of the leaves and of every ``stride``-th level above them, up to the roots.

    A tree that ends between two of these levels has its root in the upper one. A group of the
    grouping is an aligned subtree of at most 2 ** ``stride`` nodes, however large a tree is.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        grp, height, pos = (rows[c][0].as_py() for c in ("grp", "height", "pos"))
        root = climb(rows["digest"].to_pylist(), min(stride, height - rows["level"][0].as_py()))[-1]
        return pa.table({"grp": pa.array([grp], pa.int64()), "height": pa.array([height], pa.int32()), "pos": pa.array([pos >> stride], pa.int64()), "digest": root})

    top = leaves.agg(F.max("height")).first()[0] or 0
    levels = [leaves]
    for low in range(0, top, stride):
        up = levels[-1].filter(F.col("height") > low).withColumn("level", F.lit(low))
        made = up.groupBy("grp", F.shiftright("pos", stride).alias("block")).applyInArrow(run, "grp long, height int, pos long, digest string")
        levels.append(written(made, f"{name}-{low + stride}"))
    return levels


def roots(levels: list[DataFrame], stride: int = STRIDE) -> DataFrame:
    """(grp, digest) of each tree's root."""
    ends = [d.filter(f"height > {(k - 1) * stride} and height <= {k * stride}") for k, d in enumerate(levels)]
    out = ends[0].filter("height = 0").select("grp", "digest")
    for d in ends[1:]:
        out = out.unionByName(d.select("grp", "digest"))
    return out


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None, stride: int = STRIDE) -> Manifest:
    """The kept levels of the trees over ``docs``; ``keep`` names what the leaves carry along.

    Leaves ascend by doc_id, null first; rows that repeat a doc_id follow by their digests,
    and rows that are equal in all are leaves of their own. Null values are hashed as
    ``-``; an empty text isn't null. A text of any length is hashed where it is read
    and travels no further. Other columns are left behind, whatever their names.
    """
    own = {f: F.col(f) for f in FIELDS}
    slim = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(own).alias("leaf"), *[c.alias(n) for n, c in (keep or {}).items()])
    leaves = numbered(slim, "lang", ["doc_id", "leaf"], "leaves")
    counts = written(leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    groups = written(numbered(counts, None, ["lang"], "langs").withColumnRenamed("pos", "grp"), "groups")
    of = groups.select(F.col("lang").alias("m_lang"), "grp", height_of(F.col("n")).alias("height"))
    leaves = written(leaves.join(of, F.col("lang").eqNullSafe(F.col("m_lang"))).drop("m_lang"), "numbered")
    levels = kept_levels(leaves.select("grp", "height", "pos", F.col("leaf").alias("digest")), "level", stride)
    over = roots(levels, stride).select(F.lit(0).cast("long").alias("grp"), height_of(F.lit(groups.count()).cast("long")).alias("height"), F.col("grp").alias("pos"), "digest")
    return Manifest(leaves, groups, levels, kept_levels(written(over, "subroots"), "top", stride))


def _handed_down(low: int, stride: int, mine: list[str], extra: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Proofs of the nodes at the foot of one aligned subtree, from that of its top node."""
    out = [c for c in mine if c not in ("digest", "height")]

    def run(nodes: pa.Table, tops: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        made = climb(nodes["digest"].to_pylist(), min(stride, nodes["height"][0].as_py() - low))
        up = tops["up"][0].as_py()
        proof = pa.array([steps_of(made, k) + up for k in range(nodes.num_rows)], pa.list_(pa.string()))
        same = pa.array(np.zeros(nodes.num_rows, np.int64))
        return pa.table({c: nodes[c] for c in out} | {c: tops[c].take(same) for c in extra} | {"proof": proof})

    return run


def descend(levels: list[DataFrame], above: DataFrame, carry: list[str], name: str, stride: int = STRIDE) -> DataFrame:
    """The leaves of ``levels`` (first item, with the columns ``carry``) and their ``proof``.

    ``above`` has (grp, up, ...) for each tree, ``up`` being the proof of its root and other
    columns being handed down. Kept levels are taken from the top: an aligned subtree
    meets the proof of its own top node alone, whatever the size of its tree.
    """
    extra = [c for c in above.columns if c not in ("grp", "up")]
    parents, kinds = None, dict(above.dtypes)
    for k in range(len(levels) - 1, -1, -1):
        low, mine = k * stride, ["grp", "pos", "height", "digest", *(carry if k == 0 else [])]
        ends = levels[k].filter("height = 0" if k == 0 else f"height > {low - stride} and height <= {low}").select("grp", "pos")
        ended = ends.join(above, "grp").select("grp", "pos", "up", *extra)
        here = levels[k].filter(f"height > {low}").select(*mine)
        shape = ", ".join(f"{c} {t}" for c, t in here.dtypes if c not in ("digest", "height"))
        shape += "".join(f", {c} {kinds[c]}" for c in extra) + ", proof array<string>"

        made = ended.withColumnRenamed("up", "proof")
        if k == 0 and carry:
            made = made.join(levels[0].select("grp", "pos", *carry), ["grp", "pos"])
        if parents is not None:
            below = here.groupBy("grp", F.shiftright("pos", stride).alias("block")).cogroup(parents.groupBy("grp", F.col("pos").alias("block"))).applyInArrow(_handed_down(low, stride, mine, extra), shape)
            made = made.select(*below.columns).unionByName(below)
        if k == 0:
            return made
        parents = written(made.withColumnRenamed("proof", "up"), f"{name}-{low}")
    return made


def proofs(m: Manifest, carry: list[str], stride: int = STRIDE) -> DataFrame:
    """(grp, pos, the columns ``carry`` of the leaves, subroot, root, proof): every leaf's way to the root.

    A step of a proof is the digest beside the way behind ``<`` if that stands to the left and
    ``>`` if to the right, or ``=`` where there is none.
    """
    root = roots(m.top, stride).select("grp", F.lit(None).cast("array<string>").alias("none"), F.col("digest").alias("root"))
    above = root.select("grp", F.coalesce("none", F.array().cast("array<string>")).alias("up"), "root")
    langs = [m.top[0].withColumn("subroot", F.col("digest")), *m.top[1:]]
    tops = written(descend(langs, above, ["subroot"], "top-proof", stride), "subroot-proofs")
    over = tops.select(F.col("pos").alias("grp"), F.col("proof").alias("up"), "subroot", "root")
    leaves = m.leaves.select("grp", "height", "pos", F.col("leaf").alias("digest"), *carry)
    return descend([leaves, *m.levels[1:]], over, carry, "proof", stride)


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and a proof lead to."""
    def step(at: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith(LEFT), F.concat(other, at)).otherwise(F.concat(at, other)), 256)

    return F.aggregate(proof, leaf, step)


def document_proofs(docs: DataFrame, tampers: Callable[[Column], Column] | None = None, stride: int = STRIDE) -> DataFrame:
    """Digest of the manifest of ``documents``: every leaf, its proof and whether it holds.

    Rows whose crc32 of the decimal doc_id is divisible by 7 are tested with one character more
    than they were filed with (null counts stay null; rows without doc_id aren't touched).
    """
    mark = tampers(F.col("doc_id")) if tampers else F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n = F.col("n_chars").cast("long")
    odd = leaf_of({f: F.col(f) for f in FIELDS} | {"n_chars": n + 1})
    m = manifest(docs, {"altered": F.when(F.coalesce(mark, F.lit(False)), odd)}, stride)
    told_of = proofs(m, ["doc_id", "leaf", "altered"], stride)
    siblings = F.concat_ws("", F.transform("proof", lambda s: F.substring(s, 2, 64)))
    found = told_of.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Sharding by a hierarchical weighted hash tree (regions, racks, shards)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import hex_draw, written


@dataclass(frozen=True)
class Tree:
    """Shards numbered from 0 fill racks, and racks fill regions, in order.

    ``weights[s]`` is the capacity of shard ``s``; a rack and a region weigh what
    their shards do. The first ``built`` shards (all if none is given) stand so; each
    shard added later opens a region and a rack of its own, so the draws within
    every other region stay as they were, and only the new shard takes rows. A tree
    that grows keeps its ``built``.
    """

    weights: Sequence[float]
    rack_size: int = 4
    region_size: int = 8
    built: int | None = None

    def _group(self, s: int, size: int) -> int:
        built = len(self.weights) if self.built is None else self.built
        return s // size if s < built else -(-built // size) + s - built

    def region(self, s: int) -> int:
        return self._group(s, self.region_size)

    def rack(self, s: int) -> int:
        return self._group(s, self.rack_size)

    def children(self, level: int, parent: int | None) -> dict[int, float]:
        """Weights of the nodes below ``parent``: regions (0), racks (1), shards (2)."""
        of = (self.region, self.rack, lambda s: s)
        out: dict[int, float] = {}
        for s, w in enumerate(self.weights):
            if level == 0 or of[level - 1](s) == parent:
                out[of[level](s)] = out.get(of[level](s), 0.0) + w
        return out


def equal_tree(shards: int, built: int | None = None, **sizes: int) -> Tree:
    return Tree([1.0] * shards, built=built, **sizes)


def _draw(key: Column, level: int, below: list[dict[int, float]], parent: Column) -> Column:
    """Child with the least exponential draw, -ln(u) / weight: chosen in proportion to weight.

    ``below[p]`` has the children of parent ``p``. A draw depends on the key and the
    child alone, so a changed weight moves rows only to or from that child.
    """
    nodes = [F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("w")) for n, w in kids.items() if w > 0]) for kids in below]
    children = F.element_at(F.array(*nodes), parent + 1)

    def draw(c: Column) -> Column:
        u = F.conv(F.substring(hex_draw(key, f"{level}", c["n"]), 1, 12), 16, 10).cast("double")
        return F.struct((-F.log((u + 0.5) / F.lit(float(2**48))) / c["w"]).alias("d"), c["n"].alias("n"))

    return F.array_min(F.transform(children, draw))["n"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a key: descends region, rack and shard level, one weighted draw each."""
    regions = tree.children(0, None)
    racks = [tree.children(1, r) for r in range(max(regions) + 1)]
    shards = [tree.children(2, k) for k in range(max(max(x) for x in racks) + 1)]
    region = _draw(key, 0, [regions], F.lit(0))
    return _draw(key, 2, shards, _draw(key, 1, racks, region)).cast("int")


def assign_shards(df: DataFrame, key: str, tree: Tree, grown: Tree | None = None, prefix: str = "") -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 in the shard) and ``grown_shard``.

    Law ``key``: the key and the tree decide alone. Null keys share one fixed place;
    rows that repeat a key share its shard and take slots of their own. Columns of
    the same names are replaced; an empty table stays empty.

    Slots don't gather a shard, or a key that repeats or is null, in one task: rows are dealt
    by ranges of shard, hash of the key and their other columns down to a row number, so even
    like rows part; rows are numbered within a range, and the counts of the ranges before it are added.
    """
    order, row, part, base = f"{prefix}_order", f"{prefix}_row", f"{prefix}_part", f"{prefix}_base"
    df = df.drop("shard", "slot", "grown_shard", order, row, part, base)
    rest = sorted(c for c, t in df.dtypes if c != key and not t.startswith(("map", "variant", "void")))
    df = df.withColumns(
        {
            "shard": shard_of(F.col(key), tree),
            "grown_shard": shard_of(F.col(key), grown) if grown else F.lit(None).cast("int"),
            order: hex_draw(F.col(key), "slot"),
            row: F.monotonically_increasing_id(),
        }
    )
    inner = [order, key, *rest, row]
    df = written(df.repartitionByRange("shard", *inner).withColumn(part, F.spark_partition_id()), "shards")
    counts = df.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("shard", part, (F.sum("_n").over(W.partitionBy("shard").orderBy(part)) - F.col("_n")).alias(base))
    within = F.row_number().over(W.partitionBy("shard", part).orderBy(*inner)) - 1
    return df.withColumn("slot", within).join(counts, ["shard", part]).withColumn("slot", (F.col("slot") + F.col(base)).cast("long")).drop(order, row, part, base)


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Digest of the placement of ``documents``: one row for each, nothing left out."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.select("doc_id", (F.col("_bytes") + 16).alias("size"), "text_crc32")
    out = assign_shards(rows, "doc_id", equal_tree(shards), equal_tree(shards + 1, built=shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

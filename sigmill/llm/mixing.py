"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import aside, hex_draw, word_count, written

#: Rows up to which the table of sources may be sent to every executor.
BROADCAST_ROWS = 50_000


def source_targets(sizes: DataFrame, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """Water-filling over one row (source, source_size) for each source.

    Sources in code point order, null last, weigh ``cycle`` in turn and share
    ``share`` times all sizes. A source fills at most ``epochs`` times its size; what
    runs over goes to the others by weight until none is above. Sources that fill
    first stand first when sorted by limit per weight, so the level at which filling
    ends is found by running sums: a source is full if its limit is below the level
    that those after it would share. Sums are over sources, never over documents.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    by_limit = W.orderBy("_per", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), ((F.row_number().over(place) - 1) % len(cycle) + 1).cast("int")))
    s = s.withColumns({"_cap": F.col("source_size") * F.lit(float(epochs)), "_pool": F.sum("source_size").over(everything) * F.lit(float(share)), "_all": F.sum("_w").over(everything)})
    s = s.withColumn("_per", F.col("_cap") / F.col("_w"))
    s = s.withColumns({"_caps": F.sum("_cap").over(by_limit) - F.col("_cap"), "_before": F.sum("_w").over(by_limit) - F.col("_w")})
    s = s.withColumn("_level", (F.col("_pool") - F.col("_caps")) / (F.col("_all") - F.col("_before")))
    s = s.withColumn("_full", F.col("_per") <= F.col("_level"))
    s = s.withColumn("_end", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_end") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", seed: int = 42, **law) -> DataFrame:
    """Adds source_size, target and repeats (times the mix takes the whole document).

    Each source takes whole repetitions of all its documents and, for the fraction
    that is left, documents in seeded order until the target is met; the one on the
    border is taken if more than half of it fits, so a source misses its target by
    half a document at most. Null sizes count as 0; null sources are a source. Rows
    that repeat a key are rows of their own: of those with the border's key and size as
    many are taken as fit, whichever come first by a hash of all their columns. An empty
    table stays empty. Columns named like the added ones are replaced.

    The seeded order isn't sorted as a whole: sizes are summed by source and leading
    digits of the draw first, and only the one cut that holds the border is looked at
    closer, by draw and size with a count, so no source and no repeated key gathers
    in one task. The table of sources is sent to every executor up to ``BROADCAST_ROWS``
    rows and joined by shuffle beyond that; rows and results are the same.
    """
    docs, (size, source, key), back = aside(docs.drop("source_size", "target", "repeats"), size, source, key)
    slim = docs.select(F.col(source).alias("source"), _size(size), F.col(key).alias("_k")).withColumn("_h", hex_draw(f"{seed}", F.col("_k")))
    cuts = written(slim.groupBy("source", F.substring("_h", 1, 3).alias("_cut")).agg(F.sum("_n").alias("_n")), "mix-cuts")
    goals = source_targets(cuts.groupBy("source").agg(F.sum("_n").alias("source_size")), **law)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goals = goals.withColumn("_whole", whole).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    goals = written(goals, "mix-goals")
    few = goals.count() <= BROADCAST_ROWS
    to_all = F.broadcast if few else (lambda t: t)

    run = F.sum("_n").over(W.partitionBy("source").orderBy("_cut").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = cuts.withColumn("_upto", run).join(to_all(goals.select(F.col("source").alias("_s"), "_need")), F.col("source").eqNullSafe(F.col("_s")))
    edge = edge.filter((F.col("_need") > F.col("_upto") - F.col("_n")) & (F.col("_need") <= F.col("_upto")))
    edge = edge.select("_s", "_cut", (F.col("_upto") - F.col("_n")).alias("_below"), "_need")

    inside = slim.join(to_all(edge), F.col("source").eqNullSafe(F.col("_s")) & (F.substring("_h", 1, 3) == F.col("_cut")))
    last = _last_taken(inside)
    edge = edge.join(last.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_cut", "_last")
    plan = goals.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_cut", "_last")
    plan = written(plan, "mix-plan")

    names = docs.columns
    found = docs.withColumns({"_h": hex_draw(f"{seed}", F.col(key)), "_n": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    found = found.join(to_all(plan), F.col(source).eqNullSafe(F.col("_source")), "left")
    first, place = F.substring("_h", 1, 3), F.struct("_h", "_n")
    last = F.struct(F.col("_last._h").alias("_h"), F.col("_last._n").alias("_n"))
    split = F.coalesce((place == last) & (F.col("_last.take") < F.col("_last.copies")), F.lit(False))
    extra = (first < F.col("_cut")) | ((first == F.col("_cut")) & (place <= last))
    told = (*names, "source_size", "target")
    if not plan.filter("_last.take < _last.copies").limit(1).count():
        return found.select(*told, _times(extra).alias("repeats")).select(*back, "source_size", "target", "repeats")
    both = found.filter(~split).select(*told, _times(extra).alias("repeats")).unionByName(_some_copies(found.filter(split), names, told))
    return both.select(*back, "source_size", "target", "repeats")


def _size(size: str) -> Column:
    return F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n")


def _times(extra: Column) -> Column:
    return F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("int")


def _last_taken(inside: DataFrame) -> DataFrame:
    """(_s, _last): the last draw and size that a source takes from its border cut, how many of its copies and of how many."""
    groups = inside.groupBy("_s", "_h", "_n").agg(F.count(F.lit(1)).alias("copies"), F.first("_below").alias("_below"), F.first("_need").alias("_need"))
    order = W.partitionBy("_s").orderBy("_h", "_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    groups = groups.withColumn("_before", F.col("_below") + F.sum(F.col("_n") * F.col("copies")).over(order) - F.col("_n") * F.col("copies"))
    # copy j is taken if the middle of it, before + j n - n / 2, lies within the need
    fits = F.floor((F.col("_need") - F.col("_before")) / F.col("_n") + 0.5)
    fits = F.when(F.col("_before") + fits * F.col("_n") - F.col("_n") / 2 <= F.col("_need"), fits).otherwise(fits - 1)
    take = F.when(F.col("_n") > 0, F.greatest(F.lit(0), F.least(fits, F.col("copies")))).otherwise(F.when(F.col("_before") <= F.col("_need"), F.col("copies")).otherwise(0))
    groups = groups.withColumn("take", take.cast("long")).filter("take > 0")
    return groups.groupBy("_s").agg(F.max(F.struct("_h", "_n", "take", "copies")).alias("_last"))


def _some_copies(rows: DataFrame, names: Sequence[str], told: Sequence[str]) -> DataFrame:
    """The rows on a border that not all fit, with their repeats: the first of them by a hash of their columns.

    Rows are written with the number of their task and counted by leading digits of the
    hash and by task, so that numbering never gathers them, alike or not.
    """
    plain = [F.col(c) for c, t in rows.dtypes if c in names and not t.startswith(("map", "variant", "void"))]
    rows = rows.withColumn("_c", F.xxhash64(*plain) if plain else F.lit(0).cast("long"))
    rows = written(rows.withColumns({"_cp": F.pmod("_c", F.lit(4096)), "_part": F.spark_partition_id()}), "mix-border")
    by = ["_source", "_cp", "_part"]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy("_source").orderBy("_cp", "_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_rows")
    counts = counts.select(*[F.col(c).alias(f"_of{c}") for c in by], before.alias("_from"))
    same = F.col("_source").eqNullSafe(F.col("_of_source")) & (F.col("_cp") == F.col("_of_cp")) & (F.col("_part") == F.col("_of_part"))
    place = F.row_number().over(W.partitionBy(*by).orderBy("_c"))
    return rows.withColumn("_at", place).join(counts, same).select(*told, _times(F.col("_from") + F.col("_at") <= F.col("_last.take")).alias("repeats"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    return mixed.filter("repeats > 0").withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select(*columns)


def mixture(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **law) -> DataFrame:
    """The mix of whole documents by their words, each as often as it is taken, with the columns as they came, whatever their names."""
    docs, (text, source, key), back = aside(docs, text, source, key)
    taken = repeated(mix(docs.withColumn("_size", word_count(F.col(text))), "_size", source, key, **law), docs.columns)
    return taken.select(*back)


def document_mix(docs: DataFrame) -> DataFrame:
    """Digest of the mix of ``documents``; every row stays, taken or not."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))

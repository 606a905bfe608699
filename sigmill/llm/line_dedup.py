"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import SPACES, aside, written

WIDTH = 3


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _worded(lines: Column) -> Column:
    """(line, its number) of the lines that have a word; others are never compared."""
    numbered = F.transform(lines, lambda x, j: F.struct(x.alias("x"), j.alias("j")))
    return F.filter(numbered, lambda s: F.length(F.btrim(s["x"], F.lit(SPACES))) > 0)


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, part, at, lines, h1, h2): every window of consecutive worded lines of a document.

    Only hashes leave the row, two of 64 bits over the three lines; ``at`` is the
    number of the window's first line. ``part`` tells texts that share a doc_id apart.
    """
    held = F.filter(F.array(_worded(_lines(text))), lambda v: F.size(v) >= WIDTH)

    def of(v: Column) -> Column:
        def one(i: Column) -> Column:
            rows = [F.element_at(v, (i + k).cast("int")) for k in range(WIDTH)]
            hashes = [F.xxhash64(F.lit(s), *[r["x"] for r in rows]).alias(f"h{s}") for s in (1, 2)]
            return F.struct(rows[0]["j"].alias("at"), F.array(*[r["j"] for r in rows]).alias("lines"), *hashes)

        return F.transform(F.sequence(F.lit(1), F.size(v) - (WIDTH - 1)), one)

    each = F.explode(F.flatten(F.transform(held, of)))
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("part"), each.alias("w")).select("doc", "part", "w.*")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, part, gone): numbers of the lines that later occurrences of a window cover.

    The first occurrence is that of the least doc_id (null first), then the least place. Windows
    are counted with partial sums and only those found twice are joined back, on a
    hash, from written tables, so that Spark can split a window that is everywhere.
    """
    found = written(windows(docs, key, text), "line-windows")
    place = F.struct(F.col("doc"), F.col("part"), F.col("at"))
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").drop("n"), "line-firsts")
    later = found.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select("doc", "part", F.explode("lines").alias("j")).groupBy("doc", "part").agg(F.sort_array(F.collect_set("j")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows, text without the repeated lines, with n_lines and n_removed added.

    A line goes if a window of three worded lines that covers it occurs earlier in the
    table; lines without a word are never compared and stay. Documents with fewer
    than three worded lines stay whole, null texts stay null. Rows that repeat both
    doc_id and text are one document and end alike. An empty table stays empty.
    Columns named n_lines or n_removed are replaced. The lines to drop are always
    dealt out with the texts, never sent whole to every executor: their count grows
    with the table, and so the plan is the same for every size.
    """
    docs, (key, text), back = aside(docs.drop("n_lines", "n_removed"), key, text)
    gone = written(repeated_lines(docs, key, text), "line-gone")
    both = docs.withColumn("_part", F.xxhash64(text)).join(gone.hint("merge"), F.col(key).eqNullSafe(F.col("doc")) & (F.col("_part") == F.col("part")), "left")
    both = both.withColumn("_lines", _lines(text))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(left, lambda j: F.element_at("_lines", j + 1)), "\n")
    out = {
        text: F.when(F.col("gone").isNull(), F.col(text)).otherwise(rest),
        "n_lines": F.size("_lines").cast("long"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    done = both.select(*[c for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()])
    return done.select(*back, "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Documents with what is left of their texts; those of which no word is left are gone.

    Null and empty texts had no line to lose and stay; columns besides the text stay as they are, whatever their names.
    """
    docs, (key, text), back = aside(docs, "doc_id", "text")
    done = dedup_lines(docs, key, text)
    left = done.filter((F.col("n_removed") == 0) | (F.length(F.btrim(text, F.lit(SPACES))) > 0))
    return left.select(*back)


def document_lines(docs: DataFrame) -> DataFrame:
    """Digest over ``documents``: lines, removed lines and hash of what is left of each."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

"""Quality rules as a short-circuit cascade, ordered by what a sample shows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import SPACE, SPACES, aside, word_count, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    trimmed = F.ltrim(F.rtrim(text, F.lit(SPACES)), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+"))


def add_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Null text has no words. All statistics stay in the row that they belong to:
    nothing is shuffled, whatever a document's length, and they are computed once,
    whatever filters follow.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    keep = [c for c in df.columns if c not in names]
    body = text_of(text)
    df = df.withColumn("_hashes", F.transform(words_of(body), lambda w: F.xxhash64(w)))
    df = df.withColumns({"n_words": F.size("_hashes").cast("long"), "_runs": window_hashes("_hashes")})
    df = df.withColumn("_twice", F.size("_runs") > F.size(F.array_distinct("_runs")))
    df = df.select(
        *keep,
        "n_words",
        F.length(F.regexp_replace(body, rf"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        symbol_count(body).alias("n_symbols"),
        dup_lines(body).alias("n_dup_lines"),
        F.when(F.col("_twice"), covered_words("_runs")).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return once(df)


def once(df: DataFrame) -> DataFrame:
    """``df`` with its last columns computed once: filters on them aren't moved below, where they would be repeated.

    A filter on a row number can't be pushed down, and filters that follow stay with it.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0").drop("_row")


def symbol_count(body: Column) -> Column:
    return F.length(F.regexp_replace(body, r"[^#*$%&|<>]++", "")).cast("long")


def dup_lines(body: Column) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(hashes: Column | str, width: int = 8) -> Column:
    """One hash for each window of ``width`` words, from the words' hashes, read by place."""
    last = F.size(hashes) - width
    one = lambda i: F.xxhash64(*[F.get(hashes, i + k if k else i) for k in range(width)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def covered_words(runs: Column | str, width: int = 8) -> Column:
    """Words that lie in a window whose content occurs twice or more in the text.

    Windows sorted by content and place: equal neighbours repeat; the places of those,
    sorted, each cover ``width`` words or as many as lie before the next such place.
    """
    placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(placed, lambda s: s["h"]))
    after = F.concat(F.slice(F.transform(placed, lambda s: s["h"]), F.lit(2), F.size(runs)), F.array(F.lit(None).cast("bigint")))
    rows = F.arrays_zip(placed.alias("p"), before.alias("b"), after.alias("a"))
    again = F.filter(rows, lambda r: F.coalesce(r["p"]["h"] == r["b"], F.lit(False)) | F.coalesce(r["p"]["h"] == r["a"], F.lit(False)))
    at = F.sort_array(F.transform(again, lambda r: r["p"]["i"]))
    # (covered so far, place up to which words are covered)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + i + width - F.greatest(s["end"], i)).alias("n"), (i + width).alias("end")), lambda s: s["n"])


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where the rule rejects a document, over the text or columns that are there.

    ``work`` is the count of elementary steps that the rule takes for a row; ``steps`` are
    columns that it needs first.
    """

    name: str
    fails: Column
    work: Column
    steps: tuple[dict[str, Column], ...] = ()


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _base_rule() -> Column:
    return F.when(F.col("n_words") < 20, F.lit("few_words")).when(100 * F.col("n_repeat_words") > 30 * F.col("n_words"), F.lit("repeated_words"))


def _text_rules(body: Column, n: Column) -> list[Rule]:
    """Rules over the text itself, each a pass or two with one pattern; a match is a word or a line."""
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    size = F.length(body).cast("long")
    lines = count(rf"[^\n]*?[^{SPACE}][^\n]*+")
    return [
        Rule("letters", 5 * count(rf"[^\p{{L}}{SPACE}]*+\p{{L}}[^{SPACE}]*+") < 2 * n, 2 * size),
        Rule("bullets", (lines >= 3) & (10 * count(rf"(?md)^[{SPACE}]*[-*•‣]") > 9 * lines), 3 * size),
        Rule("ellipses", (lines >= 3) & (10 * count(rf"(?md)(?:\.\.\.|…)[{SPACE}]*$") > 3 * lines), 3 * size),
    ]


def further_rules(text: str = "text") -> list[Rule]:
    """Rules beside the base ones; all are whole number comparisons, so every engine agrees.

    The first three read base statistics. The others read the text, each in passes of its
    own, which rows that an earlier rule rejects are spared.
    """
    n, chars, body = F.col("n_words"), F.col("word_chars"), text_of(text)
    one = F.lit(1).cast("long")
    return [
        Rule("symbols", 5 * F.col("n_symbols") > n, one),
        Rule("dup_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 20 > n), one),
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n), one),
        *_text_rules(body, n),
    ]


def lean_rules(text: str = "text") -> list[Rule]:
    """All rules over the text itself, each with nothing but what it needs."""
    body = text_of(text)
    n, size = word_count(body), F.length(body).cast("long")
    steps = (
        {"_rule_hashes": F.transform(words_of(body), lambda w: F.xxhash64(w))},
        {"_rule_runs": window_hashes("_rule_hashes")},
        # the row number keeps Spark from moving the filter below the steps, which would hash the words once for each mention
        {"_rule_twice": F.size("_rule_runs") > F.size(F.array_distinct("_rule_runs")), "_rule_row": F.monotonically_increasing_id()},
    )
    repeats = F.when(F.col("_rule_twice"), covered_words("_rule_runs")).otherwise(0)
    chars = F.length(F.regexp_replace(body, rf"[{SPACE}]+", ""))
    return [
        Rule("few_words", n < 20, 2 * size),
        Rule("repeated_words", (100 * repeats > 30 * n) & (F.col("_rule_row") >= 0), 30 * size, steps),
        Rule("symbols", 5 * symbol_count(body) > n, 3 * size),
        Rule("dup_lines", (dup_lines(body) >= 3) & (dup_lines(body) * 20 > n), 4 * size),
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n), 3 * size),
        *_text_rules(body, n),
    ]


def stepped(df: DataFrame, steps: Sequence[dict[str, Column]]) -> DataFrame:
    for columns in steps:
        df = df.withColumns(columns)
    return df


def sampled(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all of a small table), chosen by a seeded hash of the text, written."""
    every = max(1, docs.count() // rows)
    return written(docs.filter(F.pmod(F.xxhash64(F.lit(17), F.col(text)), F.lit(every)) == 0), "rule-sample")


def ordered(rules: Sequence[Rule], sample: DataFrame) -> list[Rule]:
    """Rules by rejection per cost, highest first, as ``sample`` shows them.

    Cost is the work that a rule says it takes, added up; selectivity the rows that it
    rejects; both come from one job, and the same table always gives the same order.
    The order changes the work, never the verdict.
    """
    for r in rules:
        sample = stepped(sample, r.steps)
    sums = [x for k, r in enumerate(rules) for x in (F.sum(F.coalesce(r.fails, F.lit(False)).cast("long")).alias(f"hit{k}"), F.sum(r.work).alias(f"work{k}"))]
    got = sample.agg(*sums).first()
    worth = {r.name: (got[f"hit{k}"] or 0) / max(got[f"work{k}"] or 0, 1) for k, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.fails, F.lit(r.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Adds the base statistics, base_failed, kept and failed_rule to every row.

    The base statistics are due for every row. The verdict is the cascade's: rows that fail a
    base rule end there; the others meet the further rules in the order that the sample
    gives, until one rejects, which ``failed_rule`` names. Null and empty texts have no
    words and fail; repeated rows get equal verdicts; an empty table stays empty. Columns
    named like the added ones are replaced.
    """
    found = add_statistics(docs.drop("base_failed", "kept", "failed_rule"), text)
    rules = ordered(further_rules(text), add_statistics(sampled(docs.select(text), text, sample_rows), text))
    found = found.withColumn("base_failed", base_failed())
    found = once(found.withColumn("failed_rule", F.when(F.col("base_failed"), _base_rule()).otherwise(cascade(rules))))
    return found.withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Only the rows that no rule rejects, with the columns as they came.

    Each rule is a filter of its own over the text, in the sample's order, so that
    documents which a cheap rule rejects never reach a dear one. Columns besides the
    text stay as they are, whatever their names.
    """
    docs, (text,), back = aside(docs, text)
    names = docs.columns
    for r in ordered(lean_rules(text), sampled(docs.select(text), text, sample_rows)):
        docs = stepped(docs, r.steps).filter(~r.fails).select(*names)
    return docs.select(*back)


def document_rules(docs: DataFrame) -> DataFrame:
    """Digest of the cascade over ``documents``: a row for each."""
    return apply_rules(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

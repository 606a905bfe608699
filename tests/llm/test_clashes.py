"""Tables whose columns bear the names that the operators use inside, and licence texts of long runs."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sigmill.llm import licenses, line_dedup, mixing, quality_rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LINES = "\n".join(f"line {k} of a page that says a little about itself" for k in range(5))
PROSE = [" ".join(f"{w}{k}" for w in ("apple", "stone", "river", "cloud", "paper", "green") for k in range(j, j + 6)) for j in range(12)]
ROWS = [(k, f"{t}.\n{LINES}" if t and k % 3 else t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate([*PROSE, PROSE[0], None, ""])]
ADDED = {"n_lines", "n_removed", "sentence_ids", "licenses", "source_size", "target", "repeats"}
#: Every word in quotes in the subpackage.
NAMES = sorted({n for p in Path(quality_rules.__file__).parent.glob("*.py") for n in re.findall(r'"(_?[a-z][a-z_0-9]*)"', p.read_text())} - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    told = [F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in NAMES]
    return plain, plain.select("*", *told)


def check(plain, clash, kept):
    order = lambda rows: sorted(rows, key=repr)
    rows = clash.collect()
    assert order(tuple(r[c] for c in plain.columns) for r in rows) == order(map(tuple, plain.collect()))
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in kept)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_leave_other_columns(spark, tables, name):
    stage = dict(P.STAGES)[name]
    plain, clash = (stage(spark, t, "") for t in tables)
    if name == "packing":
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, clash.select(*plain.columns).collect()))
    else:
        assert clash.columns == tables[1].columns
        check(plain, clash, NAMES)


OPERATORS = {
    "lines": line_dedup.dedup_lines,
    "copies": simhash.keep_one,
    "mix": lambda d: mixing.mix(d, size="n_chars"),
    "rules": quality_rules.keep_good,
    "licences": licenses.scan,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_leave_other_columns(tables, name):
    plain, clash = (OPERATORS[name](t) for t in tables)
    check(plain, clash, [n for n in NAMES if n not in ADDED])


@pytest.mark.parametrize("mark", [".", " ", "-", "*", "(", ")", ". ", "\n", "*/", "-->", ".)", "# ", "\t \r", "licensed ", "spdx-license-identifier "])
def test_long_runs_take_time_in_proportion(mark):
    began = time.perf_counter()
    licenses.sentence_ids("x " + mark * (10**6 // len(mark)) + " y")
    assert time.perf_counter() - began < 20


def test_runs_are_cut_as_by_plain_patterns():
    stop, blank, marks = r"""[.!?;:]+["')\]]*[ \t\r\n]+""", r"\n[ \t\r]*\n[ \t\r\n]*", r"[ \t]*(?:\*+/|--+>)[ \t\r]*$"
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("a.;) \t\n\r*/->\"") for _ in range(rng.randrange(1, 24)))
        assert re.sub(licenses.END_MARKS, "", t, flags=re.M) == re.sub(marks, "", t, flags=re.M)
        assert re.split(licenses.ENDS[0], t) == re.split(f"{stop}|{blank}", t)
        assert re.split(licenses.ENDS[1], t) == re.split(rf"{stop}|[\r\n]+", t)

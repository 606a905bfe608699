"""Licence scan: known sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import aside
from sigmill.llm.license_texts import ALONE, LICENSES, SENTENCES, SEQUENCES

#: Comment marks at the begin and end of a line.
MARKS = r"^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--+)[ \t]*"
#: Runs are taken whole and only from their begin, so that a long one is read once.
END_MARKS = r"(?<![ \t])[ \t]*+(?:(?<!\*)\*++/|(?<!-)--++>)[ \t\r]*+$"
#: A tag keeps its colon from ending a sentence.
TAG = r"spdx-license-identifier[ \t]*:"
#: A sentence ends at . ! ? ; : before white space, or at an empty line; in the second reading at every line's end.
STOP = r"""(?<![.!?;:])[.!?;:]++["')\]]*+[ \t\r\n]++"""
ENDS = (STOP + r"|\n[ \t\r]*+\n[ \t\r\n]*+", STOP + r"|[\r\n]+")
BRACKETS = r"\([^()]*\)"
OTHER = r"[^\p{L}\p{N}]+"
VERBS = "licensed|released|distributed|available|provided|published"
#: A notice, after normalisation: its second part is the licence's name.
NOTICE = rf"(?:th(?:is|e) [a-z]+ (?:is|are) )?(?:made )?(?:{VERBS}) under (?:the terms of )?(?:the |an? )?(.+?)(?: (?:see|for|as|which) .*)?"


def flat(sentence: str) -> str:
    """A sentence in lower case, without brackets, with one space for whatever isn't a letter or digit."""
    return regex.sub(OTHER, " ", re.sub(BRACKETS, " ", sentence.lower())).strip()


@lru_cache(maxsize=1)
def known() -> dict[str, str]:
    """Identifier by normalised sentence: sentences, titles and tags."""
    out = {flat(f"SPDX License Identifier {spdx}"): f"{key}-tag" for key, (spdx, _) in LICENSES.items()}
    out |= {f: f"{key}-title" for key, (_, names) in LICENSES.items() for f in map(flat, names) if re.search("licen[sc]e", f)}
    return out | {flat(s): i for i, told in SENTENCES.items() for s in told}


@lru_cache(maxsize=1)
def names() -> dict[str, str]:
    """Identifier of a notice by normalised name."""
    return {flat(n): f"{key}-notice" for key, (_, told) in LICENSES.items() for n in told}


def alone() -> dict[str, str]:
    """Licence by identifier that makes it on its own."""
    return {f"{key}-{kind}": spdx for key, (spdx, _) in LICENSES.items() for kind in ("tag", "title", "notice")} | ALONE


def _hint() -> str:
    """Pattern that every text with a known sentence matches, in lower case: a few words hold all sentences between them."""
    left, words = set(known()), []
    while left:
        counted: dict[str, int] = {}
        for s in left:
            for w in set(s.split()):
                if len(w) > 4:
                    counted[w] = counted.get(w, 0) + 1
        best = max(counted, key=lambda w: (counted[w], w))
        words.append(best)
        left = {s for s in left if best not in s.split()}
    return "|".join([*words, rf"(?:{VERBS}){OTHER}under"])


def sentence_ids(text: str) -> list[str]:
    """Identifiers of the known sentences, in order.

    Wrapped lines are joined within a paragraph, without comment marks. What only a
    reading line by line shows (a title above a paragraph) stands behind.
    """
    text = re.sub(END_MARKS, "", re.sub(MARKS, "", text, flags=re.M), flags=re.M)
    text = re.sub(TAG, "SPDX-License-Identifier ", text, flags=re.I)
    found: list[list[str]] = []
    for ends in ENDS:
        ids = []
        for part in re.split(ends, text):
            s = flat(part)
            if i := known().get(s):
                ids.append(i)
            elif (m := re.fullmatch(NOTICE, s)) and (i := names().get(m[1])):
                ids.append(i)
        found.append(ids)
    whole = set(found[0])
    return found[0] + [i for i in found[1] if i not in whole]


def licenses_of(ids: list[str]) -> list[str]:
    """Licences (distinct, sorted) of identifiers in order.

    A rule holds if its identifiers occur in their order, others between them or not, and
    takes them; it is tried again behind them. Each rule passes once over the places
    of its own identifiers, so time grows with their number, however often they repeat.
    """
    places: dict[str, list[int]] = {}
    for k, i in enumerate(ids):
        places.setdefault(i, []).append(k)
    taken, found = set(), set()
    for name, need in SEQUENCES:
        if any(i not in places for i in need):
            continue
        picked: list[int] = []
        for k in sorted(k for k in chain(*(places[i] for i in need)) if k not in taken):
            if ids[k] == need[len(picked)]:
                picked.append(k)
                if len(picked) == len(need):
                    taken.update(picked)
                    found.add(name)
                    picked = []
    single = alone()
    return sorted(found | {single[i] for k, i in enumerate(ids) if k not in taken and i in single})


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds sentence_ids (in order) and licenses (distinct, sorted) to every row.

    Each row is scanned on its own: nothing is shuffled, repeated rows come out alike, and
    a text of any length takes time in proportion. Only texts with a word that
    some known sentence must have leave the JVM. Null and empty texts have no
    licences; an empty table stays empty. Columns named like the added ones are replaced.
    """

    @F.pandas_udf("struct<sentence_ids: array<string>, licenses: array<string>>")
    def told(texts: pd.Series) -> pd.DataFrame:
        ids = [sentence_ids(t) if t else [] for t in texts]
        return pd.DataFrame({"sentence_ids": ids, "licenses": [licenses_of(i) if i else [] for i in ids]})

    docs, (text,), back = aside(docs.drop("sentence_ids", "licenses"), text)
    body: Column = F.col(text).cast("string")
    some = F.when(F.lower(body).rlike(_hint()), body)
    return docs.withColumn("_told", told(some)).select(*back, "_told.*")


def document_licenses(docs: DataFrame) -> DataFrame:
    """Digest over ``documents``: sentence identifiers in order, and licences, of each."""
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))

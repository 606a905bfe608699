"""Every match of a pain pattern holds one of its words, and each text is read by a pattern once."""

import re

from sigmill.functions import market as M
from sigmill.registry import queries

SAID = """I wished there was one. if only I could. need  a plan, want to go, looking for some help. anyone knows of a way. recommendations for it's so hard to. we're fed up; this doesn't scale, WON'T WORK. too buggy,
breaking change, pain-point, always crashing. why isn't anyone here. has somebody built it. what's the best tool for me. How should we fix it. any good alternatives to it. existing tools lack it. no decent way for us. missing  offline,
lacks sync, no support for sync. current tools are too old. my followers keep asking. lack of good revenue model. reach tanked. views dropped. sick of it. difficult to do"""


def test_words_are_in_every_match():
    assert len(M.PAIN_WORDS) == len(M.PAIN)
    for (p, _), words in zip(M.PAIN, M.PAIN_WORDS, strict=True):
        found = [m.group(0).lower() for m in re.finditer("(?i)" + p, SAID)]
        assert found and all(any(w in m for w in words) for m in found), p


def test_patterns_read_a_text_once(spark, capsys):
    queries()["f23_pain_phrases_typed"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "RLIKE" not in plan and "regexp_count" not in plan and 0 < plan.count("regexp_extract_all") <= len(M.PAIN)  # a plan is told shortened

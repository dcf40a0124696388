"""Places of matches and joined highlights against Python's re."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillwright import registry
from quillwright.operators.rules import DEFAULT, TABLE_RULES, Rules, highlights
from quillwright.plans.adapters import Tables

FOLDER = "/root/testdata/sf0.001"


def brute(text, rules):
    lists, spans = [], []
    for kind, group in (("staged", rules.staged), ("label", rules.labels), ("veto", rules.vetoes)):
        for name, patterns in group.items():
            for p in patterns:
                found = [m.span() for m in re.finditer(p, text, re.I | re.S)]
                if found:
                    lists.append(f"{kind}:{name}")
                    spans += found
    out = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return lists, out


def test_places(spark):
    rules = Rules(labels={"x": ["ab+", "b c"], "y": ["é.", "never"]}, vetoes={"x": ["^a"]})
    texts = ["", None, "abbb c abé! b cab", "zzz", "AB\nab", "c" * 5000 + "ab" * 50]
    hits, marks = highlights(F.col("t"), rules)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hits.alias("h"), marks.alias("m")).collect():
        lists, spans = brute(r.t or "", rules)
        assert [h.list for h in r.h] == lists and [tuple(x) for x in r.m] == spans


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_query(spark):
    texts = {r.id: f"{r.subject} {r.body}" for r in Tables(spark, FOLDER).messages.collect()}
    rows = registry.queries()["c21_highlights"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lists, spans = brute(texts[r.id], TABLE_RULES)
        assert r.lists == ",".join(lists) and r.places == ",".join(f"{a}-{b}" for a, b in spans) and r.shown == "|".join(texts[r.id][a:b] for a, b in spans)


def test_default_dictionary():
    """The library's own rules know nothing of the test tables; the queries' rules add to them."""
    patterns = [p for g in (DEFAULT.staged, DEFAULT.labels, DEFAULT.vetoes) for x in g.values() for p in x]
    assert len(patterns) > 50 and not any(re.search(r"number|role \d", p) for p in patterns)
    assert all(p in TABLE_RULES.labels["noise"] for p in DEFAULT.labels["noise"])

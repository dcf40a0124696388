"""The company model against the dense formula of complement naive Bayes, on thousands of classes and on odd rows."""

import collections
import math
import random
import re

import pytest

from quillwright.operators.company_model import predict, train


def dense(rows, asked, most):
    pairs, size = collections.Counter(), collections.Counter()
    for c, t in rows:
        if c is not None and t is not None:
            for w in re.findall("[a-z0-9]+", t.lower()):
                pairs[c, w] += 1
    spread = collections.Counter(w for _, w in pairs)
    pairs = {k: n for k, n in pairs.items() if spread[k[1]] <= most}
    terms = collections.Counter()
    for (c, w), n in pairs.items():
        terms[w] += n
        size[c] += n
    out, total = {}, sum(size.values())
    for k, t in asked:
        words = [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w in terms]
        if words:
            scores = {c: sum(-math.log((terms[w] - pairs.get((c, w), 0) + 1) / (total - size[c] + len(terms))) for w in words) for c in size}
            best = max(scores.values())
            out[k] = {c for c, s in scores.items() if s > best - 1e-7}
    return out


@pytest.mark.parametrize("most", [3, 1000])
def test_dense_formula(spark, most):
    rng = random.Random(most)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"c{rng.randint(0, 40)}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for _ in range(200)] + [(None, "w1"), ("c1", None), ("c2", ""), ("c3", "W1, w1!")]
    asked = [(k, t) for k, (_, t) in enumerate(rows)] + [(900, "unknown words"), (901, "w5 unknown")]
    model = train(spark.createDataFrame(rows, "c string, text string"), "c", "text", most_classes=most)
    got = {r.k: r.predicted for r in predict(spark.createDataFrame(asked, "k int, text string"), "k", "text", model).collect()}
    want = dense(rows, asked, most)
    assert set(got) == set(want) and all(got[k] in want[k] for k in got)


def test_thousands_of_classes(spark):
    """5,000 companies, each with words of its own: the plan has no cross join of texts and classes."""
    rows = spark.range(5_000).selectExpr("'c' || id AS c", "'dear user news of firm' || id || ' and role ' || id % 7 AS text", "id AS k")
    model = train(rows, "c", "text")
    found = predict(rows, "k", "text", model)
    assert found.filter("predicted = 'c' || k").count() == 5_000
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_learn_from(spark):
    model = train(spark.createDataFrame([], "c string, text string"), "c", "text")
    assert predict(spark.createDataFrame([(1, "a b")], "k int, text string"), "k", "text", model).collect() == []


def test_a_text_stays_in_its_task(spark):
    """Texts are dealt out by key once: what their terms meet in the vocabulary is not sent again."""
    rows = spark.createDataFrame([(i, f"firm {i % 5}", f"alpha{i % 5} beta gamma{i % 3}") for i in range(60)], "id int, company string, text string")
    model = train(rows, "company", "text")
    out = predict(rows, "id", "text", model)
    assert {r.id: r.predicted for r in out.collect()} == {i: f"firm {i % 5}" for i in range(60)}
    plan = out._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan ==") :]
    assert "hashpartitioning(id" in plan and "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(id#\d+, [ct]#", plan)

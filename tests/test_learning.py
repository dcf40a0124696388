"""Queries without SQL against brute-force versions: training, alias mining, page content."""

import difflib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwright import registry
from quillwright.functions import html
from quillwright.operators import learning, resolve
from quillwright.plans.adapters import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mails(spark):
    rng = random.Random(5)
    words = {"job_application": ["applied", "received", "thanks"], "rejection": ["regret", "unfortunately", "another"], "noise": ["sale", "newsletter", "offer"], "rare": ["odd"]}
    rows = []
    for i in range(400):
        label = rng.choices(list(words), (4, 3, 3, 0.1))[0]
        body = " ".join(rng.choice(words[label] + ["the", "and", "for"]) for _ in range(6))
        rows.append((i, f"Mail {rng.choice(['alpha', 'beta', 'gamma'])}", body, label))
    return spark.createDataFrame(rows, "id bigint, subject string, body string, ml_label string")


def test_split_is_stratified(mails):
    train, test = learning.split(mails, "ml_label")
    both = {r.ml_label: r["count"] for r in mails.groupBy("ml_label").count().collect()}
    held = {r.ml_label: r["count"] for r in test.groupBy("ml_label").count().collect()}
    assert all(abs(held.get(k, 0) - 0.2 * n) <= 1 for k, n in both.items())
    assert not set(r.id for r in train.collect()) & set(r.id for r in test.collect())


def pool_adjacent(x, t):
    """Isotonic regression of t on x, by pooling: (x, value) of distinct x in order."""
    xs = np.unique(x)
    blocks = [[t[x == v].mean(), (x == v).sum(), 1] for v in xs]
    k = 0
    while k + 1 < len(blocks):
        if blocks[k][0] > blocks[k + 1][0] + 1e-15:
            (a, n, c), (b, m, d) = blocks[k], blocks.pop(k + 1)
            blocks[k] = [(a * n + b * m) / (n + m), n + m, c + d]
            k = max(0, k - 1)
        else:
            k += 1
    return xs, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def test_calibrated_probabilities(spark, mails):
    train, test = learning.split(mails, "ml_label")
    model = learning.train(train)
    got = model.probabilities(test).toPandas()
    p = np.stack(got.p)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert "rare" not in model.labels and "other" not in model.labels or (got.ml_label == "rare").sum() < 10
    best = np.array(model.labels)[p.argmax(axis=1)]
    assert (best == got.ml_label).mean() > 0.9
    # the first fold's curve of the first class is the isotonic regression of its held-out part
    given = learning.prepared(train)
    known = model.features.transform(given)
    base, curves = model.folds[0]
    held = base.setProbabilityCol("pr").setRawPredictionCol("ra").setPredictionCol("pd").transform(known.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3)) == 0)).select("pr", "y").toPandas()
    x, t = np.array([v[0] for v in held.pr]), (held.y == 0).to_numpy(float)
    xs, want = pool_adjacent(x, t)
    points = spark.createDataFrame([(float(v),) for v in xs], "z double")
    mine = curves[0].setFeaturesCol("z").setPredictionCol("c").transform(points).toPandas().sort_values("z")
    assert np.allclose(mine.c, want, atol=1e-6)
    out = learning.predict(model, test, F.when(F.col("body").contains("regret"), "rejection")).toPandas()
    rule = out.body.str.contains("regret")
    assert (out.label[rule] == "rejection").all() and (out.score[rule] == 0.95).all()
    assert (out.ignore == ((out.label == "noise") | (out.score < 0.6))).all()
    assert {"applied", "regret", "sale"} <= set(learning.telling_terms(model, "body"))


def test_alias_mining(spark):
    got = {r.candidate: (r.similar, round(r.ratio, 9)) for r in registry.queries()["e14_f14_alias_mining"](spark, FOLDER).collect()}
    names = ["Firm One", "Firm 1", "Firm 2", "Example Group"]
    assert got
    for c, (similar, ratio) in got.items():
        ratios = [difflib.SequenceMatcher(None, c.lower(), n.lower()).ratio() for n in names]
        best = max(range(len(names)), key=lambda i: (ratios[i], -i))
        assert ratio == round(ratios[best], 9) and similar == (names[best] if ratios[best] >= 0.75 else None)


def test_page_content(spark):
    """Lengths of the registered query are those of the functions; the functions on pages written by hand."""
    got = {r.page_id: (r.sanitised, r.content) for r in registry.queries()["f31_f39_page_content"](spark, FOLDER).collect()}
    pages = {r.page_id: r.html for r in Tables(spark, FOLDER).pages.collect()}
    assert set(got) == set(pages) and all(n[1] is None or n[1] <= 3000 for n in got.values())
    for k in list(pages)[:20]:
        body = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "", pages[k])
        body = re.split(r"(?i)<body[^>]*>", body)[-1]
        assert got[k][0] <= len(body)
    page = "<html><head><style>s</style></head><body class='x'><nav>A b</nav><script>no</script><p>One two three four five six.</p><div>Seven eight nine ten eleven</div><noscript>n</noscript></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("plain",), ("<p>" + "word " * 2000 + "</p>",)], "h string")
    rows = df.select(html.sanitised("h").alias("s"), html.main_content("h").alias("c")).collect()
    assert rows[0].s == "<nav>A b</nav><p>One two three four five six.</p><div>Seven eight nine ten eleven</div>"
    assert rows[0].c == "One two three four five six.\nSeven eight nine ten eleven"
    assert rows[1].s is None and rows[1].c is None and rows[2].c == "plain" and len(rows[3].c) == 3000
    assert Counter(len(r.c or "") <= 3000 for r in rows) == {True: 4}

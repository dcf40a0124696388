"""Line dedup: batches, levels and compaction give what one pass over all documents gives."""

import random

import pytest
from pyspark.sql import functions as F

from quillwright.llm.line_dedup import LineRuns, dedup_lines


def brute(rows, least=10):
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            k = x.strip(" \t\n\v\f\r").lower()
            first[k] = min(first.get(k, i), i)
    return {i: "\n".join(x for x in t.split("\n") if len(k := x.strip(" \t\n\v\f\r").lower()) < least or first[k] == i) for i, t in rows}


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (9, 3)])
def test_batches(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"line number {k} of the pool" for k in range(40)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), f"own line {i} {rng.random()}", "tiny"]) for _ in range(rng.randint(0, 12)))) for i in rng.sample(range(1000), 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gone", F.lit("kept")).repartition(3)
    got = dedup_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)


def test_levels(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(7):
        runs.add(spark.createDataFrame([(k, k, False, 10 * b + k) for k in range(b + 1)], "k1 bigint, k2 bigint, z boolean, d bigint"))
    assert [len(x) for x in runs.levels] == [1, 1, 1]  # seven runs, in binary
    assert {r.k1: r.d for r in runs.owners().collect()} == {b: 11 * b for b in range(7)}
    plan = runs.spark.table(runs.names()[0]).join(runs.spark.table(runs.names()[1]).hint("merge"), ["k1", "k2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are bucketed alike: no shuffle to meet
    runs.close()
    assert not runs.names()


def test_hot_line(spark):
    """One line in all documents: the anti-join is by document, too."""
    got = dedup_lines(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the very same line\nthe very same line").alias("text")))
    assert [tuple(r) for r in got.filter("n_dropped < 2").select("doc_id", "n_dropped").collect()] == [(0, 0)]
    assert got.filter("n_dropped = 2 AND text = ''").count() == 4999

"""Folds in time order: chunks of a hot key, and streams whose rows come in any order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillwright.operators.dedup import longest_of_clusters, near_dedup
from quillwright.operators.rollup import EMPTY_STATE, propagate
from quillwright.plans.adapters import Tables
from quillwright.streaming import flows

BASE = dt.datetime(2024, 1, 1)


def greedy(rows, seconds):
    """rows (id, key, ts) -> {id: kept}, {id: id of its cluster's first row}"""
    last, kept, first = {}, {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (repr(r[1]), r[2], r[0])):
        if k not in last or (ts - last[k][0]).total_seconds() > seconds:
            last[k] = (ts, i)
            kept[i] = True
        else:
            kept[i] = False
        first[i] = last[k][1]
    return kept, first


@pytest.mark.parametrize("chunk", [1, 3, 17, 100_000])
def test_near_dedup_in_chunks(spark, chunk):
    """Dense keys, one of them with most rows: rows a second apart never let two phases of the fold meet."""
    rng = random.Random(chunk)
    rows = [(i, "hot", BASE + dt.timedelta(seconds=i)) for i in range(120)]
    rows += [(200 + i, rng.choice(["a", "b", None]), BASE + dt.timedelta(seconds=rng.randint(0, 90))) for i in range(150)]
    rows += [(500 + i, f"k{i}", BASE) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, key string, ts timestamp").withColumn("body", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).repartition(5)
    kept, first = greedy(rows, 5)
    assert {r.id: r.kept for r in near_dedup(df, ["key"], chunk=chunk).collect()} == kept
    best = {}
    for i, f in first.items():
        if f not in best or (i % 7, -i) > (best[f] % 7, -best[f]):
            best[f] = i
    assert sorted(r.id for r in longest_of_clusters(df, ["key"], chunk=chunk).collect()) == sorted(best.values())


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randint(0, 3)}", f"t{rng.randint(0, 5)}", BASE + dt.timedelta(seconds=rng.randint(0, 40_000)), rng.choice(["prescreen", "interview_invite", "rejection", "other", None]), rng.random()) for i in range(400)]
    return rows, "id bigint, sender string, thread_id string, ts timestamp, ml_label string, confidence double"


def streamed(spark, tmp_path, rows, schema, files):
    """A stream of the rows, shuffled over so many files, a batch each, and its end."""
    path = str(tmp_path / f"in{files}")
    mixed = list(rows)
    random.Random(files).shuffle(mixed)
    for k in range(files):
        spark.createDataFrame(mixed[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, flows.Closing(spark, stream)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_near_dedup_in_any_order(spark, tmp_path, messages, files):
    rows, schema = messages
    stream, end = streamed(spark, tmp_path, rows, schema, files)
    got = flows.run_available(flows.near_dedup_stream(stream.union(end.stream), ["sender"], 60), end=end).filter("id IS NOT NULL")
    assert {r.id: r.kept for r in got.collect()} == greedy([(i, s, ts) for i, s, _, ts, *_ in rows], 60)[0]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_thread_states_in_any_order(spark, tmp_path, messages, files):
    rows, schema = messages
    stream, end = streamed(spark, tmp_path, rows, schema, files)
    both = stream.union(end.stream.withColumn("ml_label", F.lit("other")))
    got = flows.run_available(flows.thread_states(both), "update", ["thread_id"], end).filter("thread_id IS NOT NULL")
    want = {}
    for i, _, thread, ts, label, confidence in sorted(rows, key=lambda r: (r[3], r[0])):
        if label:
            want[thread] = propagate(want.get(thread, dict(EMPTY_STATE)), label, confidence, ts.date())
    assert {r.thread_id: {k: r[k] for k in EMPTY_STATE} for r in got.collect()} == want


def test_rows_behind_the_watermark_and_idle_keys(spark, tmp_path):
    """A row later than the bound is left out; a key's state goes ``idle`` after its last row, so it starts anew."""
    schema, path = "id bigint, sender string, ts timestamp", str(tmp_path / "late")
    at = lambda s: BASE + dt.timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (2, "b", at(1000))], [(3, "a", at(10)), (4, "a", at(990)), (5, "b", at(5000))], [(6, "a", at(30)), (7, "b", at(9000))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())
    assert len(files) == 3
    end = flows.Closing(spark, stream)
    got = flows.run_available(flows.near_dedup_stream(stream.union(end.stream), ["sender"], 600, idle="100 seconds", late="100 seconds"), end=end).filter("id IS NOT NULL")
    found = {r.id: r.kept for r in got.collect()}
    assert found[1] and found[2] and found[4] and found[5] and found[7]
    assert 6 not in found  # 30 s is behind the watermark of 4900 s


def test_every_flow_in_many_files(spark, tmp_path):
    """As many batches as files give what one batch gives."""
    schema = "event_id bigint, user_id bigint, ts timestamp, event_type string"
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 9), BASE + dt.timedelta(hours=rng.randint(0, 300)), "click") for i in range(200)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    once = flows.run_available(flows.once_each(flows.in_files(t, 4)[0], late=flows.ANY_ORDER).select("id"))
    assert sorted(r.id for r in once.collect()) == list(range(200))
    daily = [{(r.start, r.n) for r in flows.run_available(flows.rolling_counts(flows.in_files(t, k)[0], "1 day", "1 day"), "complete").collect()} for k in (1, 4)]
    assert daily[0] == daily[1] and sum(n for _, n in daily[0]) == 200
    sessions = []
    for k in (1, 4):
        stream, end = flows.in_files(t, k)
        both = stream.union(end.stream).select("company_id", "ts")
        sessions.append(sorted(map(tuple, flows.run_available(flows.activity_sessions(both, ["company_id"], "5 hours", late=flows.ANY_ORDER), end=end).filter("company_id IS NOT NULL").collect())))
    assert sessions[0] == sessions[1] and sum(r[-1] for r in sessions[0]) == 200

"""The mailbox source: pages left out by the date filter, offsets; dictionaries that change between batches; readers and sinks."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from quillwright.functions.text import email_domain
from quillwright.operators.resolve import suffix_join
from quillwright.sources import mailbox, readers, sinks
from quillwright.sources.versioned import VersionedDictionary, with_dictionary
from quillwright.streaming.flows import run_available

BASE = dt.datetime(2024, 1, 1)


def messages(spark, lo, hi):
    rows = [(f"m{i}", f"t{i % 5}", "A <a@d1.example.com>", None if i % 11 == 0 else f"Role {i % 4}", f'body "{i}"\nline', BASE + dt.timedelta(hours=i)) for i in range(lo, hi)]
    return spark.createDataFrame(rows, mailbox.SCHEMA)


@pytest.fixture
def box(spark, tmp_path):
    path = f"file://{tmp_path}/box"
    mailbox.register(spark)
    mailbox.write_mailbox(messages(spark, 0, 100), path, page=10)
    return path


def test_date_filter_leaves_out_pages(spark, box):
    mails = spark.read.format("mailbox").load(box)
    assert mails.rdd.getNumPartitions() == 10 and mails.count() == 100
    day = lambda d: F.lit(dt.datetime(2024, 1, d)).cast("timestamp")
    some = mails.filter((F.col("ts") >= day(2)) & (F.col("ts") < day(3)))  # hours 24 to 47
    assert some.rdd.getNumPartitions() == 3 and sorted(int(r.msg_id[1:]) for r in some.collect()) == list(range(24, 48))
    none = mails.filter(F.col("ts") > day(20))
    assert none.rdd.getNumPartitions() == 1 and none.count() == 0
    both = mails.filter((F.col("ts") < day(2)) & F.col("subject").contains("Role 3"))
    assert both.rdd.getNumPartitions() == 3 and {r.msg_id for r in both.collect()} == {f"m{i}" for i in range(24) if i % 4 == 3 and i % 11}
    plan = mails.filter(F.col("subject") == "Role 1").select("msg_id")._jdf.queryExecution().executedPlan().toString()
    assert "= Role 1" not in plan.split("PushedFilters")[0]  # the source has done it
    assert mails.filter("subject IS NULL").count() == 10


def test_a_restart_goes_on_at_the_offset(spark, box, tmp_path):
    stream = spark.readStream.format("mailbox").load(box)

    def run():
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").format("parquet").option("path", f"{tmp_path}/rows").start().awaitTermination()
        return sorted(int(r.msg_id[1:]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    assert run() == list(range(100))
    mailbox.write_mailbox(messages(spark, 100, 125), box, page=10, start=10)
    assert run() == list(range(125)) and run() == list(range(125))  # each once
    late = spark.readStream.format("mailbox").option("after", "2024-01-04T00:00:00+00:00").load(box)
    assert min(int(r.msg_id[1:]) for r in run_available(late).collect()) == 70  # the page that holds hour 72


def test_dictionary_changes_between_batches(spark, tmp_path):
    """Three files, a batch each; after the first batch the dictionary's file is another one."""
    path, rows = str(tmp_path / "words.json"), str(tmp_path / "rows")
    words = lambda company: json.dumps({"domains": {"D1.example.com": company}, "ats": ["example.net"]})
    open(path, "w").write(words("Firm One"))
    for k in range(3):
        messages(spark, 10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(rows)
    stream = spark.readStream.schema(mailbox.SCHEMA).option("maxFilesPerTrigger", 1).parquet(rows)
    seen = []

    def use(batch, frames):
        out = suffix_join(batch.withColumn("host", email_domain("sender")), "host", frames["domains"]).select("msg_id", "company")
        seen.append(len(seen))
        if len(seen) == 1:
            open(path, "w").write(words("Firm One Renamed"))
        return out

    dictionary = VersionedDictionary(spark, path)
    done = with_dictionary(stream, dictionary, use)
    got = spark.read.parquet(f"{done}/rows")
    assert [(r.batch, r.company, r.n) for r in got.groupBy("batch", "company").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [(0, "Firm One", 10), (1, "Firm One Renamed", 10), (2, "Firm One Renamed", 10)]
    versions = [r[0] for r in got.select("dictionary_version").distinct().orderBy("dictionary_version").collect()]
    assert len(versions) == 2 and versions[-1] == dictionary.current()[0]
    same = dictionary.current()[1]
    assert dictionary.current()[1] is same  # not read again while the file stays
    os.remove(path)
    with pytest.raises(Exception, match="words.json"):
        dictionary.current()


def test_csv_and_model_free_sinks(spark, tmp_path):
    """S11/S12 read what K11 writes; K01 appends; K12 writes NDJSON; K13 writes what S09 reads."""
    df = spark.createDataFrame([("m1", "noise"), ('m"2', "a,b"), ("m3", None)], readers.TRUTH)
    sinks.csv_report(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in spark.read.schema(readers.TRUTH).option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()} >= {("m1", "noise"), ("m3", None)}
    for _ in range(2):
        sinks.append(df, f"{tmp_path}/rows", ["label"])
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 6
    sinks.json_report(df, f"{tmp_path}/json")
    assert {r.msg_id for r in spark.read.schema(readers.TRUTH).json(f"{tmp_path}/json").collect()} == {"m1", 'm"2', "m3"}
    aliases = spark.createDataFrame([("b", "B"), ("a", "A")], "alias string, company string")
    domains = spark.createDataFrame([("x.example", "company", "X"), ("y.example", "ats", None)], "domain string, kind string, company string")
    sinks.write_dictionary(aliases, domains, f"{tmp_path}/words.json")
    frames = readers.dictionary(spark, f"{tmp_path}/words.json")
    assert [(r.alias, r.company) for r in frames["aliases"].orderBy("ord").collect()] == [("a", "A"), ("b", "B")]
    assert {(r.domain, r.kind) for r in frames["domains"].collect()} == {("x.example", "company"), ("y.example", "ats")}


def test_reports_have_their_columns(spark, tmp_path):
    """A report is written with the columns of its kind and read back by the readers (S11, S12); others are refused."""
    from quillwright.operators import reports

    messages = spark.createDataFrame([(1, "m1", "t", 'a "quoted", text', "s", "noise", 0.256, True, BASE), (2, "m2", None, None, None, None, None, None, None)], "id bigint, msg_id string, thread_id string, subject string, sender string, ml_label string, confidence double, reviewed boolean, ts timestamp")
    predicted = spark.createDataFrame([(1, "other", 0.5, "model")], "id bigint, label string, confidence double, method string")
    df = reports.reclassified_report(messages, predicted)
    reports.write_report("reclassified", df, f"{tmp_path}/r")
    back = {r.message_id: r for r in spark.read.schema(readers.RECLASSIFIED).option("header", True).option("escape", '"').csv(f"{tmp_path}/r").collect()}
    assert (back["m1"].subject, back["m1"].old_conf, back["m1"].new_label, back["m1"].new_conf) == ('a "quoted", text', 0.26, "other", 0.5)
    assert (back["m2"].old_label, back["m2"].new_conf, back["m2"].method) == (None, 0.0, "unknown")
    with pytest.raises(ValueError, match="labels"):
        reports.write_report("labels", df, f"{tmp_path}/x")
    counters = reports.disagreement_counters(df.select("old_label", "new_label", "method"))
    assert {k: sorted(map(tuple, v.collect())) for k, v in counters.items()} == {"by_pair": [("noise", "other", 1)], "by_old_label": [("noise", 1)], "by_new_label": [("other", 1)], "by_method": [("model", 1)]}

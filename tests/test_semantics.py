"""Hand-written micro fixtures for semantics that the tables do not exercise."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillwright.functions import html, mail, sem, text
from quillwright.operators import aggregates, audits, dedup, joins, resolve, rollup, rules
from quillwright.sources import readers, sinks


def values(df, column):
    return [r[column] for r in df.collect()]


def test_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("noise",), ("x",)], "label string")
    assert values(df.filter(sem.is_not("label", "noise")), "label") == [None, "", "x"]
    assert values(df.select(sem.blank_to_null("label").alias("v")), "v") == [None, None, "noise", "x"]


def test_two_clocks(spark):
    rows = [("2024-01-10 04:59:00",), ("2024-01-10 05:00:00",), ("2024-07-10 03:59:00",), ("2024-07-10 04:00:00",)]
    df = spark.createDataFrame(rows, "s string").withColumn("ts", F.to_timestamp("s"))
    assert [d.day for d in values(df.select(sem.local_date("ts").alias("d")), "d")] == [9, 10, 9, 10]


def test_elapsed_days_are_whole_periods(spark):
    rows = [("2024-01-30 00:01:00",), ("2024-01-30 00:00:00",), ("2024-01-29 23:59:00",)]
    df = spark.createDataFrame(rows, "s string").withColumn("ts", F.to_timestamp("s"))
    assert values(df.select(sem.elapsed_days("ts", sem.as_of()).alias("n")), "n") == [0, 1, 1]


def test_near_dedup_compares_with_kept_rows(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "k", base + dt.timedelta(seconds=s)) for i, s in enumerate((0, 4, 8, 13, 100))]
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp")
    kept = {r.id for r in dedup.near_dedup(df, ["k"]).filter("kept").collect()}
    assert kept == {0, 2, 4}
    again = dedup.near_dedup(df.filter(F.col("id").isin(*kept)), ["k"])
    assert again.filter("NOT kept").isEmpty()  # idempotent


def test_gap_filled_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 4), 1)], "day date, n bigint")
    got = {r.day.day: r.n for r in aggregates.gap_filled(df, until="2024-01-05").collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 1, 5: 0}
    assert aggregates.gap_filled(df.limit(0)).isEmpty()


def test_band_join_meets_neighbouring_buckets(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "k", base + dt.timedelta(seconds=s)) for i, s in enumerate((9, 10, 14, 20))]
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp")
    assert {(r.a, r.b) for r in joins.band_pairs(df, ["k"], "ts", 5).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_suffix_join_order_and_lookalikes(spark):
    dims = spark.createDataFrame([("example.com", "b", 2), ("mail.example.com", "c", 3), ("com", "a", 1)], "domain string, kind string, ord int")
    rows = spark.createDataFrame([("mail.example.com",), ("x.mail.example.com",), ("notexample.org",), (None,)], "host string")
    first = {r.host: r.kind for r in resolve.suffix_join(rows, "host", dims).collect()}
    longest = {r.host: r.kind for r in resolve.suffix_join(rows, "host", dims, longest=True).collect()}
    assert first == {"mail.example.com": "c", "x.mail.example.com": "a", "notexample.org": None, None: None}
    assert longest["x.mail.example.com"] == "c"


#: One text for each step of the decision list, and replies.
CASES = [
    ("Application submitted today", "", "job_application"),
    ("Assessment complete", "", "other"),
    ("Hi", "please finish your application", "other"),
    ("Hi", "the position was cancelled", "cancelled"),
    ("Hi", "we are not moving forward, thank you for applying", "rejection"),
    ("Hi", "a phone screen", "prescreen"),
    ("Re: Hi", "a phone screen", "other"),
    ("Hi", "schedule a call", "interview_invite"),
    ("Re: Hi", "schedule a call", "other"),
    ("Hi", "thank you for applying", "job_application"),
    ("Hi", "Jo referred you", "referral"),
    ("Hi", "a status update", "other"),
    ("Hi", "we received your application", "job_application"),
    ("Hi", "an offer letter", "offer"),
    ("Hi", "my client is hiring", None),
    ("Hi", "my client is hiring, call me", "head_hunter"),
    ("Hi", "error number 3", None),
    ("Hi", "error number 2", "noise"),
    ("Hi", "nothing", None),
    (None, None, None),
]


def test_decision_list(spark):
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(CASES)], "i int, s string, b string")
    # the rules of the queries: the library's own and what the test tables hold
    got = {r.i: r.label for r in df.select("i", rules.classify(F.col("s"), F.col("b"), rules.TABLE_RULES).alias("label")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]
    # the library's own alone: the same but for the error numbers
    got = {r.i: r.label for r in df.select("i", rules.classify(F.col("s"), F.col("b")).alias("label")).collect()}
    assert [got[i] for i in range(len(CASES))] == [None if "error" in (c[1] or "") else c[2] for c in CASES]
    own = [("Hi", "news, unsubscribe", "noise"), ("Hi", "interview confirmed, unsubscribe", "interview_invite"), ("Hi", "we regret to inform you", "rejection"), ("Hi", "no response to our mail", "ghosted")]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(own)], "i int, s string, b string")
    assert {r.i: r.label for r in rows.select("i", rules.classify(F.col("s"), F.col("b")).alias("label")).collect()} == {i: c[2] for i, c in enumerate(own)}


def test_names(spark):
    names = ["Acme Widgets, Inc.", " Blue  River LLC - ", "John Smith", "senior engineer", None, "a b c d e f g h i", "Müller Group"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(text.normal_name("n").alias("normal"), text.person_like("n").alias("person"), text.valid_name("n").alias("valid")).collect()
    assert [r.normal for r in rows][:2] == ["Acme Widgets", "Blue River LLC"] or [r.normal for r in rows][0] == "Acme Widgets"
    assert [r.person for r in rows] == [False, False, True, False, False, False, False]
    assert [r.valid for r in rows] == [True, True, True, False, False, False, True]


RAW = """From: =?utf-8?q?J=C3=BCrgen?= <j@d1.example.com>
To: me@example.org
Subject: =?utf-8?B?R3LDvMOfZQ==?=
Date: Tue, 02 Jan 2024 10:00:00 -0500
Message-ID: <one@example.com>
List-Unsubscribe: <mailto:x@example.com>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: quoted-printable

<p>caf=C3=A9</p><script>no</script>
--b
Content-Type: text/calendar

BEGIN:VEVENT
ORGANIZER;CN=X:mailto:Boss@D2.example.com
END:VEVENT
--b--
"""


def test_mail_decoding(spark, tmp_path):
    (tmp_path / "a.eml").write_text(RAW)
    (tmp_path / "b.eml").write_text("no headers at all")
    got = {r.path[-5:]: r for r in readers.raw_mail(spark, str(tmp_path)).collect()}
    a = got["a.eml"]
    assert (a.msg_id, a.subject, a.body, a.organizer) == ("one@example.com", "Grüße", "café", "boss@d2.example.com")
    assert a.date == dt.datetime(2024, 1, 2, 15) and a.header_hints.newsletter and not a.header_hints.bulk
    assert got["b.eml"].error == "no headers"


def test_transfer_encodings():
    assert mail.transfer_decoded("w6kgPz4_", "base64") == mail.transfer_decoded("w6kgPz4/", "base64") == "é ?>?"
    assert mail.transfer_decoded("a=3Db", "Quoted-Printable") == "a=b" and mail.transfer_decoded(None, "7bit") is None


def test_pages(spark):
    page = "<html><head><title> T </title><style>x</style></head><body><p>One two three four five.</p><a href='/jobs'>J</a></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    rows = df.select(html.html_to_text("h").alias("t"), html.site_name("h").alias("n"), html.career_link("h").alias("c")).collect()
    assert rows[0].t == "T One two three four five. J" and rows[0].n == "T" and rows[0].c == "/jobs"
    assert rows[1].t is None and rows[2].t == ""


def test_audit_log_aliases_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ts": "2024-01-01T00:00:00Z", "action": "x"}\nnot json\n{"created_at": "2024-01-02T00:00:00Z", "action": "y"}\n')
    assert sorted(values(readers.audit_log(spark, str(tmp_path)), "action")) == ["x", "y"]


def test_filter_export(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed xmlns:apps="a"><entry><title>M</title><apps:property name="from" value="x@y.example"/><apps:property name="label" value="L"/></entry></feed>')
    assert {(r.name, r.value) for r in readers.filter_export(spark, str(tmp_path)).collect()} == {("from", "x@y.example"), ("label", "L")}


def test_snapshots_and_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    sinks.write_snapshot(old, str(tmp_path), "v1")
    new = audits.upsert(sinks.read_snapshot(spark, str(tmp_path)), spark.createDataFrame([(2, "c"), (3, "d")], "id bigint, v string"), ["id"], ["v"])
    sinks.write_snapshot(new, str(tmp_path), "v2")
    assert {(r.id, r.v) for r in sinks.read_snapshot(spark, str(tmp_path)).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_ghost_threshold_order(monkeypatch):
    monkeypatch.setenv("GHOSTED_DAYS_THRESHOLD", "45")
    assert [rollup.days_until_ghosted(10, 20), rollup.days_until_ghosted(None, 20), rollup.days_until_ghosted(), rollup.days_until_ghosted(0)] == [10, 20, 45, 1]


@pytest.mark.parametrize("label,first,old,second", [("prescreen", "prescreen_date", "interview_invite", "interview_date"), ("interview_invite", "interview_date", "prescreen", "prescreen_date")])
def test_propagation_clears_the_other_date_of_the_same_day(label, first, old, second):
    day = dt.date(2024, 1, 1)
    state = rollup.propagate({**rollup.EMPTY_STATE, "ml_label": old, second: day}, label, 0.9, day)
    assert state[first] == day and state[second] is None
    kept = rollup.propagate({**rollup.EMPTY_STATE, "ml_label": "other", second: day}, label, None, day)
    assert kept[first] == day and kept[second] == day and kept["ml_confidence"] is None


def test_propagation_attaches_and_creates(spark):
    at = lambda d: dt.datetime(2024, 1, d, 12)
    rows = [
        (1, "t1", 1, at(2), "prescreen", 0.8),  # its own thread's row
        (2, "x1", 1, at(3), "interview_invite", 0.7),  # no row: joins the company's earliest, t0
        (3, "x2", 1, at(4), "job_application", 0.6),  # creates x2
        (4, "x2", 1, at(5), "rejection", None),  # updates x2, confidence kept
        (5, "x3", 2, at(5), "prescreen", 0.5),  # a company without a row: creates x3
        (6, "x4", 2, at(6), "interview_invite", 0.4),  # joins x3
        (7, "x5", 2, at(7), "noise", 0.9),  # nothing
        (8, "x6", None, at(7), "job_application", 0.9),  # no company: nothing
        (9, "t1", 1, at(2), "interview_invite", 0.9),  # the same day as the prescreen: clears its date
    ]
    messages = spark.createDataFrame(rows, "id bigint, thread_id string, company_id bigint, ts timestamp, ml_label string, confidence double")
    day = dt.date(2023, 12, 1)
    threads = spark.createDataFrame([("t0", 1, day, "job_application", None, None), ("t1", 1, dt.date(2023, 12, 2), "job_application", None, None)], "thread_id string, company_id bigint, sent_date date, ml_label string, prescreen_date date, interview_date date")
    got = {r.thread_id: (r.created, r.ml_label, r.ml_confidence, r.prescreen_date and r.prescreen_date.day, r.interview_date and r.interview_date.day) for r in rollup.propagate_labels(messages, threads).collect()}
    assert got == {
        "t1": (False, "interview_invite", 0.9, None, 2),
        "t0": (False, "job_application", None, None, 3),
        "x2": (True, "rejection", 0.6, None, None),
        "x3": (True, "prescreen", 0.5, 5, 6),
    }

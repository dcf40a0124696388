"""Structured Streaming forms (T01-T07). Each takes and gives a streaming DataFrame; ``run_available`` drives a bounded run.

State is bounded by event time: what a key remembers goes when the watermark has passed its last row by ``idle``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import email_domain
from ..operators.resolve import suffix_join
from ..operators.rollup import EMPTY_STATE, propagate
from ..plans.adapters import SQL
from ..plans.lineage import new_path
from ..registry import query
from ..sources.mailbox import register, write_mailbox
from ..sources.sinks import write_dictionary
from ..sources.versioned import VersionedDictionary, with_dictionary
from .ordered import in_event_order

EPOCH = dt.datetime(1970, 1, 1)
#: How late rows may be where a bounded input is dealt out in any order: longer than all of it.
ANY_ORDER = "4000 days"


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """Messages from a folder of event files; so many files a batch bound a batch's size."""
    events = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return spark.sql(SQL["messages"], events=events)


def run_available(rows: DataFrame, mode: str = "append", keys: list[str] | None = None, end: Closing | None = None) -> DataFrame:
    """Process what is there, then once more after ``end`` has let the watermark pass it, and return the result as a table of the shared folder, where the query's checkpoint is too.

    Append mode writes to Spark's file sink. In complete and update mode each batch is a folder named after the batch, so a repeated
    batch replaces itself; the result is the last batch, or in update mode each key's last row.
    """
    spark = rows.sparkSession
    path = new_path(spark, "flow")

    def run(put=None) -> None:
        for last in (False, True) if end else (True,):
            writer = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
            writer = writer.foreachBatch(put) if put else writer.format("parquet").option("path", f"{path}/rows")
            writer.start().awaitTermination()
            if not last:
                end.release()

    if mode == "append":
        run()
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run(put)
    found = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "complete":
        return found.join(found.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    values = [c for c in rows.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


def once_each(rows: DataFrame, key: str = "msg_id", ts: str = "ts", late: str = "30 days") -> DataFrame:
    """Each id once; ids are forgotten ``late`` after, so the state is bounded."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rolling_counts(rows: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Rows in windows; a step as long as the window gives tumbling ones."""
    w = F.window(ts, length, step) if step != length else F.window(ts, length)
    return rows.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def activity_sessions(rows: DataFrame, keys: list[str], gap: str = "3 days", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Bursts of activity; a session's end plus the gap is when its key has gone quiet."""
    return rows.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def near_dedup_stream(rows: DataFrame, keys: list[str], seconds: int = 5, idle: str = "30 days", late: str = "30 days") -> DataFrame:
    """D03 over a stream, in event-time order: a key's state is its last kept instant, whatever order rows arrive in."""
    window = seconds * 1_000_000

    def fold(key: tuple, last: tuple | None, waiting: list[tuple]) -> tuple[tuple, list[tuple]]:
        anchor, out = last[0] if last else None, []
        for us, i in waiting:
            kept = anchor is None or us - anchor > window
            anchor = us if kept else anchor
            out.append((i, kept))
        return (anchor,), out

    return in_event_order(rows.select(*keys, "ts", "id"), keys, "ts", ["id"], "last bigint", "id bigint, kept boolean", fold, late=late, idle=idle)


def thread_states(rows: DataFrame, idle: str = "90 days", late: str = "30 days") -> DataFrame:
    """R01 over a stream, in event-time order: new states of the threads whose rows the watermark has passed."""
    names = list(EMPTY_STATE)

    def fold(key: tuple, last: tuple | None, waiting: list[tuple]) -> tuple[tuple, list[tuple]]:
        now = dict(zip(names, last, strict=True)) if last else dict(EMPTY_STATE)
        for us, _, label, confidence in waiting:
            now = propagate(now, label, confidence, (EPOCH + dt.timedelta(microseconds=us)).date())
        state = tuple(now[n] for n in names)
        return state, [(key[0], *state)]

    fields = "ml_label string, ml_confidence double, prescreen_date date, interview_date date"
    labelled = rows.filter("ml_label IS NOT NULL").select("thread_id", "ts", "id", "ml_label", "confidence")
    return in_event_order(labelled, ["thread_id"], "ts", ["id", "ml_label", "confidence"], fields, f"thread_id string, {fields}", fold, late=late, idle=idle, mode="update")


class Closing:
    """A stream like ``like`` that gives nothing until ``release`` puts one row of nulls at a late instant into it: joined to a bounded
    stream by ``union``, that row moves the watermark past all that waits. It has to come after all data, or they would be late."""

    def __init__(self, spark: SparkSession, like: DataFrame, ts: str = "ts") -> None:
        self.spark, self.path = spark, new_path(spark, "closing")
        self._empty().write.parquet(self.path)  # the folder, with a file of no rows
        row = spark.readStream.schema("at timestamp").parquet(self.path)
        self.stream = row.select(*(F.col("at").alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "at timestamp")

    def release(self, at: dt.datetime = dt.datetime(2100, 1, 1)) -> None:
        self.spark.createDataFrame([(at,)], "at timestamp").coalesce(1).write.mode("append").parquet(self.path)


def in_files(t, files: int = 3) -> tuple[DataFrame, Closing]:
    """The messages as a stream of so many files, a batch each, dealt out by a hash: rows come out of order, states cross batches."""
    path = new_path(t.spark, "stream-in")
    t.events.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    rows = message_stream(t.spark, path, 1)
    return rows, Closing(t.spark, rows)


@query("t01_stream_once_each", "SELECT msg_id FROM messages")
def _(t):
    rows, _ = in_files(t)
    twice = rows.union(in_files(t)[0])  # each row comes twice, in another order
    return run_available(once_each(twice, late=ANY_ORDER).select("msg_id"))


@query("t04_stream_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM messages GROUP BY 1")
def _(t):
    return run_available(rolling_counts(in_files(t)[0], "1 day", "1 day"), "complete")


@query("t03_stream_rolling_week", "SELECT CAST(day AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS day FROM messages) GROUP BY 1")
def _(t):
    return run_available(rolling_counts(in_files(t)[0]), "complete")


@query("t02_stream_near_dedup", "WITH RECURSIVE o AS (SELECT id, sender, ml_label, ts, row_number() OVER (PARTITION BY sender, ml_label ORDER BY ts, id) AS rn FROM messages WHERE ml_label IS NOT NULL), f AS (SELECT id, sender, ml_label, ts AS anchor, rn, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.sender, o.ml_label, CASE WHEN epoch_us(o.ts) - epoch_us(f.anchor) > 600000000 THEN o.ts ELSE f.anchor END, o.rn, epoch_us(o.ts) - epoch_us(f.anchor) > 600000000 FROM f JOIN o ON o.sender = f.sender AND o.ml_label = f.ml_label AND o.rn = f.rn + 1) SELECT id, kept FROM f")
def _(t):
    rows, end = in_files(t)
    labelled = rows.filter("ml_label IS NOT NULL").union(end.stream)
    return run_available(near_dedup_stream(labelled, ["sender", "ml_label"], 600, late=ANY_ORDER), end=end).filter("id IS NOT NULL")


@query("t05_stream_sessions", "WITH o AS (SELECT company_id, ts, ts - lag(ts) OVER (PARTITION BY company_id ORDER BY ts) > INTERVAL 12 HOUR AS new FROM messages), s AS (SELECT company_id, ts, count(*) FILTER (new) OVER (PARTITION BY company_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT company_id, count(*) AS n FROM s GROUP BY company_id, k")
def _(t):
    rows, end = in_files(t)
    both = rows.union(end.stream).select("company_id", "ts")
    done = run_available(activity_sessions(both, ["company_id"], "12 hours", late=ANY_ORDER).select("company_id", "n"), end=end)
    return done.filter("company_id IS NOT NULL")


@query("t06_stream_thread_state", "SELECT thread_id, max_by(ml_label, (ts, id)) AS ml_label, min(CASE WHEN ml_label = 'interview_invite' THEN CAST(ts AS DATE) END) AS interview_date FROM messages WHERE ml_label IS NOT NULL GROUP BY 1")
def _(t):
    rows, end = in_files(t)
    open_end = end.stream.withColumn("ml_label", F.lit("other"))  # rows without a label are left out
    return run_available(thread_states(rows.union(open_end), late=ANY_ORDER), "update", ["thread_id"], end).filter("thread_id IS NOT NULL").select("thread_id", "ml_label", "interview_date")


@query("s09_k13_stream_with_dictionary", "SELECT id, CASE WHEN company_id % 20 IN (1, 2, 4, 5, 6) THEN 'company' WHEN company_id % 20 IN (3, 7) THEN 'headhunter' WHEN company_id % 20 = 9 THEN 'job_board' END AS kind FROM messages")
def _(t):
    path = f"{new_path(t.spark, 'dictionary')}/words.json"
    write_dictionary(t.aliases, t.domains.filter("kind <> 'personal' AND domain LIKE 'd%'"), path)
    rows, _ = in_files(t)
    done = with_dictionary(rows, VersionedDictionary(t.spark, path), lambda batch, d: suffix_join(batch.withColumn("host", email_domain("sender")), "host", d["domains"]).select("id", "kind"))
    return t.spark.read.parquet(f"{done}/rows").select("id", "kind")


def _mailbox(t) -> str:
    path = new_path(t.spark, "mailbox")
    write_mailbox(t.messages, path, page=200)
    register(t.spark)
    return path


@query("s02_mailbox_pushdown", "SELECT msg_id, thread_id, subject FROM messages WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-16 12:00:00' AND contains(subject, 'Role 3')")
def _(t):
    mails = t.spark.read.format("mailbox").load(_mailbox(t))
    return mails.filter("ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-16 12:00:00'").filter(F.col("subject").contains("Role 3")).select("msg_id", "thread_id", "subject")


@query("s02_s03_mailbox_stream", "SELECT msg_id, ts FROM messages")
def _(t):
    stream = t.spark.readStream.format("mailbox").load(_mailbox(t))
    return run_available(once_each(stream, late=ANY_ORDER).select("msg_id", "ts"))

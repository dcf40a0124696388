"""Sources (S01-S21): every reader has an explicit schema; malformed input becomes rows that say so, not failures."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions import mail
from ..functions.html import html_to_text

AUDIT = "created_at timestamp, timestamp timestamp, ts timestamp, user string, action string, source string, msg_id string, db_id bigint, thread_id string, company_id bigint, details string, error string, trace string, pid int, _bad string"
TRUTH = "msg_id string, label string"
RECLASSIFIED = "message_id string, thread_id string, timestamp timestamp, reviewed boolean, subject string, old_label string, old_conf double, new_label string, new_conf double, method string"


def tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S01"""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_mail(spark: SparkSession, path: str) -> DataFrame:
    """A folder of raw messages, one file each, decoded in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content")
    return files.select("path", mail.decoded(F.col("content").cast("string")).alias("m")).select("path", "m.*")


def decoding_summary(mails: DataFrame) -> DataFrame:
    """How many messages of a folder could be decoded, by error; ``toJSON`` of it or of the messages is the dry run's output."""
    return mails.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.count("organizer").alias("invitations"), F.count_if("header_hints.newsletter").alias("newsletters"))


def assign_threads(mails: DataFrame, known: DataFrame) -> DataFrame:
    """``thread_id`` of new mails: that of the latest known message with the same subject and company, or else their own id.

    ``mails``: msg_id, subject, company_id; ``known``: subject, company_id, thread_id, ts, id. The latest is an aggregate with map-side combine.
    """
    last = known.filter("subject IS NOT NULL AND company_id IS NOT NULL").groupBy("subject", "company_id").agg(F.max_by("thread_id", F.struct("ts", "id")).alias("thread_id"))
    return mails.drop("thread_id").join(last, ["subject", "company_id"], "left").withColumn("thread_id", F.coalesce("thread_id", "msg_id"))


def unprocessed(rows: DataFrame, ledger: DataFrame, key: str = "msg_id", force: bool = False) -> DataFrame:
    """Rows that the ledger lacks; all of them if forced."""
    return rows if force else rows.join(ledger.select(key), key, "left_anti")


def api_messages(spark: SparkSession, path: str) -> DataFrame:
    """API messages, one JSON object a line."""
    m = spark.read.text(path).select(mail.api_metadata("value").alias("m"), mail.api_body("value").alias("b")).filter("m.id IS NOT NULL")
    c = F.col("m")
    return m.select(c["id"].alias("msg_id"), c["threadId"].alias("thread_id"), mail.header(c, "Subject").alias("subject"), mail.header(c, "From").alias("sender"), F.timestamp_millis(c["internalDate"].cast("bigint")).alias("ts"), F.col("b.body").alias("body"), F.col("b.body_html").alias("body_html"), c["labelIds"].alias("labels"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON log lines; field aliases folded, malformed lines left out."""
    rows = spark.read.schema(AUDIT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL").withColumn("created_at", F.coalesce("created_at", "timestamp", "ts")).drop("timestamp", "ts", "_bad")


def labelled_csv(spark: SparkSession, path: str, schema: str = TRUTH) -> DataFrame:
    """S11/S12"""
    return spark.read.schema(schema).option("header", True).csv(path)


def filter_export(spark: SparkSession, path: str) -> DataFrame:
    """An XML export of mail filters: one row for each entry and property."""
    schema = T.StructType.fromDDL("`apps:property` array<struct<_name:string,_value:string>>, title string")
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select("title", F.explode("apps:property").alias("p")).select("title", F.col("p._name").alias("name"), F.col("p._value").alias("value"))


@udtf(returnType="name string, value string")
class PastedSpec:
    """S14: 'Name: value' lines of a pasted specification; an indented line goes on with the last value."""

    def eval(self, text: str) -> Iterator[tuple]:
        name, value = None, []
        for line in (text or "").splitlines():
            if line[:1] in (" ", "\t") and name:
                value.append(line.strip())
                continue
            if name:
                yield name, " ".join(value)
            name, _, rest = line.partition(":")
            name, value = (name.strip().lower(), [rest.strip()]) if rest else (None, [])
        if name:
            yield name, " ".join(value)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Visible text of fetched pages; fetching is not the engine's work."""
    return pages.withColumn("text", html_to_text(html))


def dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON dictionary of domains, aliases and rules as dimension DataFrames with the file's order in ``ord``.

    Keys: ``domains`` (domain -> company), ``aliases`` (alias -> company), ``ats``, ``headhunter``, ``job_boards`` (lists),
    ``labels`` and ``vetoes`` (label -> patterns). Read through Spark, on the driver: dictionaries are configuration.
    """
    data = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    rows = [Row(domain=d.lower(), kind="company", company=c) for d, c in data.get("domains", {}).items()]
    rows += [Row(domain=d.lower(), kind=kind, company=None) for kind, key in (("ats", "ats"), ("headhunter", "headhunter"), ("job_board", "job_boards")) for d in data.get(key, [])]
    rules = [(stage, label, i, p) for stage in ("labels", "vetoes") for label, ps in data.get(stage, {}).items() for i, p in enumerate(ps)]
    return {
        "domains": spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "domain string, kind string, company string, ord int"),
        "aliases": spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(data.get("aliases", {}).items())], "alias string, company string, ord int"),
        "rules": spark.createDataFrame(rules, "stage string, label string, ord int, regex string"),
    }

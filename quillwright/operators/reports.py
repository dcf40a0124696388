"""Reports with columns of their own (K11): reviewed messages, labels, reclassification, mailbox against table, disagreement counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query

# fixed values: the reports' columns, in order
REPORTS = {
    "reviewed": ["msg_id", "label", "subject", "sender", "timestamp"],
    "labels": ["type", "id", "subject", "body", "ml_label"],
    "reclassified": ["message_id", "thread_id", "timestamp", "reviewed", "subject", "old_label", "old_conf", "new_label", "new_conf", "method"],
    "mailbox_only": ["msg_id", "thread_id", "subject", "gmail_labels"],
    "by_pair": ["old_label", "new_label", "count"],
    "by_old_label": ["old_label", "count"],
    "by_new_label": ["new_label", "count"],
    "by_method": ["method", "count"],
}


def write_report(kind: str, df: DataFrame, path: str) -> None:
    """A report as CSV with a header; its columns are those of its kind, or it isn't written."""
    if df.columns != REPORTS[kind]:
        raise ValueError(f"a report of kind {kind} has {REPORTS[kind]}, not {df.columns}")
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def reviewed_report(messages: DataFrame) -> DataFrame:
    """Reviewed messages with a label, the ground truth of a labelling."""
    return messages.filter("reviewed AND ml_label IS NOT NULL").select("msg_id", F.col("ml_label").alias("label"), "subject", "sender", F.col("ts").alias("timestamp"))


def label_report(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Labelled applications and messages in one list; applications have no body."""
    apps = threads.filter("ml_label IS NOT NULL").select(F.lit("application").alias("type"), F.col("thread_id").alias("id"), F.coalesce("job_title", F.lit("")).alias("subject"), F.lit("").alias("body"), "ml_label")
    return apps.union(messages.filter("ml_label IS NOT NULL").select(F.lit("message"), F.col("id").cast("string"), "subject", "body", "ml_label"))


def reclassified_report(messages: DataFrame, predicted: DataFrame) -> DataFrame:
    """What a new model says (id, label, confidence, method) beside what is stored; blanks for what is missing, two decimals for confidences."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    share = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    both = messages.join(predicted.select("id", F.col("label").alias("l_"), F.col("confidence").alias("c_"), F.col("method").alias("m_")), "id", "left")
    return both.select(F.col("msg_id").alias("message_id"), text("thread_id").alias("thread_id"), F.col("ts").alias("timestamp"), "reviewed", text("subject").alias("subject"), text("ml_label").alias("old_label"), share("confidence").alias("old_conf"), text("l_").alias("new_label"), share("c_").alias("new_conf"), F.coalesce(F.col("m_"), F.lit("unknown")).alias("method"))


def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """Messages of ``left`` (msg_id, thread_id, subject, labels) that ``right`` (msg_id) lacks, labels joined by semicolons."""
    return left.join(right.select("msg_id"), "msg_id", "left_anti").select("msg_id", F.coalesce("thread_id", F.lit("")).alias("thread_id"), F.coalesce("subject", F.lit("")).alias("subject"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "; ").alias("gmail_labels"))


def disagreement_counters(rows: DataFrame) -> dict[str, DataFrame]:
    """The four counters of rows (old_label, new_label, method) whose labels differ."""
    other = rows.filter("NOT (old_label <=> new_label)")
    return {kind: other.groupBy(*REPORTS[kind][:-1]).agg(F.count("*").alias("count")) for kind in ("by_pair", "by_old_label", "by_new_label", "by_method")}


def _predicted(t) -> DataFrame:  # noqa: ANN001
    new = F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("ml_label"))
    return t.messages.filter("id % 6 <> 0").select("id", new.alias("label"), (F.col("id") % 4 / 4).alias("confidence"), F.when(F.col("id") % 2 == 0, "rules").otherwise("model").alias("method"))


@query("k11_reviewed_report", "SELECT msg_id, ml_label AS label, subject, sender, ts AS timestamp FROM messages WHERE reviewed AND ml_label IS NOT NULL")
def _(t):
    return reviewed_report(t.messages)


@query("k11_label_report", "SELECT 'application' AS type, thread_id AS id, job_title AS subject, '' AS body, ml_label FROM threads UNION ALL SELECT 'message', CAST(id AS VARCHAR), subject, body, ml_label FROM messages WHERE ml_label IS NOT NULL")
def _(t):
    return label_report(t.threads, t.messages)


@query("k11_reclassified_report", "SELECT msg_id AS message_id, thread_id, ts AS timestamp, reviewed, subject, coalesce(ml_label, '') AS old_label, printf('%.2f', confidence) AS old_conf, CASE WHEN id % 6 = 0 THEN '' WHEN id % 7 = 0 THEN 'other' ELSE coalesce(ml_label, '') END AS new_label, printf('%.2f', CASE WHEN id % 6 = 0 THEN 0.0::DOUBLE ELSE (id % 4)::DOUBLE / 4 END) AS new_conf, CASE WHEN id % 6 = 0 THEN 'unknown' WHEN id % 2 = 0 THEN 'rules' ELSE 'model' END AS method FROM messages")
def _(t):
    return reclassified_report(t.messages, _predicted(t))


@query("k11_mailbox_only_report", "SELECT msg_id, thread_id, subject, 'Jobs; ' || coalesce(ml_label, 'none') AS gmail_labels FROM messages WHERE id % 10 = 3")
def _(t):
    mailbox = t.messages.select("msg_id", "thread_id", "subject", F.array(F.lit("Jobs"), F.coalesce("ml_label", F.lit("none"))).alias("labels"))
    return one_sided(mailbox, t.messages.filter("id % 10 <> 3"))


@query("k11_disagreement_counters", "WITH x AS (SELECT ml_label AS o, CASE WHEN id % 7 = 0 THEN 'other' ELSE ml_label END AS n, CASE WHEN id % 2 = 0 THEN 'rules' ELSE 'model' END AS m FROM messages WHERE id % 6 <> 0), y AS (SELECT * FROM x WHERE o IS DISTINCT FROM n) SELECT 'by_pair' AS report, concat_ws(' > ', coalesce(o, ''), coalesce(n, '')) AS k, count(*) AS count FROM y GROUP BY 1, 2 UNION ALL SELECT 'by_old_label', coalesce(o, ''), count(*) FROM y GROUP BY 1, 2 UNION ALL SELECT 'by_new_label', coalesce(n, ''), count(*) FROM y GROUP BY 1, 2 UNION ALL SELECT 'by_method', m, count(*) FROM y GROUP BY 1, 2")
def _(t):
    rows = t.messages.select("id", F.col("ml_label").alias("old_label")).join(_predicted(t).select("id", F.col("label").alias("new_label"), "method"), "id")
    out = None
    for kind, df in disagreement_counters(rows).items():
        key = F.concat_ws(" > ", *(F.coalesce(c, F.lit("")) for c in REPORTS[kind][:-1]))
        one = df.select(F.lit(kind).alias("report"), key.alias("k"), "count")
        out = one if out is None else out.union(one)
    return out

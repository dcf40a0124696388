"""Ranking, sorting, limits and pages.

Latest-per-key uses min_by/max_by, which combine before the shuffle; a window is used only where ranks are the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import written
from ..registry import query


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """One row for each key, the one with the greatest ``order``; an aggregate with map-side combine."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in take))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``; Spark limits groups before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def placed(rows: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """``keep`` and each row's ``place`` (from 1) in the order of all rows, without a window over all of them.

    The sorted rows are written once, each with its place inside its range partition; the partitions' sizes, one number each, give
    the offsets.
    """
    inside = F.monotonically_increasing_id()
    rows = written(rows.orderBy(*order).select(*keep, F.shiftright(inside, 33).alias("part"), inside.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select(*keep, (F.col("before") + F.col("at") + 1).alias("place"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


@query("w01_latest_label_per_company", "SELECT company_id, max_by(ml_label, (ts, id)) AS ml_label, max_by(id, (ts, id)) AS id FROM messages WHERE ml_label IS NOT NULL GROUP BY 1")
def _(t):
    return latest_per_key(t.messages.filter("ml_label IS NOT NULL"), ["company_id"], ["ts", "id"], ["ml_label", "id"])


@query("w02_first_last_per_thread", "SELECT thread_id, min_by(id, (ts, id)) AS first_id, max_by(id, (ts, id)) AS last_id FROM messages GROUP BY 1")
def _(t):
    order = F.struct("ts", "id")
    return t.messages.groupBy("thread_id").agg(F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"))


@query("w03_earliest_thread", "SELECT company_id, min_by(thread_id, (sent_date, thread_id)) AS thread_id FROM threads GROUP BY 1")
def _(t):
    return t.threads.groupBy("company_id").agg(F.min_by("thread_id", F.struct("sent_date", "thread_id")).alias("thread_id"))


@query("w04_top5_per_company_label", "SELECT company_id, ml_label, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, ml_label ORDER BY ts DESC, id DESC) AS rank FROM messages WHERE ml_label = 'rejection') WHERE rank <= 5")
def _(t):
    return top_per_key(t.messages.filter("ml_label = 'rejection'"), ["company_id", "ml_label"], [F.desc("ts"), F.desc("id")], 5).select("company_id", "ml_label", "id", "rank")


@query("w05_threads_with_nested_messages", "SELECT thread_id, array_to_string(list(CAST(id AS STRING) ORDER BY ts, id), ',') AS ids, max(ts) AS last_ts FROM messages GROUP BY 1 HAVING count(*) > 1 ORDER BY last_ts DESC, thread_id LIMIT 50")
def _(t):
    # the 50 threads are found by a narrow aggregate; only their messages are nested
    last = t.messages.groupBy("thread_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).filter("n > 1").orderBy(F.desc("last_ts"), "thread_id").limit(50)
    rows = t.messages.join(F.broadcast(last), "thread_id")  # 50 rows
    nested = rows.groupBy("thread_id", "last_ts").agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("m"))
    return nested.select("thread_id", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("ids"), "last_ts")


@query("w05_conversation_turns", "SELECT conv_id, count(*) AS turns, array_to_string(list(role ORDER BY turn), '>') AS roles FROM conversations GROUP BY 1 HAVING count(*) > 1")
def _(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles")).filter("turns > 1")


@query("w06_messages_by_subject", "SELECT subject, array_to_string(list(CAST(id AS STRING) ORDER BY thread_id, ts, id), ',') AS ids FROM messages WHERE company_id = 11 GROUP BY 1")
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("thread_id", "ts", "id")))
    return t.messages.filter("company_id = 11").groupBy("subject").agg(F.array_join(F.transform(rows, lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("w07_top_recent", "SELECT id, ts FROM messages ORDER BY ts DESC, id DESC LIMIT 100")
def _(t):
    return t.messages.orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "ts")


@query("w08_upcoming_events", "SELECT thread_id, interview_date, prescreen_date FROM threads WHERE (interview_date >= DATE '2001-08-01' OR prescreen_date >= DATE '2001-08-01') AND NOT interview_completed AND status NOT IN ('rejected', 'ghosted') ORDER BY interview_date ASC NULLS FIRST, prescreen_date ASC NULLS FIRST, thread_id LIMIT 10")
def _(t):
    soon = (F.col("interview_date") >= "2001-08-01") | (F.col("prescreen_date") >= "2001-08-01")
    rows = t.threads.filter(soon & ~F.col("interview_completed") & ~F.col("status").isin("rejected", "ghosted"))
    return rows.orderBy(F.asc_nulls_first("interview_date"), F.asc_nulls_first("prescreen_date"), "thread_id").limit(10).select("thread_id", "interview_date", "prescreen_date")


@query("w09_multi_key_sort", "SELECT id, row_number() OVER (ORDER BY ml_label DESC NULLS LAST, confidence ASC NULLS FIRST, id) AS place FROM messages")
def _(t):
    return placed(t.messages, [F.desc_nulls_last("ml_label"), F.asc_nulls_first("confidence"), F.asc("id")], ["id"])


@query("w10_case_insensitive_sort", "SELECT id, name, row_number() OVER (ORDER BY lower(name), id) AS place FROM companies")
def _(t):
    return placed(t.companies, [F.lower("name"), F.asc("id")], ["id", "name"])


@query("w11_page", "SELECT id FROM messages ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")
def _(t):
    return page(t.messages, [F.desc("ts"), F.desc("id")], 3, 50).select("id")


@query("w12_page_of_row", "SELECT CAST((SELECT count(*) FROM messages x WHERE x.ts > m.ts OR (x.ts = m.ts AND x.id > m.id)) // 50 + 1 AS BIGINT) AS page FROM messages m WHERE m.id = 500")
def _(t):
    # rows before a given one are counted; nothing is ranked
    one = F.broadcast(t.messages.filter("id = 500").select(F.col("ts").alias("t0"), F.col("id").alias("i0")).limit(1))
    before = t.messages.join(one, (F.col("ts") > F.col("t0")) | ((F.col("ts") == F.col("t0")) & (F.col("id") > F.col("i0"))))
    return before.agg((F.floor(F.count("*") / 50) + 1).alias("page"))


@query("w13_longest_body", "SELECT source, max_by(doc_id, (length(text), -doc_id)) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


@query("w14_canonical_pick", "WITH m AS (SELECT company_id, count(*) AS n FROM messages GROUP BY 1), t AS (SELECT company_id, count(*) AS n FROM threads GROUP BY 1) SELECT c.domain, max_by(c.id, (CAST(c.status = 'application' AS INT), coalesce(m.n, 0) + coalesce(t.n, 0), coalesce(m.n, 0), -c.id)) AS canonical FROM companies c LEFT JOIN m ON m.company_id = c.id LEFT JOIN t ON t.company_id = c.id WHERE c.status IS NOT NULL GROUP BY 1")
def _(t):
    m = t.messages.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("m"))
    r = t.threads.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("r"))
    rows = t.companies.filter("status IS NOT NULL").join(m, "id", "left").join(r, "id", "left").fillna(0, ["m", "r"])
    rank = F.struct((F.col("status") == "application").cast("int"), F.col("m") + F.col("r"), F.col("m"), -F.col("id"))
    return rows.groupBy("domain").agg(F.max_by("id", rank).alias("canonical"))


@query("w15_domain_table", "WITH used AS (SELECT lower(substr(replace(sender, '>', ''), strpos(sender, '@') + 1)) AS domain, count(*) AS n FROM messages GROUP BY 1), one AS (SELECT domain, min_by(kind, ord) AS kind FROM domains GROUP BY 1) SELECT domain, n, kind FROM used LEFT JOIN one USING (domain) ORDER BY coalesce(kind, 'zzz'), domain")
def _(t):
    used = t.messages.groupBy(F.lower(F.substring_index(F.replace("sender", F.lit(">"), F.lit("")), "@", -1)).alias("domain")).agg(F.count("*").alias("n"))
    kinds = t.domains.groupBy("domain").agg(F.min_by("kind", "ord").alias("kind"))
    return used.join(kinds, "domain", "left").orderBy(F.coalesce("kind", F.lit("zzz")), "domain").select("domain", "n", "kind")


@query("w16_recency_nulls_last", "SELECT id, last_job_search_date, row_number() OVER (ORDER BY last_job_search_date DESC NULLS LAST, id) AS place FROM companies")
def _(t):
    return placed(t.companies, [F.desc_nulls_last("last_job_search_date"), F.asc("id")], ["id", "last_job_search_date"])

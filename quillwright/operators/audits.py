"""Data-quality audits, repairs and mutations (M01-M24, K01-K24): a mutation gives the new snapshot of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sem import is_not
from ..functions.text import body_hash, email_domain
from ..registry import query


# ---------------------------------------------------------------- mutations as snapshots


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent, the first of each key, appended."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("x")).select("x.*")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of ``new`` replaces the table's."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("x")).select("x.*")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_cascade(parents: DataFrame, gone: DataFrame, children: list[tuple[DataFrame, str, bool]], key: str = "id") -> tuple[DataFrame, list[DataFrame]]:
    """Parents without ``gone``; children of each either go too or lose the key (``set_null``)."""
    out = []
    for table, column, set_null in children:
        ids = gone.select(F.col(key).alias(column)).distinct()
        if set_null:
            marked = table.join(ids.withColumn("__gone", F.lit(True)), column, "left")
            out.append(marked.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*table.columns))
        else:
            out.append(table.join(ids, column, "left_anti").select(*table.columns))
    return parents.join(gone.select(key), key, "left_anti"), out


@query("k02_insert_if_absent", "SELECT id, name FROM companies UNION ALL SELECT -1, 'New'")
def _(t):
    new = t.spark.createDataFrame([(1, "Taken"), (-1, "New"), (-1, "Newer")], "id bigint, name string")
    return insert_absent(t.companies.select("id", "name"), new, ["id"], ["name"])


@query("k03_k04_upsert", "SELECT id, name FROM companies WHERE id <> 1 UNION ALL SELECT * FROM (VALUES (1, 'Renamed'), (-1, 'Newer')) v(id, name)")
def _(t):
    new = t.spark.createDataFrame([(1, "Renamed", 1), (-1, "New", 1), (-1, "Newer", 2)], "id bigint, name string, run int")
    return upsert(t.companies.select("id", "name").withColumn("run", F.lit(0)), new, ["id"], ["run"]).select("id", "name")


@query("k05_bulk_update", "SELECT id, CASE WHEN confidence >= 0.85 AND ml_label IS DISTINCT FROM 'noise' THEN true ELSE reviewed END AS reviewed FROM messages")
def _(t):
    return update_where(t.messages, (F.col("confidence") >= 0.85) & is_not("ml_label", "noise"), reviewed=F.lit(True)).select("id", "reviewed")


@query("k07_counters_after_delete", "SELECT CAST(ts AS DATE) AS day, count(*) AS inserted FROM messages WHERE id % 13 <> 0 GROUP BY 1")
def _(t):
    # counters are derived from the rows, so a delete needs no decrement
    left = t.messages.join(t.messages.filter("id % 13 = 0").select("id"), "id", "left_anti")
    return left.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("inserted"))


@query("k08_delete_set_null", "SELECT m.id, CASE WHEN c.status = 'rejected' THEN NULL ELSE m.company_id END AS company_id FROM messages m LEFT JOIN companies c ON c.id = m.company_id")
def _(t):
    return delete_cascade(t.companies, t.companies.filter("status = 'rejected'"), [(t.messages, "company_id", True)])[1][0].select("id", "company_id")


@query("k08_delete_cascade", "SELECT thread_id FROM threads WHERE company_id NOT IN (SELECT id FROM companies WHERE status = 'rejected')")
def _(t):
    return delete_cascade(t.companies, t.companies.filter("status = 'rejected'"), [(t.threads, "company_id", False)])[1][0].select("thread_id")


@query("k09_threads_left_empty", "SELECT thread_id FROM messages GROUP BY 1 HAVING count(*) FILTER (id % 2 = 0) = 0")
def _(t):
    left = t.messages.filter("id % 2 = 0")
    return t.messages.select("thread_id").distinct().join(left, "thread_id", "left_anti")


@query("k20_dictionary_import", "SELECT alias AS name FROM nicknames UNION SELECT company FROM nicknames UNION SELECT company FROM firm_domains")
def _(t):
    names = t.nicknames.select(F.col("alias").alias("name")).union(t.nicknames.select("company")).union(t.firm_domains.select("company"))
    return names.distinct()


@query("k24_lead_list", "SELECT name, title FROM (SELECT c.name, t.job_title AS title, row_number() OVER (PARTITION BY c.name, t.job_title ORDER BY t.sent_date, t.thread_id) AS rn FROM threads t JOIN companies c ON c.id = t.company_id ) WHERE rn = 1")
def _(t):
    c = t.companies.select(F.col("id").alias("company_id"), "name")
    return t.threads.join(c, "company_id").groupBy("name", F.col("job_title").alias("title")).agg(F.min_by("thread_id", F.struct("sent_date", "thread_id"))).select("name", "title")


# ---------------------------------------------------------------- audits


@query("m01_thread_health", "WITH a AS (SELECT DISTINCT company_id FROM messages WHERE ml_label = 'job_application'), t AS (SELECT DISTINCT company_id FROM threads) SELECT (SELECT count(*) FROM a) AS applications, (SELECT count(*) FROM t) AS tracked, (SELECT count(*) FROM a WHERE company_id NOT IN (SELECT company_id FROM t)) AS missing")
def _(t):
    a = t.messages.filter("ml_label = 'job_application'").select("company_id").distinct().withColumn("a", F.lit(1))
    r = t.threads.select("company_id").distinct().withColumn("r", F.lit(1))
    return a.join(r, "company_id", "full_outer").agg(F.count("a").alias("applications"), F.count("r").alias("tracked"), F.count_if(F.col("r").isNull()).alias("missing"))


@query("m02_interview_audit", "WITH m AS (SELECT company_id, bool_or(ml_label = 'interview_invite') AS labelled FROM messages GROUP BY 1) SELECT t.thread_id, array_to_string(list_filter([CASE WHEN c.status = 'interview' THEN 'known_company' END, CASE WHEN t.interview_completed THEN 'completed' END, CASE WHEN m.labelled THEN 'labelled_message' END], lambda x: x IS NOT NULL), ',') AS keep FROM threads t LEFT JOIN companies c ON c.id = t.company_id LEFT JOIN m ON m.company_id = t.company_id WHERE t.interview_date IS NOT NULL")
def _(t):
    m = t.messages.groupBy("company_id").agg(F.bool_or(F.col("ml_label") == "interview_invite").alias("labelled"))
    c = t.companies.select(F.col("id").alias("company_id"), F.col("status").alias("company_status"))
    rows = t.threads.filter("interview_date IS NOT NULL").join(c, "company_id", "left").join(m, "company_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("company_status") == "interview", "known_company"), F.when(F.col("interview_completed"), "completed"), F.when(F.col("labelled"), "labelled_message")))
    return rows.select("thread_id", F.array_join(reasons, ",").alias("keep"))


@query("m03_company_validation", "SELECT count(*) FILTER (focus_area IS NULL OR trim(focus_area) = '') AS no_focus, count(*) FILTER (NOT regexp_matches(domain, '^[a-z0-9.-]+$')) AS bad_domain, count(*) FILTER (confidence IS NULL OR confidence < 0 OR confidence > 1) AS bad_confidence, count(*) FILTER (last_contact < first_contact) AS bad_dates, count(*) FILTER (status IS NULL) AS no_status FROM companies")
def _(t):
    c = F.col
    return t.companies.agg(
        F.count_if(c("focus_area").isNull() | (F.trim("focus_area") == "")).alias("no_focus"), F.count_if(~c("domain").rlike("^[a-z0-9.-]+$")).alias("bad_domain"),
        F.count_if(c("confidence").isNull() | ~c("confidence").between(0, 1)).alias("bad_confidence"), F.count_if(c("last_contact") < c("first_contact")).alias("bad_dates"), F.count_if(c("status").isNull()).alias("no_status"),
    )


@query("m04_headhunter_labels", r"SELECT id, 'head_hunter' AS label FROM messages WHERE ml_label IN ('job_application', 'interview_invite', 'rejection') AND regexp_matches(sender, '(?i)@(d3\.example\.com|d7\.example\.com)\b')")
def _(t):
    from .filters import domain_pattern

    hit = F.col("ml_label").isin("job_application", "interview_invite", "rejection") & F.col("sender").rlike(domain_pattern(["d3.example.com", "d7.example.com"]))
    return t.messages.filter(hit).select("id", F.lit("head_hunter").alias("label"))


@query("m05_headhunter_purge", "SELECT company_id, bool_and(ml_label IS NOT DISTINCT FROM 'noise' OR confidence < 0.99) AS safe FROM messages WHERE company_id IN (SELECT id FROM hh_companies) GROUP BY 1")
def _(t):
    rows = t.messages.join(t.hh_companies.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    return rows.groupBy("company_id").agg(F.bool_and(F.col("ml_label").eqNullSafe("noise") | (F.col("confidence") < 0.99)).alias("safe"))


@query("m07_newsletters", "SELECT id FROM messages WHERE contains(body, 'view') AND NOT regexp_matches(subject, 'Role [12]\\b')")
def _(t):
    return t.messages.filter(F.col("body").contains("view") & ~F.col("subject").rlike(r"Role [12]\b")).select("id")


@query("m11_high_confidence_review", "SELECT id, ml_label FROM messages WHERE ml_label IS NOT NULL AND confidence >= 0.8 AND NOT reviewed")
def _(t):
    return t.messages.filter(F.col("ml_label").isNotNull() & (F.col("confidence") >= 0.8) & ~F.col("reviewed")).select("id", "ml_label")


@query("m12_source_backfill", "SELECT id, CASE WHEN ml_label IS NULL THEN 'none' WHEN regexp_matches(body, 'purchase|signup') THEN 'rule' ELSE 'ml' END AS source FROM messages")
def _(t):
    source = F.when(F.col("ml_label").isNull(), "none").when(F.col("body").rlike("purchase|signup"), "rule").otherwise("ml")
    return t.messages.select("id", source.alias("source"))


@query("m13_hash_backfill", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS body_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", body_hash("text").alias("body_hash"))


@query("m14_personal_domains", "SELECT c.id, count(m.id) AS messages FROM companies c LEFT JOIN messages m ON m.company_id = c.id WHERE c.domain IN (SELECT domain FROM domains WHERE kind = 'personal') GROUP BY 1")
def _(t):
    personal = t.domains.filter("kind = 'personal'").select("domain")
    n = t.messages.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    rows = t.companies.join(F.broadcast(personal), "domain", "left_semi").join(n, "id", "left")
    return rows.select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("messages"))


@query("m15_noise_cleanup", "SELECT id, CASE WHEN ml_label = 'noise' AND reviewed THEN NULL ELSE company_id END AS company_id FROM messages")
def _(t):
    return update_where(t.messages, (F.col("ml_label") == "noise") & F.col("reviewed"), company_id=F.lit(None).cast("bigint")).select("id", "company_id")


@query("m16_missing_confirmation_report", "WITH x AS (SELECT company_id, count(*) FILTER (ml_label = 'rejection') AS r, count(*) FILTER (ml_label = 'job_application') AS a FROM messages GROUP BY 1 HAVING r > a), l AS (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY ts DESC, id DESC) AS rn FROM messages WHERE ml_label = 'rejection') SELECT x.company_id, x.r - x.a AS missing, array_to_string(list(CAST(l.id AS STRING) ORDER BY l.rn), ',') AS latest FROM x JOIN l ON l.company_id = x.company_id AND l.rn <= 5 GROUP BY ALL")
def _(t):
    label = F.col("ml_label")
    x = t.messages.groupBy("company_id").agg((F.count_if(label == "rejection") - F.count_if(label == "job_application")).alias("missing")).filter("missing > 0")
    ranked = t.messages.filter(label == "rejection").withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("ts"), F.desc("id")))).filter("rn <= 5")
    latest = ranked.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("l"))
    return x.join(latest, "company_id").select("company_id", "missing", F.array_join(F.transform("l", lambda r: r["id"].cast("string")), ",").alias("latest"))


@query("m17_parsing_metrics", "SELECT coalesce(company_source, 'none') AS source, count(*) AS n, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence >= 0.95) AS certain, count(DISTINCT company_id) AS companies FROM messages GROUP BY 1")
def _(t):
    c = F.col("confidence")
    return t.messages.groupBy(F.coalesce("company_source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count_if(c < 0.5).alias("low"), F.count_if(c >= 0.95).alias("certain"), F.count_distinct("company_id").alias("companies"))


@query("m18_job_titles", "SELECT DISTINCT job_title FROM threads WHERE company_id = 13 AND job_title <> ''")
def _(t):
    return t.threads.filter("company_id = 13 AND job_title <> ''").select("job_title").distinct()


@query("m21_majority_company", "WITH c AS (SELECT subject, company_id, count(*) AS n, min(ts) AS seen FROM messages GROUP BY 1, 2) SELECT subject, max_by(company_id, (n, -epoch_us(seen), -company_id)) AS company_id FROM c GROUP BY 1")
def _(t):
    c = t.messages.groupBy("subject", "company_id").agg(F.count("*").alias("n"), F.min("ts").alias("seen"))
    return c.groupBy("subject").agg(F.max_by("company_id", F.struct("n", -F.unix_micros("seen"), -F.col("company_id"))).alias("company_id"))


@query("m22_all_noise_companies", "SELECT company_id FROM history GROUP BY 1 HAVING bool_and(ml_label IS NOT DISTINCT FROM 'noise' OR coalesce(ml_label = 'other', false))")
def _(t):
    noise = F.bool_and(F.col("ml_label").eqNullSafe("noise") | F.coalesce(F.col("ml_label") == "other", F.lit(False)))
    return t.history.groupBy("company_id").agg(noise.alias("all_noise")).filter("all_noise").select("company_id")


@query("m23_backfill_dates", "WITH m AS (SELECT company_id, min(CASE WHEN ml_label = 'interview_invite' THEN CAST(ts AS DATE) END) AS i, max(CASE WHEN ml_label = 'rejection' THEN CAST(ts AS DATE) END) AS r FROM messages GROUP BY 1) SELECT thread_id, coalesce(interview_date, i) AS interview_date, coalesce(rejection_date, r) AS rejection_date FROM threads LEFT JOIN m USING (company_id)")
def _(t):
    label, day = F.col("ml_label"), F.to_date("ts")
    m = t.messages.groupBy("company_id").agg(F.min(F.when(label == "interview_invite", day)).alias("i"), F.max(F.when(label == "rejection", day)).alias("r"))
    return t.threads.join(m, "company_id", "left").select("thread_id", F.coalesce("interview_date", "i").alias("interview_date"), F.coalesce("rejection_date", "r").alias("rejection_date"))


@query("m24_old_new_predicates", "SELECT count(*) FILTER (status = 'ghosted') AS old, count(*) FILTER (status = 'ghosted' AND ml_label IS DISTINCT FROM 'noise') AS new FROM threads")
def _(t):
    old = F.col("status") == "ghosted"
    return t.threads.agg(F.count_if(old).alias("old"), F.count_if(old & is_not("ml_label", "noise")).alias("new"))


@query("m20_import_skip_existing", "SELECT id FROM messages WHERE id % 3 <> 0")
def _(t):
    return t.messages.join(t.messages.filter("id % 3 = 0").select("msg_id"), "msg_id", "left_anti").select("id")


@query("s03_t01_ledger", "SELECT msg_id FROM messages WHERE lower(sender) NOT LIKE '%@d3.%' AND id NOT IN (SELECT id FROM messages WHERE reviewed)")
def _(t):
    fresh = t.messages.join(t.messages.filter("reviewed").select("msg_id"), "msg_id", "left_anti")
    return fresh.filter(~email_domain("sender").startswith("d3.")).select("msg_id")

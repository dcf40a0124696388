"""Joins and subqueries (J01-J14, J19-J24). Existence is always a semi or anti join, never a distinct after a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sem import AS_OF, AS_OF_ORDERS
from ..registry import query


def without(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Rows of ``left`` with no partner; only the keys of ``right`` are shuffled."""
    return left.join(right.select(*on), list(on), "left_anti")


def having(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def _names(t):
    return t.companies.select(F.col("id").alias("company_id"), "name")


@query("j01_message_company_left", "SELECT m.id, c.name FROM messages m LEFT JOIN companies c ON c.id = m.company_id")
def _(t):
    return t.messages.join(_names(t), "company_id", "left").select("id", "name")


@query("j02_thread_company_inner", "SELECT t.thread_id, c.name, c.status FROM threads t JOIN companies c ON c.id = t.company_id WHERE c.status IS DISTINCT FROM 'headhunter'")
def _(t):
    c = t.companies.select(F.col("id").alias("company_id"), "name", F.col("status").alias("company_status"))
    return t.threads.join(c, "company_id").filter(~F.col("company_status").eqNullSafe("headhunter")).select("thread_id", "name", F.col("company_status").alias("status"))


@query("j03_companies_with_labelled_message", "SELECT c.id FROM companies c WHERE EXISTS (SELECT 1 FROM messages m WHERE m.company_id = c.id AND m.ml_label = 'noise' AND m.sender LIKE '%@d3.example.com%')")
def _(t):
    m = t.messages.filter((F.col("ml_label") == "noise") & F.col("sender").contains("@d3.example.com")).select(F.col("company_id").alias("id"))
    return having(t.companies, m, "id").select("id")


@query("j04_companies_with_threads", "SELECT id FROM companies WHERE id IN (SELECT company_id FROM threads)")
def _(t):
    return having(t.companies, t.threads.select(F.col("company_id").alias("id")), "id").select("id")


@query("j05_messages_of_id_list", "SELECT m.id FROM messages m WHERE m.company_id IN (SELECT id FROM companies WHERE status = 'interview')")
def _(t):
    return having(t.messages, t.companies.filter("status = 'interview'").select(F.col("id").alias("company_id")), "company_id").select("id")


@query("j06_threads_with_application", "SELECT DISTINCT m.thread_id FROM messages m WHERE EXISTS (SELECT 1 FROM messages a WHERE a.thread_id = m.thread_id AND a.ml_label = 'job_application')")
def _(t):
    return having(t.messages.select("thread_id").distinct(), t.messages.filter("ml_label = 'job_application'"), "thread_id")


@query("j07_existence_flags", "WITH a AS (SELECT DISTINCT company_id FROM messages WHERE ml_label = 'job_application'), r AS (SELECT DISTINCT company_id FROM messages WHERE ml_label = 'rejection' AND confidence > 0.95) SELECT c.id, a.company_id IS NOT NULL AS applied, r.company_id IS NOT NULL AS rejected FROM companies c LEFT JOIN a ON a.company_id = c.id LEFT JOIN r ON r.company_id = c.id WHERE a.company_id IS NOT NULL OR r.company_id IS NOT NULL OR c.id IN (1400, 1401)")
def _(t):
    def flag(label, name, least=-1.0):
        return t.messages.filter((F.col("ml_label") == label) & (F.col("confidence") > least)).select(F.col("company_id").alias("id")).distinct().withColumn(name, F.lit(True))

    joined = t.companies.join(flag("job_application", "a"), "id", "left").join(flag("rejection", "r", 0.95), "id", "left")
    out = joined.select("id", F.coalesce("a", F.lit(False)).alias("applied"), F.coalesce("r", F.lit(False)).alias("rejected"))
    return out.filter(F.col("applied") | F.col("rejected") | F.col("id").isin(1400, 1401))


@query("j08_companies_without_thread", "SELECT m.id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM threads t WHERE t.company_id = m.company_id AND t.status = 'ghosted')")
def _(t):
    return without(t.messages, t.threads.filter("status = 'ghosted'"), "company_id").select("id")


@query("j09_threads_without_messages", "SELECT thread_id FROM threads WHERE company_id NOT IN (SELECT company_id FROM messages WHERE company_id IS NOT NULL)")
def _(t):
    return without(t.threads, t.messages, "company_id").select("thread_id")


@query("j10_rejections_not_tracked", "SELECT m.id FROM messages m WHERE m.ml_label = 'rejection' AND NOT EXISTS (SELECT 1 FROM threads t WHERE t.company_id = m.company_id AND t.rejection_date IS NOT NULL)")
def _(t):
    return without(t.messages.filter("ml_label = 'rejection'"), t.threads.filter("rejection_date IS NOT NULL"), "company_id").select("id")


@query("j11_interviews_of_untracked_companies", "SELECT company_id, min(CAST(ts AS DATE)) AS first_interview FROM messages m WHERE ml_label = 'interview_invite' AND NOT EXISTS (SELECT 1 FROM threads t WHERE t.company_id = m.company_id AND t.interview_date < DATE '1998-01-01') GROUP BY 1")
def _(t):
    m = t.messages.filter("ml_label = 'interview_invite'")
    return without(m, t.threads.filter(F.col("interview_date") < "1998-01-01"), "company_id").groupBy("company_id").agg(F.min(F.to_date("ts")).alias("first_interview"))


@query("j12_empty_companies", "SELECT id FROM companies WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.company_id = companies.id) AND NOT EXISTS (SELECT 1 FROM threads t WHERE t.company_id = companies.id AND t.status <> 'application') AND last_contact < DATE '2024-01-24'")
def _(t):
    key = F.col("company_id").alias("id")
    old = t.companies.filter(F.col("last_contact") < "2024-01-24")
    return without(without(old, t.messages.select(key), "id"), t.threads.filter("status <> 'application'").select(key), "id").select("id")


@query("j13_orphan_keys", "SELECT count(*) AS orphans, count(DISTINCT company_id) AS companies FROM messages m WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.id = m.company_id AND c.status IS NOT NULL)")
def _(t):
    known = t.companies.filter("status IS NOT NULL").select(F.col("id").alias("company_id"))
    return without(t.messages, known, "company_id").agg(F.count("*").alias("orphans"), F.count_distinct("company_id").alias("companies"))


@query("j14_raw_inner_join", "SELECT t.thread_id, m.n FROM threads t JOIN (SELECT company_id, count(*) AS n FROM messages GROUP BY 1) m ON m.company_id = t.company_id WHERE t.job_id = 'J7'")
def _(t):
    n = t.messages.groupBy("company_id").agg(F.count("*").alias("n"))
    return t.threads.filter("job_id = 'J7'").join(n, "company_id").select("thread_id", "n")


def band_pairs(rows: DataFrame, keys: list[str], ts: str, seconds: int, row: str = "id") -> DataFrame:
    """Pairs of rows with equal keys at most ``seconds`` apart, by equi-join on neighbouring time buckets.

    A bucket is as wide as the band, so a row meets two buckets of the other side and no pair is met twice.
    """
    at = F.unix_timestamp(ts)
    left = rows.select(*keys, F.col(row).alias("a"), at.alias("ta")).withColumn("bucket", F.floor(F.col("ta") / seconds))
    right = rows.select(*keys, F.col(row).alias("b"), at.alias("tb")).withColumn("bucket", F.explode(F.array(F.floor(F.col("tb") / seconds), F.floor(F.col("tb") / seconds) - 1)))
    later = (F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") > F.col("a")))
    return left.join(right, [*keys, "bucket"]).filter(later & (F.col("tb") - F.col("ta") <= seconds)).select(*keys, "a", "b", (F.col("tb") - F.col("ta")).alias("gap"))


@query("j19_band_self_join", "SELECT x.sender, x.id AS a, y.id AS b, CAST(floor(epoch(y.ts)) - floor(epoch(x.ts)) AS BIGINT) AS gap FROM messages x JOIN messages y ON x.sender = y.sender AND x.ml_label = y.ml_label AND (floor(epoch(y.ts)) > floor(epoch(x.ts)) OR (floor(epoch(y.ts)) = floor(epoch(x.ts)) AND y.id > x.id)) AND floor(epoch(y.ts)) - floor(epoch(x.ts)) <= 600")
def _(t):
    return band_pairs(t.messages.filter("ml_label IS NOT NULL"), ["sender", "ml_label"], "ts", 600).select("sender", "a", "b", F.col("gap").cast("bigint").alias("gap"))


@query("j20_within_validity", f"WITH last AS (SELECT company_id, max(sent_date) AS applied FROM threads WHERE status = 'application' GROUP BY 1) SELECT t.thread_id FROM threads t JOIN last l USING (company_id) WHERE t.sent_date BETWEEN l.applied - INTERVAL 365 DAY AND l.applied AND t.sent_date <= DATE '{AS_OF_ORDERS}'")
def _(t):
    last = t.threads.filter("status = 'application'").groupBy("company_id").agg(F.max("sent_date").alias("applied"))
    near = F.col("sent_date").between(F.date_sub("applied", 365), F.col("applied")) & (F.col("sent_date") <= F.lit(AS_OF_ORDERS).cast("date"))
    return t.threads.join(last, "company_id").filter(near).select("thread_id")


@query("j21_mixed_equality_fallbacks", "WITH asked AS (SELECT DISTINCT substr(subject, strpos(subject, 'Firm ')) AS name FROM messages), byalias AS (SELECT lower(alias) AS k, min_by(company, ord) AS company FROM aliases GROUP BY 1), norm AS (SELECT lower(trim(regexp_replace(regexp_replace(alias, '[,.]', '', 'g'), '\\s+', ' ', 'g'))) AS k, min_by(company, ord) AS company FROM aliases GROUP BY 1) SELECT name, coalesce(b.company, n.company, 'new: ' || name) AS resolved FROM asked LEFT JOIN byalias b ON b.k = lower(name) LEFT JOIN norm n ON n.k = lower(trim(name))".replace("\\\\", "\\"))
def _(t):
    from ..functions.text import matching_key

    asked = t.messages.select(F.expr("substr(subject, locate('Firm ', subject))").alias("name")).distinct()
    exact = t.aliases.groupBy(F.lower("alias").alias("ke")).agg(F.min_by("company", "ord").alias("by_name"))
    loose = t.aliases.groupBy(matching_key("alias").alias("kn")).agg(F.min_by("company", "ord").alias("by_key"))
    joined = asked.join(exact, F.lower("name") == F.col("ke"), "left").join(loose, matching_key("name") == F.col("kn"), "left")
    return joined.select("name", F.coalesce("by_name", "by_key", F.concat(F.lit("new: "), "name")).alias("resolved"))


@query("j22_dictionary_lookup", "SELECT c.id, d.company AS dictionary_name FROM companies c LEFT JOIN domains d ON d.domain = c.domain AND d.kind = 'company'")
def _(t):
    # the dictionary is one of the engine's own, of fixed size
    d = t.domains.filter("kind = 'company'").select("domain", F.col("company").alias("dictionary_name"))
    return t.companies.join(F.broadcast(d), "domain", "left").select("id", "dictionary_name")


@query("j23_shortest_domain", "SELECT lower(company) AS company, min_by(domain, (length(domain), ord)) AS domain FROM firm_domains GROUP BY 1")
def _(t):
    return t.firm_domains.groupBy(F.lower("company").alias("company")).agg(F.min_by("domain", F.struct(F.length("domain"), "ord")).alias("domain"))


@query("j24_all_aliases", "SELECT company, string_agg(alias, ', ' ORDER BY ord) AS aliases FROM nicknames GROUP BY 1")
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("ord", "alias")))
    return t.nicknames.groupBy("company").agg(F.array_join(F.transform(rows, lambda r: r["alias"]), ", ").alias("aliases"))


@query("k22_search_recency_flag", f"SELECT id, last_job_search_date IS NOT NULL AND date_diff('day', last_job_search_date, CAST(TIMESTAMP '{AS_OF}' AS DATE)) <= 7 AS recent FROM companies")
def _(t):
    recent = F.datediff(F.to_date(F.lit(AS_OF)), "last_job_search_date") <= 7
    return t.companies.select("id", F.coalesce(recent, F.lit(False)).alias("recent"))

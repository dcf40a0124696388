"""Aggregations, calendars and KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sem import AS_OF, LOCAL_ZONE, is_not, local_date
from ..registry import query


def daily(rows: DataFrame, day: Column) -> DataFrame:
    """Rows a day."""
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def gap_filled(series: DataFrame, day: str = "day", value: str = "n", until: str | None = None, since: str | None = None) -> DataFrame:
    """A value for every day from the first to the last (or given ones), 0 where there is none; empty for no day.

    The calendar is as long as the range of days, whatever the number of rows.
    """
    first = F.lit(since).cast("date") if since else F.min(day)
    last = F.lit(until).cast("date") if until else F.max(day)
    bounds = series.agg(first.alias("lo"), last.alias("hi")).filter("lo <= hi")
    calendar = bounds.select(F.explode(F.sequence("lo", "hi")).alias(day))
    return calendar.join(series, day, "left").select(day, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def conditional_counts(**conditions: Column) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


@query("a01_a02_counts", "SELECT count(*) AS n, count(DISTINCT thread_id) AS threads, count(DISTINCT company_id) AS companies FROM messages")
def _(t):
    return t.messages.agg(F.count("*").alias("n"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("company_id").alias("companies"))


@query("a03_group_count", "SELECT ml_label, count(*) AS n FROM messages GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    return t.messages.groupBy("ml_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ml_label")


@query("a04_label_share", "SELECT coalesce(ml_label, 'unknown') AS label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM messages GROUP BY 1")
def _(t):
    n = t.messages.groupBy(F.coalesce("ml_label", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # over one row for each label


@query("a05_conditional_counts", "SELECT c.id, count(*) FILTER (m.ml_label = 'rejection') AS rejections, count(*) FILTER (m.ml_label = 'job_application') AS applications, count(*) FILTER (m.ml_label = 'interview_invite') AS interviews FROM companies c JOIN messages m ON m.company_id = c.id GROUP BY 1 HAVING rejections > applications")
def _(t):
    label = F.col("ml_label")
    counted = t.messages.groupBy(F.col("company_id").alias("id")).agg(*conditional_counts(rejections=label == "rejection", applications=label == "job_application", interviews=label == "interview_invite"))
    return counted.filter("rejections > applications").join(t.companies.select("id"), "id", "left_semi")


@query("a06_children_per_parent", "SELECT c.id, count(t.thread_id) AS threads FROM companies c LEFT JOIN threads t ON t.company_id = c.id GROUP BY 1")
def _(t):
    n = t.threads.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return t.companies.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("threads"))


@query("a07_earliest_of_columns", "SELECT min(sent_date) AS sent, min(rejection_date) AS rejected, min(interview_date) AS interviewed, least(min(sent_date), min(rejection_date), min(interview_date)) AS earliest FROM threads")
def _(t):
    low = t.threads.agg(F.min("sent_date").alias("sent"), F.min("rejection_date").alias("rejected"), F.min("interview_date").alias("interviewed"))
    return low.withColumn("earliest", F.least("sent", "rejected", "interviewed"))


@query("a08_last_activity", "SELECT company_id, max(ts) AS last_ts FROM messages GROUP BY 1")
def _(t):
    return t.messages.groupBy("company_id").agg(F.max("ts").alias("last_ts"))


@query("a09_label_statistics", "SELECT ml_label, count(*) AS n, round(avg(confidence), 9) AS mean, min(confidence) AS low, max(confidence) AS high FROM messages GROUP BY 1")
def _(t):
    return t.messages.groupBy("ml_label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


@query("a10_daily_local", f"SELECT CAST(timezone('{LOCAL_ZONE}', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM messages GROUP BY 1")
def _(t):
    return daily(t.messages, local_date("ts"))


@query("a11_daily_utc", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM messages WHERE ml_label = 'interview_invite' GROUP BY 1")
def _(t):
    return daily(t.messages.filter("ml_label = 'interview_invite'"), F.to_date("ts"))


@query("a12_daily_on_date_column", "SELECT rejection_date AS day, count(*) AS n FROM threads WHERE rejection_date IS NOT NULL GROUP BY 1")
def _(t):
    return daily(t.threads.filter("rejection_date IS NOT NULL"), F.col("rejection_date"))


_DENSE = "WITH kept AS (SELECT * FROM messages WHERE ml_label = 'job_application' AND company_id NOT IN (SELECT id FROM hh_companies)), days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM kept GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM days), DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT cal.day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM cal LEFT JOIN days USING (day)"


@query("a13_daily_applications_dense", _DENSE)
def daily_applications(t):
    """The flagship: daily applications without head-hunters, on a dense calendar up to the as-of date."""
    kept = t.messages.filter("ml_label = 'job_application'").join(t.hh_companies.select(F.col("id").alias("company_id")), "company_id", "left_anti")
    return gap_filled(daily(kept, F.to_date("ts")), until=AS_OF[:10])


@query("a14_sum_of_series", "SELECT day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT rejection_date AS day, count(*) AS n FROM threads WHERE rejection_date IS NOT NULL GROUP BY 1 UNION ALL SELECT interview_date, count(*) FROM threads WHERE interview_date IS NOT NULL GROUP BY 1) GROUP BY 1")
def _(t):
    both = t.threads.select("rejection_date").union(t.threads.select("interview_date")).toDF("day").filter("day IS NOT NULL")
    return daily(both, F.col("day"))


@query("a15_response_rate", "SELECT coalesce(100.0 * count(*) FILTER (rejection_date IS NOT NULL OR interview_date IS NOT NULL) / count(*), 0)::DOUBLE AS rate FROM threads WHERE status <> 'ghosted'")
def _(t):
    answered = F.count_if(F.col("rejection_date").isNotNull() | F.col("interview_date").isNotNull())
    return t.threads.filter("status <> 'ghosted'").agg(F.coalesce(100.0 * answered / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("rate"))


@query("a16_days_to_first_response", "WITH r AS (SELECT sent_date, least(CASE WHEN rejection_date > sent_date THEN rejection_date END, CASE WHEN interview_date > sent_date THEN interview_date END, CASE WHEN prescreen_date > sent_date THEN prescreen_date END) AS first FROM threads) SELECT count(first) AS answered, avg(date_diff('day', sent_date, first)) AS mean_days FROM r")
def _(t):
    later = F.filter(F.array("rejection_date", "interview_date", "prescreen_date"), lambda d: d > F.col("sent_date"))
    first = t.threads.select("sent_date", F.array_min(later).alias("first"))
    return first.agg(F.count("first").alias("answered"), F.avg(F.datediff("first", "sent_date")).alias("mean_days"))


@query("a17_earliest_per_company", "SELECT company_id, min(interview_date) AS first_interview, min_by(thread_id, (interview_date, thread_id)) FILTER (interview_date IS NOT NULL) AS thread_id FROM threads WHERE interview_date IS NOT NULL GROUP BY 1")
def _(t):
    return t.threads.filter("interview_date IS NOT NULL").groupBy("company_id").agg(F.min("interview_date").alias("first_interview"), F.min_by("thread_id", F.struct("interview_date", "thread_id")).alias("thread_id"))


@query("a18_first_row_per_company", "SELECT company_id, name, thread_id FROM (SELECT t.company_id, c.name, t.thread_id, row_number() OVER (PARTITION BY t.company_id ORDER BY t.sent_date DESC, t.thread_id) AS rn FROM threads t JOIN companies c ON c.id = t.company_id WHERE t.status = 'rejected') WHERE rn = 1")
def _(t):
    # a combined aggregate instead of a window: the first by (latest date, least id) needs no sort of whole groups
    rejected = t.threads.filter("status = 'rejected'")
    first = rejected.groupBy("company_id").agg(F.min_by("thread_id", F.struct(-F.unix_date("sent_date"), "thread_id")).alias("thread_id"))
    return first.join(t.companies.select(F.col("id").alias("company_id"), "name"), "company_id").select("company_id", "name", "thread_id")


@query("a19_phrase_frequency", "SELECT min_by(trim(focus_area), id) AS phrase, count(*) AS n FROM companies WHERE nullif(trim(focus_area), '') IS NOT NULL GROUP BY lower(trim(focus_area)) ORDER BY n DESC, phrase LIMIT 50")
def _(t):
    named = t.companies.select("id", F.trim("focus_area").alias("p")).filter("p <> ''")
    return named.groupBy(F.lower("p").alias("k")).agg(F.min_by("p", "id").alias("phrase"), F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(50).select("phrase", "n")


BINS = [0.0, 0.5, 0.75, 0.85, 0.95, 1.01]


def histogram_bin(c: str, bins: list[float] = BINS) -> Column:
    """Index of the half-open bin that holds a value; null outside all bins."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(bins, bins[1:], strict=False)):
        out = F.when((F.col(c) >= lo) & (F.col(c) < hi), i).otherwise(out)
    return out


@query("a20_histogram", "SELECT CASE WHEN confidence < 0.5 THEN 0 WHEN confidence < 0.75 THEN 1 WHEN confidence < 0.85 THEN 2 WHEN confidence < 0.95 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM messages GROUP BY 1")
def _(t):
    return t.messages.groupBy(histogram_bin("confidence").alias("bin")).agg(F.count("*").alias("n"))


@query("a21_provenance_counts", "SELECT coalesce(company_source, 'none') AS source, count(*) AS n FROM messages GROUP BY 1")
def _(t):
    return t.messages.groupBy(F.coalesce("company_source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


@query("a22_top_companies", "SELECT company_id, count(*) AS n FROM messages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return t.messages.groupBy("company_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company_id").limit(10)


@query("a23_domain_frequency_samples", "SELECT domain, count(*) AS n, array_to_string(list_sort(list(DISTINCT substr(sender, 1, 50)))[1:3], '|') AS samples FROM (SELECT lower(substr(replace(sender, '>', ''), strpos(sender, '@') + 1)) AS domain, sender FROM messages) GROUP BY 1")
def _(t):
    domain = F.lower(F.substring_index(F.replace("sender", F.lit(">"), F.lit("")), "@", -1))
    # distinct senders first, so that a frequent domain's list is as short as its senders are few
    senders = t.messages.groupBy(domain.alias("domain"), F.substring("sender", 1, 50).alias("s")).agg(F.count("*").alias("c"))
    ranked = senders.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("s")))
    return ranked.groupBy("domain").agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("s")))), "|").alias("samples"))


def _audited(t):
    return t.messages.select(F.coalesce("ml_label", F.lit("none")).alias("truth"), F.when(F.col("id") % 7 == 0, "other").otherwise(F.coalesce("ml_label", F.lit("none"))).alias("pred"))


_AUDITED = "(SELECT coalesce(ml_label, 'none') AS truth, CASE WHEN id % 7 = 0 THEN 'other' ELSE coalesce(ml_label, 'none') END AS pred FROM messages)"


@query("a24_accuracy_confusion", f"SELECT truth, pred, count(*) AS n FROM {_AUDITED} WHERE truth <> pred GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def _(t):
    return _audited(t).filter("truth <> pred").groupBy("truth", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "pred").limit(20)


def per_label_metrics(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each label, from the confusion table alone."""
    table = rows.groupBy(truth, pred).agg(F.count("*").alias("c"))
    hit = F.when(F.col(truth) == F.col(pred), F.col("c")).otherwise(0)
    p = table.groupBy(F.col(pred).alias("label")).agg(F.sum("c").alias("said"), F.sum(hit).alias("tp"))
    r = table.groupBy(F.col(truth).alias("label")).agg(F.sum("c").alias("support"))
    both = p.join(r, "label", "full_outer").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return both.select("label", ratio(c("tp"), c("said")).alias("precision"), ratio(c("tp"), c("support")).alias("recall"), ratio(2 * c("tp"), c("said") + c("support")).alias("f1"), c("support").alias("support"))


@query("a25_precision_recall", f"WITH x AS {_AUDITED}, l AS (SELECT DISTINCT truth AS label FROM x UNION SELECT DISTINCT pred FROM x), s AS (SELECT label, (SELECT count(*) FROM x WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM x WHERE pred = label) AS said, (SELECT count(*) FROM x WHERE truth = label) AS support FROM l) SELECT label, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN said + support > 0 THEN 2 * tp / (said + support) ELSE 0 END AS f1, support FROM s")
def _(t):
    return per_label_metrics(_audited(t))


@query("a26_disagreement_grouping_sets", f"SELECT truth AS old_label, pred AS new_label, count(*) AS n FROM {_AUDITED} WHERE truth <> pred GROUP BY GROUPING SETS ((truth, pred), (truth), (pred))")
def _(t):
    rows = _audited(t).filter("truth <> pred")
    return rows.groupingSets([["truth", "pred"], ["truth"], ["pred"]], "truth", "pred").agg(F.count("*").alias("n")).toDF("old_label", "new_label", "n")


@query("a27_reconciliation", "WITH m AS (SELECT company_id, count(DISTINCT thread_id) AS n FROM messages GROUP BY 1), t AS (SELECT company_id, count(*) AS n FROM threads GROUP BY 1) SELECT coalesce(m.company_id, t.company_id) AS company_id, coalesce(m.n, 0) AS message_threads, coalesce(t.n, 0) AS thread_rows FROM m FULL JOIN t ON m.company_id = t.company_id WHERE coalesce(m.n, 0) <> coalesce(t.n, 0)")
def _(t):
    m = t.messages.groupBy("company_id").agg(F.count_distinct("thread_id").alias("message_threads"))
    r = t.threads.groupBy("company_id").agg(F.count("*").alias("thread_rows"))
    return m.join(r, "company_id", "full_outer").fillna(0, ["message_threads", "thread_rows"]).filter("message_threads <> thread_rows")


@query("a28_delta_counts_with_examples", f"SELECT subject, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM (SELECT substr(subject, 1, 120) AS subject, id, ml_label, CASE WHEN id % 7 = 0 THEN 'other' ELSE ml_label END AS pred FROM messages) WHERE ml_label IS DISTINCT FROM pred GROUP BY 1")
def _(t):
    changed = t.messages.withColumn("pred", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("ml_label"))).filter(~F.col("ml_label").eqNullSafe(F.col("pred")))
    ranked = changed.select(F.substring("subject", 1, 120).alias("subject"), "id").withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy("id")))
    return ranked.groupBy("subject").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("id")))).cast("array<string>"), ",").alias("examples"))


@query("a29_duplicate_keys", "SELECT lower(domain) AS k, count(*) AS n, count(DISTINCT name) AS names FROM companies GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.companies.groupBy(F.lower("domain").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names")).filter("n > 1")


@query("a30_dominant_value", "WITH latest AS (SELECT company_id, ml_label, row_number() OVER (PARTITION BY company_id ORDER BY ts DESC, id DESC) AS rn FROM messages WHERE ml_label IS NOT NULL), c AS (SELECT company_id, ml_label, count(*) AS n FROM latest WHERE rn <= 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, ml_label) AS k FROM c) SELECT a.company_id, a.ml_label AS dominant, a.n FROM r a LEFT JOIN r b ON b.company_id = a.company_id AND b.k = 2 WHERE a.k = 1 AND coalesce(b.n, 0) <= 1")
def _(t):
    recent = t.messages.filter("ml_label IS NOT NULL").withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("ts"), F.desc("id")))).filter("rn <= 5")
    n = recent.groupBy("company_id", "ml_label").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "ml_label")))
    best = n.groupBy("company_id").agg(ranked.alias("r"))
    second = F.coalesce(-F.get("r", F.lit(1))["neg"], F.lit(0))
    return best.filter(second <= 1).select("company_id", F.get("r", F.lit(0))["ml_label"].alias("dominant"), (-F.get("r", F.lit(0))["neg"]).alias("n"))


@query("a31_search_recency_kpis", "SELECT count(last_job_search_date) AS searched, count(*) FILTER (last_job_search_date IS NULL) AS never, count(*) FILTER (last_job_search_date = DATE '2024-01-31') AS today, count(*) FILTER (last_job_search_date > DATE '2024-01-24') AS week, count(*) FILTER (last_job_search_date > DATE '2024-01-01') AS month FROM companies")
def _(t):
    d = F.col("last_job_search_date")
    return t.companies.agg(F.count(d).alias("searched"), *conditional_counts(never=d.isNull(), today=d == F.lit("2024-01-31").cast("date"), week=d > "2024-01-24", month=d > "2024-01-01"))


@query("a32_domain_category_totals", "WITH used AS (SELECT DISTINCT lower(substr(replace(sender, '>', ''), strpos(sender, '@') + 1)) AS domain FROM messages), one AS (SELECT domain, min_by(kind, ord) AS kind FROM domains GROUP BY 1) SELECT coalesce(o.kind, 'unlabelled') AS kind, count(*) AS n FROM used u LEFT JOIN one o USING (domain) GROUP BY 1")
def _(t):
    used = t.messages.select(F.lower(F.substring_index(F.replace("sender", F.lit(">"), F.lit("")), "@", -1)).alias("domain")).distinct()
    kinds = t.domains.groupBy("domain").agg(F.min_by("kind", "ord").alias("kind"))
    return used.join(kinds, "domain", "left").groupBy(F.coalesce("kind", F.lit("unlabelled")).alias("kind")).agg(F.count("*").alias("n"))


@query("a33_company_statistics", "SELECT count(*) AS total, count(*) FILTER (id IN (SELECT company_id FROM threads)) AS with_threads, count(*) FILTER (status = 'application') AS applications, count(*) FILTER (status IS NULL) AS without_status FROM companies")
def _(t):
    owners = t.threads.select(F.col("company_id").alias("id")).distinct().withColumn("has", F.lit(True))
    status = F.col("status")
    return t.companies.join(owners, "id", "left").agg(F.count("*").alias("total"), *conditional_counts(with_threads=F.col("has").isNotNull(), applications=status == "application", without_status=status.isNull()))


@query("a34_k06_run_counters", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (o = 'inserted') AS inserted, count(*) FILTER (o = 'ignored') AS ignored, count(*) FILTER (o = 'skipped') AS skipped FROM (SELECT ts, CASE WHEN ml_label = 'noise' THEN 'ignored' WHEN ml_label IS NULL THEN 'skipped' ELSE 'inserted' END AS o FROM messages) GROUP BY 1")
def _(t):
    outcome = F.when(F.col("ml_label") == "noise", "ignored").when(F.col("ml_label").isNull(), "skipped").otherwise("inserted")
    return t.messages.withColumn("o", outcome).groupBy(F.to_date("ts").alias("day")).pivot("o", ["inserted", "ignored", "skipped"]).count().fillna(0)


@query("a35_missing_confirmations", "WITH x AS (SELECT company_id, count(*) FILTER (ml_label = 'rejection') AS r, count(*) FILTER (ml_label = 'job_application') AS a FROM messages GROUP BY 1) SELECT count(*) AS companies, CAST(coalesce(sum(r - a), 0) AS BIGINT) AS missing FROM x WHERE r > a")
def _(t):
    label = F.col("ml_label")
    x = t.messages.groupBy("company_id").agg(*conditional_counts(r=label == "rejection", a=label == "job_application")).filter("r > a")
    return x.agg(F.count("*").alias("companies"), F.coalesce(F.sum(F.col("r") - F.col("a")), F.lit(0)).alias("missing"))


@query("t03_week_kpi", "SELECT count(*) AS n, count(DISTINCT company_id) AS companies FROM messages WHERE ml_label = 'job_application' AND ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31' AND company_id NOT IN (SELECT id FROM hh_companies)")
def applications_last_week(t):
    """Messages, and distinct companies, of the last seven days before the as-of instant."""
    now = F.lit(AS_OF).cast("timestamp")
    week = t.messages.filter((F.col("ml_label") == "job_application") & F.col("ts").between(now - F.expr("INTERVAL 7 DAYS"), now))
    kept = week.join(t.hh_companies.select(F.col("id").alias("company_id")), "company_id", "left_anti").filter(is_not("ml_label", "noise"))
    return kept.agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"))

"""Projections, predicates and parameterised filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sem import LOCAL_ZONE, any_of, blank_to_null, icontains, iendswith, iequals, is_not, local_date
from ..registry import query

CONFIDENCE_BANDS = {"low": (None, 0.5), "medium": (0.5, 0.75), "high": (0.75, None)}


def confidence_band(c: str = "confidence") -> Column:
    """Low (null or under 0.5), medium (to under 0.75), high."""
    return F.when(F.col(c).isNull() | (F.col(c) < 0.5), "low").when(F.col(c) < 0.75, "medium").otherwise("high")


def message_filter(messages: DataFrame, *, reviewed: bool | None = None, label: str | None = None, band: str | None = None, company_id: int | None = None, search: str | None = None, hide_noise: bool = False, since: str | None = None) -> DataFrame:
    """Facets compose; a facet that isn't given does not filter."""
    out = messages
    if reviewed is not None:
        out = out.filter(F.col("reviewed") == reviewed)
    if label is not None:
        out = out.filter(iequals("ml_label", label))
    if band is not None:
        out = out.filter(confidence_band() == band)
    if company_id is not None:
        out = out.filter(F.col("company_id") == company_id)
    if search:
        out = out.filter(any_of(*(icontains(c, search) for c in ("subject", "body", "sender"))))
    if hide_noise:
        out = out.filter(is_not("ml_label", "noise"))
    if since:
        out = out.filter(F.to_date("ts") >= F.lit(since).cast("date"))
    return out


@query("s01_p01_scan_projection", "SELECT id, msg_id, ts FROM messages")
def _(t):
    return t.messages.select("id", "msg_id", "ts")


@query("p02_equality_in_not_in", "SELECT id, ml_label FROM messages WHERE ml_label IN ('rejection', 'noise') AND company_id NOT IN (1, 2, 3)")
def _(t):
    return t.messages.filter(F.col("ml_label").isin("rejection", "noise") & ~F.col("company_id").isin(1, 2, 3)).select("id", "ml_label")


@query("p02_null_safe_exclude", "SELECT id, ml_label FROM messages WHERE ml_label IS DISTINCT FROM 'noise'")
def _(t):
    return t.messages.filter(is_not("ml_label", "noise")).select("id", "ml_label")


@query("p03_ranges", "SELECT id FROM messages WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND confidence > 0.25 AND confidence <= 0.9")
def _(t):
    return t.messages.filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp")) & (F.col("confidence") > 0.25) & (F.col("confidence") <= 0.9)).select("id")


@query("p04_is_null", "SELECT thread_id, rejection_date IS NULL AS open FROM threads WHERE interview_date IS NOT NULL")
def _(t):
    return t.threads.filter(F.col("interview_date").isNotNull()).select("thread_id", F.col("rejection_date").isNull().alias("open"))


@query("p05_case_insensitive_text", "SELECT id, lower(subject) LIKE '%firm 3' AS ends, lower(body) = 'dear user, click number 1' AS equals FROM messages WHERE lower(subject) LIKE '%role 2%'")
def _(t):
    return t.messages.filter(icontains("subject", "ROLE 2")).select("id", iendswith("subject", "FIRM 3").alias("ends"), iequals("body", "Dear User, Click number 1").alias("equals"))


def domain_pattern(domains: list[str]) -> str:
    """One case-insensitive pattern for addresses in any of the domains."""
    return "(?iU)@(" + "|".join(d.replace(".", r"\.") for d in domains) + r")\b"


@query("p06_domain_regex", r"SELECT id, sender FROM messages WHERE regexp_matches(sender, '(?i)@(d3\.example\.com|d7\.example\.com)\b')")
def _(t):
    return t.messages.filter(F.col("sender").rlike(domain_pattern(["d3.example.com", "d7.example.com"]))).select("id", "sender")


@query("p07_dictionary_or_tree", "SELECT m.id FROM messages m WHERE EXISTS (SELECT 1 FROM domains d WHERE d.kind = 'headhunter' AND contains(lower(m.sender), '@' || d.domain))")
def _(t):
    # the dictionary is one array, found once; for large dictionaries see the suffix join of operators.resolve
    heads = t.domains.filter("kind = 'headhunter'").agg(F.collect_list("domain")).scalar()
    rows = t.messages.select("id", F.lower("sender").alias("sender"), heads.alias("heads"))
    return rows.filter(F.exists("heads", lambda d: F.contains("sender", F.concat(F.lit("@"), d)))).select("id")


@query("p08_boolean_nesting", "SELECT thread_id FROM threads WHERE (status = 'application' OR status = 'ghosted') AND NOT (interview_completed AND reviewed) AND (rejection_date IS NULL OR rejection_date > sent_date)")
def _(t):
    c = F.col
    return t.threads.filter(c("status").isin("application", "ghosted") & ~(c("interview_completed") & c("reviewed")) & (c("rejection_date").isNull() | (c("rejection_date") > c("sent_date")))).select("thread_id")


@query("p09_multi_column_search", "SELECT id FROM messages WHERE contains(lower(subject), 'firm 17') OR contains(lower(body), 'purchase number 9') OR contains(lower(sender), 'u42@')")
def _(t):
    return t.messages.filter(any_of(icontains("subject", "Firm 17"), icontains("body", "Purchase number 9"), icontains("sender", "U42@"))).select("id")


@query("p10_local_date_predicate", f"SELECT id, CAST(timezone('{LOCAL_ZONE}', timezone('UTC', ts)) AS DATE) AS day FROM messages WHERE CAST(timezone('{LOCAL_ZONE}', timezone('UTC', ts)) AS DATE) >= DATE '2024-01-28'")
def _(t):
    return t.messages.filter(local_date("ts") >= F.lit("2024-01-28").cast("date")).select("id", local_date("ts").alias("day"))


@query("p11_confidence_bands", "SELECT CASE WHEN confidence IS NULL OR confidence < 0.5 THEN 'low' WHEN confidence < 0.75 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM messages GROUP BY 1")
def _(t):
    return t.messages.groupBy(confidence_band().alias("band")).agg(F.count("*").alias("n"))


@query("p12_faceted_filter", "SELECT id FROM messages WHERE NOT reviewed AND confidence >= 0.75 AND contains(lower(subject), 'role') AND ml_label IS DISTINCT FROM 'noise'")
def _(t):
    return message_filter(t.messages, reviewed=False, band="high", search="role", hide_noise=True).select("id")


@query("p13_message_list", "SELECT id, subject FROM messages WHERE company_id = 7 AND lower(ml_label) = 'rejection' ORDER BY ts DESC, id LIMIT 20")
def _(t):
    return message_filter(t.messages, company_id=7, label="Rejection").orderBy(F.desc("ts"), "id").limit(20).select("id", "subject")


@query("p14_company_list", "SELECT id, name FROM companies WHERE status = 'application' AND contains(lower(name), '00001')")
def _(t):
    return t.companies.filter((F.col("status") == "application") & icontains("name", "00001")).select("id", "name")


@query("p15_sender_sort_key", "SELECT m.id, coalesce(c.name, '') AS company_name, CASE WHEN strpos(m.sender, '@') > 0 THEN lower(substr(m.sender, strpos(m.sender, '@') + 1)) ELSE lower(m.sender) END AS domain_key FROM messages m LEFT JOIN companies c ON c.id = m.company_id")
def _(t):
    at = F.locate("@", "sender")
    key = F.when(at > 0, F.lower(F.col("sender").substr(at + 1, F.length("sender")))).otherwise(F.lower("sender"))
    joined = t.messages.join(t.companies.select(F.col("id").alias("company_id"), "name"), "company_id", "left")
    return joined.select("id", F.coalesce("name", F.lit("")).alias("company_name"), key.alias("domain_key"))


@query("p16_admin_facets", "SELECT reviewed, ml_label, classification_source, count(*) AS n FROM messages WHERE contains(lower(subject), 'firm 1') GROUP BY ALL")
def _(t):
    return t.messages.filter(icontains("subject", "firm 1")).groupBy("reviewed", "ml_label", "classification_source").agg(F.count("*").alias("n"))


@query("p17_flagged_list", "SELECT id, company_source FROM messages WHERE company_source IS NULL OR company_source IN ('ml_prediction', 'sender_name_match') ORDER BY ts DESC, id LIMIT 100")
def _(t):
    flagged = F.col("company_source").isNull() | F.col("company_source").isin("ml_prediction", "sender_name_match")
    return t.messages.filter(flagged).orderBy(F.desc("ts"), "id").limit(100).select("id", "company_source")


@query("p18_inclusive_day_range", "SELECT thread_id, status FROM threads WHERE status = 'ghosted' OR sent_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'")
def _(t):
    return t.threads.filter((F.col("status") == "ghosted") | F.col("sent_date").between("1998-01-01", "1998-01-31")).select("thread_id", "status")


@query("p19_name_uniqueness", "WITH candidates AS (SELECT DISTINCT upper(CASE WHEN p_partkey % 2 = 0 THEN 'Firm ' ELSE 'Nick ' END || CAST(p_partkey % 80 AS STRING)) AS name FROM part) SELECT c.name, EXISTS (SELECT 1 FROM nicknames a WHERE lower(a.alias) = lower(c.name) OR lower(a.company) = lower(c.name)) AS taken FROM candidates c")
def _(t):
    names = t.part.select(F.upper(F.concat(F.when(F.col("p_partkey") % 2 == 0, "Firm ").otherwise("Nick "), (F.col("p_partkey") % 80).cast("string"))).alias("name")).distinct()
    known = t.nicknames.select(F.lower("alias").alias("k")).union(t.nicknames.select(F.lower("company"))).distinct()
    return names.join(known, F.lower("name") == F.col("k"), "left").select("name", F.col("k").isNotNull().alias("taken"))


@query("s16_latest_by_sender_or_domain", "WITH latest_sender AS (SELECT sender, max_by(msg_id, (ts, id)) AS m FROM messages WHERE ml_label = 'job_application' GROUP BY 1), latest_domain AS (SELECT lower(substr(sender, strpos(sender, '@') + 1)) AS d, max_by(msg_id, (ts, id)) AS m FROM messages WHERE ml_label = 'job_application' GROUP BY 1), asked AS (SELECT DISTINCT sender FROM messages) SELECT a.sender, coalesce(s.m, d.m) AS msg_id FROM asked a LEFT JOIN latest_sender s USING (sender) LEFT JOIN latest_domain d ON d.d = lower(substr(a.sender, strpos(a.sender, '@') + 1))")
def _(t):
    dom = F.lower(F.substring_index("sender", "@", -1))
    apps = t.messages.filter("ml_label = 'job_application'")
    last = F.max_by("msg_id", F.struct("ts", "id"))
    by_sender, by_domain = apps.groupBy("sender").agg(last.alias("a")), apps.groupBy(dom.alias("d")).agg(last.alias("b"))
    asked = t.messages.select("sender").distinct().withColumn("d", dom)
    return asked.join(by_sender, "sender", "left").join(by_domain, "d", "left").select("sender", F.coalesce("a", "b").alias("msg_id"))


@query("s17_training_join", "SELECT m.id, m.subject, c.name FROM messages m JOIN companies c ON c.id = m.company_id WHERE m.reviewed")
def _(t):
    return t.messages.filter("reviewed").join(t.companies.select(F.col("id").alias("company_id"), "name"), "company_id").select("id", "subject", "name")


@query("s18_training_scan", "SELECT id, subject, body, ml_label FROM messages WHERE reviewed AND ml_label IS NOT NULL AND ml_label NOT IN ('', 'unknown')")
def _(t):
    return t.messages.filter(F.col("reviewed") & F.col("ml_label").isNotNull() & ~F.col("ml_label").isin("", "unknown")).select("id", "subject", "body", "ml_label")


@query("f_blank_is_missing", "SELECT id, nullif(trim(focus_area), '') AS focus FROM companies WHERE nullif(trim(focus_area), '') IS NULL")
def _(t):
    return t.companies.select("id", blank_to_null("focus_area").alias("focus")).filter(F.col("focus").isNull())

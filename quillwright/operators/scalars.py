"""The scalar functions applied to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text
from ..functions.sem import AS_OF, LOCAL_ZONE, as_of, elapsed_days, local_date
from ..registry import query


@query("f01_f02_sender_parts", r"SELECT id, lower(regexp_extract(sender, '<[^<>@\s]+@([^<>@\s]+)>', 1)) AS domain, trim(regexp_extract(sender, '^(.*?)<[^>]*>\s*$', 1)) AS display, regexp_extract(sender, '<([^>]*)>\s*$', 1) AS address FROM messages")
def _(t):
    return t.messages.select("id", text.email_domain("sender").alias("domain"), text.display_name("sender").alias("display"), text.address("sender").alias("address"))


@query("f03_f04_reply_prefix", r"SELECT id, regexp_matches(subject, '(?i)^\s*(re|fwd|fw)\s*:') AS reply, regexp_replace(subject, '(?i)^\s*(re|fwd|fw)\s*:\s*', '') AS bare FROM messages")
def _(t):
    return t.messages.select("id", text.is_reply("subject").alias("reply"), text.strip_reply("subject").alias("bare"))


_NAMES = "(SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'Acme Widgets, Inc.' WHEN 1 THEN 'John Smith' WHEN 2 THEN 'Blue  River LLC ' WHEN 3 THEN 'The Data Firm - ' WHEN 4 THEN 'senior engineer role' WHEN 5 THEN '' WHEN 6 THEN 'no-reply 12345' ELSE c_name END AS name FROM {c})"


def _named(t):
    return t.spark.sql(_NAMES.format(c="{customer}").strip("()"), customer=t.customer)


_C = _NAMES.format(c="customer")


@query("f05_normal_name", rf"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)[,\s]+(inc|llc|ltd|corp|gmbh|plc)\.?\s*$', ''), '[\s,.;:|-]+$', ''), '\s+', ' ', 'g')) AS normal FROM {_C}")
def _(t):
    return _named(t).select("id", text.normal_name("name").alias("normal"))


@query("f06_matching_key", rf"SELECT id, lower(trim(regexp_replace(regexp_replace(name, '[,.]', '', 'g'), '\s+', ' ', 'g'))) AS k FROM {_C}")
def _(t):
    return _named(t).select("id", text.matching_key("name").alias("k"))


@query("f07_composite_key", "SELECT thread_id, CAST(company_id AS STRING) || '::' || coalesce(job_title, '') || '::' || coalesce(CAST(rejection_date AS STRING), '') AS k FROM threads")
def _(t):
    return t.threads.select("thread_id", text.composite_key("company_id", "job_title", "rejection_date").alias("k"))


@query("f08_f09_valid_name", rf"SELECT id, coalesce(trim(name) <> '' AND len(regexp_split_to_array(trim(name), '\s+')) <= 8 AND NOT regexp_matches(lower(name), '\b(engineer|manager|developer|analyst|director|role)\b') AND NOT regexp_matches(trim(name), '^(?i:no-reply|the )'), false) AS valid FROM {_C}")
def _(t):
    return _named(t).select("id", text.valid_name("name", ["no-reply", "the "]).alias("valid"))


@query("f10_f11_person_like", rf"SELECT id, len(regexp_split_to_array(trim(name), '\s+')) BETWEEN 2 AND 3 AND len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: NOT regexp_matches(w, '^[A-Z][a-z]+\.?$|^[A-Z]\.?$'))) = 0 AND len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: lower(replace(w, '.', '')) IN ('inc', 'llc', 'ltd', 'corp', 'gmbh', 'plc', 'group', 'firm', 'company'))) = 0 AS person FROM {_C}")
def _(t):
    return _named(t).select("id", text.person_like("name").alias("person"))


@query("f12_f13_candidate_cleaning", rf"SELECT id, coalesce(regexp_matches(lower(name), 'no-reply|noreply|newsletter|notifications') OR len(regexp_extract_all(name, '\d')) >= 4 OR NOT regexp_matches(lower(name), '[a-z]'), true) AS noise FROM {_C}")
def _(t):
    return _named(t).select("id", text.noise_name("name").alias("noise"))


@query("f12_clean_candidate", rf"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(?i)^(the|a|an)\s+', ''), '(?i)\b(careers?|jobs?|recruiting|talent|team|hiring|engineer|manager|developer|analyst|director|role)\b', '', 'g'), '(?i)[,\s]+(inc|llc|ltd|corp|gmbh|plc)\.?\s*$', ''), '[\s,.;:|-]+$', ''), '\s+', ' ', 'g')) AS clean FROM {_C}")
def _(t):
    return _named(t).select("id", text.clean_candidate("name").alias("clean"))


@query("f15_token_jaccard", r"WITH n AS (SELECT id, list_distinct(string_split(lower(trim(regexp_replace(regexp_replace(subject, '[,.]', '', 'g'), '\s+', ' ', 'g'))), ' ')) AS w FROM messages), f AS (SELECT string_split('application for role 3 at firm one', ' ') AS w) SELECT n.id, len(list_intersect(n.w, f.w)) / len(list_distinct(list_concat(n.w, f.w))) AS jaccard FROM n, f")
def _(t):
    return t.messages.select("id", text.token_jaccard("subject", F.lit("application for role 3 at firm one")).alias("jaccard"))


@query("f16_f18_subject_fields", r"SELECT id, nullif(regexp_extract(subject || ' req #A1' || lpad(CAST(id % 1000 AS STRING), 3, '0'), '(?i)(?:job|req(?:uisition)?|id|#)[\s:#-]*([A-Z]?-?\d{3,})', 1), '') AS job_id, nullif(trim(regexp_extract(subject, '(?i)application for (.+?)(?: at | with |$)', 1)), '') AS title, nullif(trim(regexp_extract(subject, '(?i)\bat ([A-Z][\w&. -]*?)\s*$', 1)), '') AS employer FROM messages")
def _(t):
    with_req = F.concat("subject", F.lit(" req #A1"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"))
    return t.messages.select("id", text.job_id(with_req).alias("job_id"), text.job_title("subject").alias("title"), text.first_match("subject", text.SUBJECT_PATTERNS).alias("employer"))


@query("f20_person_at_company", r"SELECT id, CASE WHEN id % 2 = 0 THEN 'Jane Doe' END AS person, CASE WHEN id % 2 = 0 THEN 'Firm ' || CAST(company_id % 20 AS STRING) END AS company FROM messages")
def _(t):
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Jane Doe @ Firm "), (F.col("company_id") % 20).cast("string"))).otherwise("hr @ x1")
    return t.messages.select("id", text.person_at_company(raw).alias("p")).select("id", "p.person", "p.company")


@query("f21_f22_labels", "SELECT DISTINCT ml_label, array_to_string(list_transform(string_split(replace(ml_label, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM messages WHERE ml_label IS NOT NULL")
def _(t):
    return t.messages.filter("ml_label IS NOT NULL").select("ml_label", text.title_label("ml_label").alias("title")).distinct()


@query("f24_snippet", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) AS snippet, array_to_string(string_split(text, chr(10))[1:30], chr(10)) AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", text.snippet("text").alias("snippet"), text.first_lines("text").alias("head"))


@query("f26_strip_headers", "SELECT id, CASE WHEN id % 3 = 2 THEN body || chr(10) || 'From: a@b.example' || chr(10) || chr(10) || 'quoted' ELSE body END AS bare FROM messages")
def _(t):
    # no header block; one at the start; header lines inside the body, which stay
    head = F.concat(F.lit("From: a@b.example\nSubject: "), "subject", F.lit("\nReply-To: c@d.example\n\n"))
    body = F.when(F.col("id") % 3 == 0, F.col("body")).when(F.col("id") % 3 == 1, F.concat(head, "body")).otherwise(F.concat("body", F.lit("\nFrom: a@b.example\n\nquoted")))
    return t.messages.select("id", text.without_headers(body).alias("bare"))


@query("f27_valid_domain", r"SELECT domain, length(domain) <= 253 AND regexp_matches(lower(domain), '^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$') AS valid FROM (SELECT DISTINCT domain FROM companies UNION ALL SELECT * FROM (VALUES ('-bad.example'), ('a_b.example'), ('plain'), ('ok.example.org')))")
def _(t):
    extra = t.spark.createDataFrame([("-bad.example",), ("a_b.example",), ("plain",), ("ok.example.org",)], "domain string")
    return t.companies.select("domain").distinct().union(extra).select("domain", text.valid_domain("domain").alias("valid"))


@query("f29_domain_suffixes", "SELECT DISTINCT domain, domain || '|' || array_to_string(string_split(domain, '.')[2:], '.') || '|' || array_to_string(string_split(domain, '.')[3:], '.') AS suffixes FROM companies")
def _(t):
    return t.companies.select("domain", F.array_join(text.domain_suffixes("domain"), "|").alias("suffixes")).distinct()


@query("f37_f52_page_site_name", r"SELECT page_id, nullif(array_to_string(string_split(regexp_replace(lower(regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', ''), '.')[-2:], '.'), '') AS domain FROM pages")
def _(t):
    return t.pages.select("page_id", text.registrable_domain("url").alias("domain"))


@query("f37_site_name", r"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>\s*(.*?)\s*</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>\s*(.*?)\s*</h1>', 1)), ''), 'none') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", F.coalesce(html.site_name("html"), F.lit("none")).alias("name"))


@query("f38_internal_links", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']+)["'']', 1)) AS links FROM pages""")
def _(t):
    return t.pages.select("page_id", F.size(html.links("html")).cast("bigint").alias("links"))


FOCUS = {"the": ["the", "of"], "ing": ["ing", "tion"], "und": ["der", "und"], "que": ["que", "les"]}


@query("f40_focus_areas", r"WITH s AS (SELECT doc_id, k.area, (length(lower(text)) - length(replace(lower(text), k.w, ''))) // length(k.w) AS n FROM documents, (VALUES ('the', 'the'), ('the', 'of'), ('ing', 'ing'), ('ing', 'tion'), ('und', 'der'), ('und', 'und'), ('que', 'que'), ('que', 'les')) k(area, w)), a AS (SELECT doc_id, area, sum(n) AS n FROM s GROUP BY 1, 2) SELECT doc_id, max_by(area, (n, area)) AS top, CAST(max(n) AS BIGINT) AS n FROM a GROUP BY 1 HAVING max(n) > 0")
def _(t):
    scored = html.keyword_scores("text", FOCUS)
    best = F.array_max(scored)
    return t.documents.select("doc_id", best["area"].alias("top"), best["n"].alias("n")).filter("n > 0")


@query("f43_f44_clocks_and_ages", f"SELECT id, CAST(timezone('{LOCAL_ZONE}', timezone('UTC', ts)) AS DATE) AS local_day, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400) AS BIGINT) AS age FROM messages")
def _(t):
    return t.messages.select("id", local_date("ts").alias("local_day"), elapsed_days("ts", as_of()).cast("bigint").alias("age"))


@query("f45_f46_cutoffs", f"SELECT TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS cutoff, greatest(DATE '2024-01-05', min(CAST(ts AS DATE))) AS floor_date FROM messages")
def _(t):
    return t.messages.agg(F.lit(None).alias("x"), F.greatest(F.lit("2024-01-05").cast("date"), F.min(F.to_date("ts"))).alias("floor_date")).select((as_of() - F.expr("INTERVAL 30 DAYS")).alias("cutoff"), "floor_date")


@query("f47_f48_hashes", r"SELECT id, sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS body_hash, md5(subject || CAST(id AS STRING) || sender) AS key FROM messages")
def _(t):
    return t.messages.select("id", text.body_hash("body").alias("body_hash"), F.md5(F.concat("subject", F.col("id").cast("string"), "sender")).alias("key"))


@query("f49_f50_clamp_and_first_date", "SELECT thread_id, coalesce(interview_date, prescreen_date, sent_date) AS first_known, least(interview_date, prescreen_date, rejection_date) AS earliest, greatest(1, least(30, date_diff('day', sent_date, coalesce(rejection_date, sent_date)))) AS clamped FROM threads")
def _(t):
    days = F.datediff(F.coalesce("rejection_date", "sent_date"), "sent_date")
    return t.threads.select("thread_id", F.coalesce("interview_date", "prescreen_date", "sent_date").alias("first_known"), F.least("interview_date", "prescreen_date", "rejection_date").alias("earliest"), F.greatest(F.lit(1), F.least(F.lit(30), days)).cast("bigint").alias("clamped"))


@query("f51_keyword_ignore", "SELECT id FROM messages WHERE contains(lower(body), 'purchase') OR contains(lower(body), 'number 3')")
def _(t):
    return t.messages.filter(text.mentions_any("body", ["PURCHASE", "number 3"])).select("id")


@query("f23_template_filters", "SELECT id, split_part(msg_id, 'e', 2) AS part, round(coalesce(confidence, 0) * 100, 1) AS percent, map {'rule': 'by rule', 'ml': 'by model'}[classification_source] AS shown FROM messages")
def _(t):
    names = F.create_map(*(F.lit(x) for x in ("rule", "by rule", "ml", "by model")))
    return t.messages.select("id", text.split_part("msg_id", "e", 1).alias("part"), text.percentage("confidence").alias("percent"), names[F.col("classification_source")].alias("shown"))


_TERMS = r"""WITH q AS (SELECT id, 'From:(' || sender || ') "' || body || '" is:new "' || upper(body) || '" ' || subject AS q FROM messages), b AS (SELECT id, regexp_replace(q, '(label|from|to|subject|in|is|has|before|after):', ' ', 'gi') AS b FROM q),
e AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(b, '"[^"]+"', ' ', 'g'), '[^A-Za-z0-9@._''+-]+') || regexp_extract_all(b, '"([^"]+)"', 1), lambda t: length(t) >= 3) AS e FROM b),
d AS (SELECT id, list_filter(e, lambda t, i: list_position(list_transform(e, lambda x: lower(x)), lower(t)) = i) AS d FROM e)
SELECT id, '(' || array_to_string(list_transform(d, lambda t: regexp_replace(t, '([\s#$&()*+\-.?\[\\\]^{|}~])', '\\\1', 'g')), '|') || ')' AS pattern FROM d"""


@query("f25_query_terms", _TERMS)
def _(t):
    q = F.concat(F.lit("From:("), "sender", F.lit(') "'), "body", F.lit('" is:new "'), F.upper("body"), F.lit('" '), "subject")
    return t.messages.select("id", text.any_term(text.query_terms(q)).alias("pattern"))


@query("f28_sanitised_input", """SELECT id, CASE WHEN id % 4 = 0 OR length(trim(sender || ' & "' || subject || '"')) > 75 THEN NULL ELSE replace(replace(replace(replace(sender || ' & "' || subject || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END AS shown, id % 4 <> 0 AS safe FROM messages""")
def _(t):
    odd = F.when(F.col("id") % 4 == 0, F.lit("(?#x) <Script> ")).otherwise(F.lit(""))
    value = F.concat(F.lit("  "), odd, "sender", F.lit(' & "'), "subject", F.lit('" '))
    return t.messages.select("id", text.sanitised_input(value, 75).alias("shown"), text.safe_pattern(F.concat(odd, "body")).alias("safe"))


# a keyword of the default areas after each text, so that every area is met
_KEYWORDS = [w for words in html.FOCUS_AREAS.values() for w in words]
_LIST = ", ".join(f"'{w}'" for w in _KEYWORDS)
_AREAS = ", ".join(f"({i}, '{a}', '{w}')" for i, (a, words) in enumerate(html.FOCUS_AREAS.items()) for w in words)


@query("f40_default_areas", f"WITH x AS (SELECT doc_id, lower(text || ' ' || ([{_LIST}])[1 + doc_id % {len(_KEYWORDS)}] || ' ' || ([{_LIST}])[1 + doc_id // 7 % {len(_KEYWORDS)}] || ' ') AS low FROM documents), s AS (SELECT doc_id, k.i, k.area, sum((length(low) - length(replace(low, k.w, ''))) // length(k.w)) AS n FROM x, (VALUES {_AREAS}) k(i, area, w) GROUP BY ALL) SELECT doc_id, string_agg(area, '; ' ORDER BY n DESC, i) AS areas FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rn FROM s WHERE n > 0) WHERE rn <= 3 GROUP BY 1")
def _(t):
    words = F.array(*map(F.lit, _KEYWORDS))
    text = F.concat("text", F.lit(" "), F.get(words, (F.col("doc_id") % len(_KEYWORDS)).cast("int")), F.lit(" "), F.get(words, (F.floor(F.col("doc_id") / 7) % len(_KEYWORDS)).cast("int")), F.lit(" "))
    return t.documents.select("doc_id", F.array_join(html.top_areas(text), "; ").alias("areas"))

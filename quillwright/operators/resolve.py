"""Entity resolution (J15-J18, E01-E19): suffix joins, dictionary tiers, alias mining, merges."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SUBJECT_PATTERNS, address, display_name, domain_suffixes, email_domain, first_match, matching_key, normal_name, person_like, valid_name
from ..registry import query
from .matching import held_names


def suffix_join(rows: DataFrame, domain: str, dims: DataFrame, longest: bool = False, small: bool = True) -> DataFrame:
    """Each row with the dictionary entry whose domain equals the row's or is a parent of it.

    The domain's suffixes are exploded once for each distinct domain and equi-joined with the dictionary: no nested loop.
    An exact match wins, then the first entry in the dictionary's order (J15), or the longest suffix (J16). ``dims`` has
    domain and ord; its other columns are added. The dictionary is broadcast only if ``small`` says that its size is bounded.
    """
    extra = [c for c in dims.columns if c != "domain"]
    names = rows.select(F.col(domain).alias("__d")).filter("__d IS NOT NULL").distinct()
    parts = names.select("__d", F.posexplode(domain_suffixes("__d")).alias("__depth", "domain"))
    met = parts.join(F.broadcast(dims) if small else dims, "domain")
    rank = F.struct("__depth", "ord") if longest else F.struct((F.col("__depth") > 0).cast("int"), "ord")
    best = met.groupBy("__d").agg(F.min_by(F.struct(F.col("domain").alias("matched"), *extra), rank).alias("__m"))
    return rows.join(best, rows[domain] == best["__d"], "left").select(*rows.columns, "__m.*")


def contained_name(rows: DataFrame, key: str, text: str, names: DataFrame, longest: bool = True) -> DataFrame:
    """``rows`` with ``known_name``: the longest (or first) name of a dictionary (name, ord) of any size that the text holds as whole words."""
    found = held_names(rows, key, text, names, longest=longest).select(key, F.col("name").alias("known_name"))
    return rows.join(found, key, "left")


def first_tier(**candidates: Column) -> Column:
    """struct(value, source) of the first tier with a value, in the order given; null if none has one.

    A tier's candidate is worked out once, and only where the tiers before it have none.
    """

    def tier(name: str, candidate: Column) -> Column:
        return F.get(F.transform(F.array(candidate), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(name).alias("source")))), F.lit(0))

    return F.coalesce(*(tier(name, c) for name, c in candidates.items()))


# fixed values: two mail domains whose mails name the employer in the body, the pattern and the provenance of each
BODY_DOMAINS = {
    "usastaffing.gov": ("usastaffing_body_extraction", r"(?i)at the\s+([A-Z][A-Za-z0-9\s&.,'-]+?),\s+in the Department of"),
    "indeed.com": ("indeed_body_extraction", r"(?i)(?:the following items were sent to|about your application.*?with)\s+([A-Z][A-Za-z0-9\s&.,'-]+?)(?:\s+(?:and|About|Your application|Resume|Cover letter|\n|$))"),
}
# fixed values: what stands before an employer's name in a body
AT_SYMBOL = r"(?i)(?:position|role|opportunity)\s+@\s*([A-Za-z][\w\s&\-]+?)(?=[\W]|$)"
BODY_PHRASES = r"(?i)(?:apply(?:ing)? to|application to|interest in|position at|role at|opportunity with)\s+([A-Z][\w\s&\-]+)"
UNNAMED = ("job_application", "noise")


def plain_body(body: str | Column) -> Column:
    """A body without style, script and tags, if it is a page."""
    c = F.col(body) if isinstance(body, str) else body
    text = F.regexp_replace(F.regexp_replace(c, r"(?is)<(style|script)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.when(F.lower(c).rlike("<html|<style"), F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(c)


def _name(c: Column, valid: bool = True) -> Column:
    """A found name, normalised; null if it is blank or no valid name."""
    return F.when(valid_name(c) if valid else F.lit(True), F.nullif(normal_name(c), F.lit("")))


def resolve(messages: DataFrame, domains: DataFrame, aliases: DataFrame, me: str | None = None, subject: DataFrame | None = None) -> DataFrame:
    """The cascade E01-E13: ``messages`` with ``resolved`` and ``provenance``.

    In order: the recipient's domain of a mail that ``me`` sent (E01; no other tier serves such a mail), head-hunter domain (none, E02), domain
    map (E03), the organisation or employer in bodies of two domains (E04, E05), a valid name in the subject (E06), a model's valid prediction
    that the mail holds (E07), "position @ X" (E08), "applying to X" (E09), a known name in the sender's display name (E10), the
    Organization header unless it is a person (E11), none (E12). Noise is not resolved. A name that a dictionary knows gets its spelling (E13).
    Columns recipient, organization and predicted may be missing. ``subject`` (id, subject_company) has what ``cascade.subject_company`` found
    for E06; without it a short list of patterns serves. Spark broadcasts dictionaries that are small; ``id`` is unique.
    """
    given = messages
    for c in ("recipient", "organization", "predicted"):
        if c not in messages.columns:
            given = given.withColumn(c, F.lit(None).cast("string"))
    sent = F.coalesce(F.lower(address("sender")).startswith(me.lower()), F.lit(False)) if me else F.lit(False)
    rows = given.withColumn("__sent", sent).withColumn("sender_domain", F.when(F.col("__sent"), email_domain("recipient")).otherwise(email_domain("sender")))
    rows = suffix_join(rows, "sender_domain", domains, small=False)
    rows = rows.withColumn("__shown", F.lower(display_name("sender")))
    senders = rows.select("__shown").filter("__shown <> ''").distinct()
    known = held_names(senders, "__shown", "__shown", domains.filter("company IS NOT NULL").select(F.col("company").alias("name"), "ord"), whole_words=False, longest=False)
    rows = rows.join(known.select("__shown", F.col("name").alias("__known")), "__shown", "left")
    if subject is not None:
        rows = rows.join(subject.select("id", F.col("subject_company").alias("__subject")), "id", "left")
    parsed = F.col("__subject") if subject is not None else first_match("subject", SUBJECT_PATTERNS)
    text = plain_body("body")
    mapped = F.when(F.col("kind") == "company", F.col("company"))
    others = ~F.col("__sent")
    head = F.coalesce(F.col("kind") == "headhunter", F.lit(False))
    predicted = _name(F.col("predicted"))
    held = F.contains(F.lower("subject"), F.lower("predicted")) | F.contains(F.lower(text), F.lower("predicted"))
    tier = {
        "user_sent_to_company": F.when(F.col("__sent"), F.coalesce(mapped, F.lit(""))),
        "headhunter_domain": F.when(head, F.lit("")),
        "domain_mapping": mapped,
        **{source: F.when(F.col("sender_domain") == domain, _name(first_match(text, (pattern,)))) for domain, (source, pattern) in BODY_DOMAINS.items()},
        "subject_parse": _name(parsed),
        "ml_prediction": F.when(~F.lower("predicted").isin(*UNNAMED) & held, predicted),
        "body_at_symbol": F.initcap(first_match(text, (AT_SYMBOL,))),
        "body_regex": first_match(F.col("body"), (BODY_PHRASES,)),
        "sender_name_match": F.col("__known"),
        "organization_header": F.when(~person_like("organization"), F.nullif(F.trim("organization"), F.lit(""))),
    }
    rows = rows.withColumn("__tier", first_tier(**{k: c if k == "user_sent_to_company" else F.when(others, c) for k, c in tier.items()}))
    value, source = F.col("__tier.value"), F.coalesce("__tier.source", F.lit("unresolved"))
    skip = F.coalesce(F.col("ml_label").isin("noise", "head_hunter"), F.lit(False))
    out = rows.select(*messages.columns, F.when(~skip, F.nullif(value, F.lit(""))).alias("resolved"), F.when(skip, "skipped").otherwise(source).alias("provenance"))
    spelled = aliases.select("alias", "company", F.lit(1).alias("far"), "ord").union(domains.filter("company IS NOT NULL").select("company", "company", F.lit(0), "ord"))
    names = spelled.groupBy(matching_key("alias").alias("__k")).agg(F.min_by("company", F.struct("far", "ord")).alias("__c"))
    joined = out.join(names, matching_key("resolved") == F.col("__k"), "left")
    return joined.withColumn("resolved", F.coalesce("__c", "resolved")).drop("__k", "__c")


_SUFFIX = "WITH u AS (SELECT DISTINCT {src} AS d FROM {tab}), m AS (SELECT u.d, x.*, CASE WHEN x.domain = u.d THEN 0 ELSE 1 END AS far FROM u JOIN domains x ON x.domain = u.d OR ends_with(u.d, '.' || x.domain))"


@query("j15_suffix_join", _SUFFIX.format(src="'mail.' || domain", tab="companies") + " SELECT c.id, min_by(m.domain, (m.far, m.ord)) AS matched, min_by(m.kind, (m.far, m.ord)) AS kind FROM companies c LEFT JOIN m ON m.d = 'mail.' || c.domain GROUP BY 1")
def _(t):
    rows = t.companies.select("id", F.concat(F.lit("mail."), "domain").alias("host"))
    return suffix_join(rows, "host", t.domains).select("id", "matched", "kind")


@query("j16_suffix_join_longest", _SUFFIX.format(src="domain", tab="companies") + " SELECT c.id, max_by(m.domain, (length(m.domain), -m.ord)) AS matched FROM companies c LEFT JOIN m ON m.d = c.domain GROUP BY 1")
def _(t):
    return suffix_join(t.companies.select("id", F.col("domain").alias("host")), "host", t.domains, longest=True).select("id", "matched")


@query("j17_m06_job_board_noise", "SELECT id, CASE WHEN company_id % 20 = 9 AND ml_label IS DISTINCT FROM 'noise' THEN 'noise' ELSE ml_label END AS label FROM messages WHERE company_id % 20 = 9")
def _(t):
    rows = suffix_join(t.messages.withColumn("host", email_domain("sender")), "host", t.domains.filter("kind = 'job_board'"))
    return rows.filter("kind = 'job_board'").select("id", F.lit("noise").alias("label"))


@query("j18_known_name_in_text", r"WITH k AS (SELECT * FROM (VALUES ('Firm 1', 1), ('Firm 11', 2), ('Role 3', 3)) v(name, ord)) SELECT m.id, min_by(k.name, (-length(k.name), k.ord)) AS known_name FROM messages m LEFT JOIN k ON regexp_matches(m.subject, '(?i)\b' || k.name || '\b') GROUP BY 1")
def _(t):
    names = t.spark.createDataFrame([("Firm 1", 1), ("Firm 11", 2), ("Role 3", 3)], "name string, ord int")
    return contained_name(t.messages, "id", "subject", names).select("id", "known_name")


_WORD = r"[\p{L}\p{N}\p{M}\p{Pc}]+"
# two words with one space between: the end of one piece between spaces and the beginning of the next
_WHOLE = rf"""WITH k AS (SELECT name, min(doc_id) AS ord FROM (SELECT doc_id, array_to_string(string_split_regex(text, '[^a-zA-Z0-9_]+')[2:3], ' ') AS name FROM documents) WHERE regexp_full_match(name, '[a-zA-Z]{{3,}} [a-zA-Z]{{3,}}') GROUP BY name),
pieces AS (SELECT doc_id, unnest(string_split(text, ' ')) AS c, unnest(range(len(string_split(text, ' ')))) AS i FROM documents),
pairs AS (SELECT DISTINCT doc_id, lower(regexp_extract(c, '({_WORD})$', 1) || ' ' || regexp_extract(lead(c) OVER (PARTITION BY doc_id ORDER BY i), '^({_WORD})', 1)) AS k FROM pieces),
m AS (SELECT p.doc_id, k.name, k.ord FROM pairs p JOIN k ON lower(k.name) = p.k)
SELECT d.doc_id, max_by(m.name, (length(m.name), -m.ord)) AS known_name FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1"""


@query("j18_names_in_whole_texts", _WHOLE)
def _(t):
    """The second and third word of every document are a dictionary as long as the table, against all whole texts."""
    parts = F.slice(F.split("text", r"[^\w]+"), 2, 2)
    names = t.documents.select(F.array_join(parts, " ").alias("name"), F.col("doc_id").alias("ord")).filter(F.col("name").rlike("^[a-zA-Z]{3,} [a-zA-Z]{3,}$"))
    names = names.groupBy("name").agg(F.min("ord").alias("ord"))
    return contained_name(t.documents.select("doc_id", "text"), "doc_id", "text", names).select("doc_id", "known_name")


@query("e01_e13_resolution_cascade", "WITH x AS (SELECT *, company_id % 20 AS d FROM messages), v AS (SELECT id, coalesce(ml_label IN ('noise', 'head_hunter'), false) AS skip, CASE WHEN d IN (3, 7) THEN '' WHEN d = 1 THEN 'Firm One' WHEN d = 2 THEN 'Firm Two' WHEN d = 4 THEN 'Firm Four' WHEN d = 5 THEN 'Firm Five' WHEN d = 6 THEN 'Firm Six' WHEN d IN (8, 9) THEN 'Firm ' || d ELSE 'Example Group' END AS value, CASE WHEN d IN (3, 7) THEN 'headhunter_domain' WHEN d IN (8, 9) THEN 'subject_parse' ELSE 'domain_mapping' END AS source FROM x) SELECT id, CASE WHEN skip THEN NULL ELSE nullif(value, '') END AS resolved, CASE WHEN skip THEN 'skipped' ELSE source END AS provenance FROM v")
def _(t):
    return resolve(t.messages, t.domains, t.aliases).select("id", "resolved", "provenance")


_TIERS = """SELECT id, CASE WHEN ml_label IN ('noise', 'head_hunter') THEN NULL ELSE map {0: 'Firm One', 2: 'Firm Two', 3: 'Bureau of Maps', 4: 'Blue River', 5: 'Green Hill', 6: 'Red Lake', 7: 'Bluestone', 8: 'Quiet Garden', 9: 'Firm Four', 10: 'Stone Works Group', 13: 'Firm Two', 14: 'Firm One'}[tier] END AS resolved,
CASE WHEN ml_label IN ('noise', 'head_hunter') THEN 'skipped' ELSE coalesce(map {0: 'user_sent_to_company', 1: 'headhunter_domain', 2: 'domain_mapping', 3: 'usastaffing_body_extraction', 4: 'indeed_body_extraction', 5: 'subject_parse', 6: 'ml_prediction', 7: 'body_at_symbol', 8: 'body_regex', 9: 'sender_name_match', 10: 'organization_header', 13: 'subject_parse', 14: 'subject_parse'}[tier], 'unresolved') END AS provenance FROM letters"""


@query("e01_e13_all_tiers", _TIERS)
def _(t):
    return resolve(t.letters, t.domains, t.aliases, me="me@home.example").select("id", "resolved", "provenance")


@query("e13_restore_known_casing", "SELECT DISTINCT upper(m.name) AS raw, coalesce(a.company, upper(m.name)) AS resolved FROM (SELECT 'Firm ' || company_id % 20 AS name FROM messages) m LEFT JOIN aliases a ON lower(a.alias) = lower(m.name)")
def _(t):
    raw = t.messages.select(F.upper(F.concat(F.lit("Firm "), (F.col("company_id") % 20).cast("string"))).alias("raw")).distinct()
    known = t.aliases.select(matching_key("alias").alias("k"), "company")
    return raw.join(F.broadcast(known), matching_key("raw") == F.col("k"), "left").select("raw", F.coalesce("company", "raw").alias("resolved"))


def sequence_ratio(candidates: DataFrame, names: list[str], column: str = "candidate", least: float = 0.75) -> DataFrame:
    """Each candidate's most similar canonical name by Ratcliff-Obershelp's ratio; names are a dictionary of fixed size."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for c in part[column]:
                scored = [(difflib.SequenceMatcher(None, (c or "").lower(), n.lower()).ratio(), -i, n) for i, n in enumerate(names)] or [(0.0, 0, None)]
                ratio, _, name = max(scored)
                found.append((name if ratio >= least else None, ratio))
            yield part.assign(similar=[f[0] for f in found], ratio=[f[1] for f in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.mapInPandas(best, f"{schema}, similar string, ratio double")


@query("e14_f14_alias_mining")
def _(t):
    raw = t.messages.select(F.concat(F.lit("Frm "), (F.col("company_id") % 20).cast("string"), F.lit(" Inc.")).alias("candidate")).distinct()
    return sequence_ratio(raw.select(normal_name("candidate").alias("candidate")), ["Firm One", "Firm 1", "Firm 2", "Example Group"])


def merge_companies(companies: DataFrame, children: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies folded into their ``canonical`` (id, canonical), contacts recomputed; children reassigned."""
    mapped = companies.join(canonical, "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    merged = mapped.groupBy(F.col("canonical").alias("id")).agg(F.min_by("name", F.struct(F.col("id") != F.col("canonical"), "id")).alias("name"), F.min("first_contact").alias("first_contact"), F.max("last_contact").alias("last_contact"), F.count("*").alias("merged"))
    moved = children.join(canonical.withColumnRenamed("id", "company_id"), "company_id", "left").withColumn("company_id", F.coalesce("canonical", "company_id")).drop("canonical")
    return merged, moved


@query("e15_m09_merge_by_domain", "WITH c AS (SELECT id, min(id) OVER (PARTITION BY domain) AS canonical, name, first_contact, last_contact FROM companies) SELECT canonical AS id, min(first_contact) AS first_contact, max(last_contact) AS last_contact, count(*) AS merged FROM c GROUP BY 1")
def _(t):
    least = t.companies.groupBy("domain").agg(F.min("id").alias("canonical"))
    canonical = t.companies.join(least, "domain").select("id", "canonical")
    return merge_companies(t.companies, t.messages, canonical)[0].select("id", "first_contact", "last_contact", "merged")


@query("e16_k19_fill_from_dictionary", "SELECT c.id, coalesce(d.company, c.name) AS name FROM companies c LEFT JOIN (SELECT domain, min_by(company, ord) AS company FROM domains WHERE kind = 'company' GROUP BY 1) d ON d.domain = c.domain")
def _(t):
    d = t.domains.filter("kind = 'company'").groupBy("domain").agg(F.min_by("company", "ord").alias("company"))
    return t.companies.join(F.broadcast(d), "domain", "left").select("id", F.coalesce("company", "name").alias("name"))


@query("e17_domain_labels_by_precedence", "SELECT u.domain, CASE WHEN bool_or(d.kind = 'personal') THEN 'personal' WHEN bool_or(d.kind = 'ats') THEN 'ats' WHEN bool_or(d.kind = 'headhunter') THEN 'headhunter' WHEN bool_or(d.kind = 'job_board') THEN 'job_board' WHEN bool_or(d.kind = 'company') THEN 'company' END AS label FROM (SELECT DISTINCT domain FROM companies) u LEFT JOIN domains d USING (domain) GROUP BY 1")
def _(t):
    order = F.array(*map(F.lit, ("personal", "ats", "headhunter", "job_board", "company")))
    kinds = t.domains.groupBy("domain").agg(F.min_by("kind", F.array_position(order, F.col("kind"))).alias("label"))
    return t.companies.select("domain").distinct().join(F.broadcast(kinds), "domain", "left").select("domain", "label")


def approved_aliases(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """(alias, company): approved ones replace those of the same alias; rejected ones are left out."""
    yes = asked.filter("approved").select("alias", "company")
    return aliases.select("alias", "company").join(yes, "alias", "left_anti").unionByName(yes)


@query("e18_k18_alias_approval", "WITH asked AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Nick ' ELSE 'New ' END || CAST(s_suppkey AS STRING) AS alias, 'Firm ' || CAST(s_suppkey % 7 AS STRING) AS company, s_suppkey % 3 <> 0 AS approved FROM supplier WHERE s_suppkey % 4 < 2) SELECT alias, company FROM nicknames WHERE alias NOT IN (SELECT alias FROM asked WHERE approved) UNION ALL SELECT alias, company FROM asked WHERE approved")
def _(t):
    key = F.col("s_suppkey")
    asked = t.supplier.filter(key % 4 < 2).select(F.concat(F.when(key % 2 == 0, "Nick ").otherwise("New "), key.cast("string")).alias("alias"), F.concat(F.lit("Firm "), (key % 7).cast("string")).alias("company"), (key % 3 != 0).alias("approved"))
    return approved_aliases(t.nicknames, asked)


@query("e19_simple_resolver", r"SELECT id, coalesce(nullif(trim(regexp_extract(subject, '\bat ([A-Z][\w&. -]*?)\s*$', 1)), ''), regexp_extract(sender, '<([^>]*)>\s*$', 1)) AS company FROM messages")
def _(t):
    return t.messages.select("id", F.coalesce(first_match("subject", (r"\bat ([A-Z][\w&. -]*?)\s*$",)), address("sender")).alias("company"))

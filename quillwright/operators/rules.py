"""Rule engine (C01-C12, C21): dictionaries of patterns become one CASE expression of alternations.

The decision list has a fixed order; the first hit is the label. A pattern list is one alternation, so a step is one
regular expression, and CASE stops at the first that holds. Vetoes act in the label loop alone (or everywhere, if asked).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sem import is_not
from ..functions.text import email_domain, is_reply
from ..registry import query

#: Labels of the loop, in the order of their trial.
LOOP = ("offer", "cancelled", "rejection", "head_hunter", "noise", "prescreen", "job_application", "interview_invite", "other", "referral", "ghosted", "blank")
CANONICAL = {"rejected": "rejection", "interview": "interview_invite", "application": "job_application", "applied": "job_application", "headhunter": "head_hunter"}


@dataclass
class Rules:
    """Pattern dictionaries. ``staged``: lists of the early steps; ``labels`` and ``vetoes``: lists of the loop."""

    staged: dict[str, list[str]] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    vetoes: dict[str, list[str]] = field(default_factory=dict)
    vetoes_everywhere: bool = False

    def plus(self, staged: dict[str, list[str]] | None = None, labels: dict[str, list[str]] | None = None, vetoes: dict[str, list[str]] | None = None) -> Rules:
        """These rules with more patterns at the ends of their lists."""
        both = ({k: [*old.get(k, []), *(new or {}).get(k, [])] for k in {**old, **(new or {})}} for old, new in ((self.staged, staged), (self.labels, labels), (self.vetoes, vetoes)))
        return Rules(*both, self.vetoes_everywhere)


#: The engine's own dictionary for mails about applications. Deployments load theirs (``sources.readers``) or add to it (``Rules.plus``).
DEFAULT = Rules(
    staged={
        "confirmation_subject": [r"^application (submitted|received|confirmation)\b", r"^thank you for (your application|applying)\b"],
        "assessment_subject": [r"\bassessment (is )?complete", r"\bcoding (challenge|test) (submitted|complete)"],
        "incomplete": [r"(finish|complete|continue) your application", r"application is (incomplete|not complete)", r"haven't (finished|submitted) your application"],
        "cancelled": [r"position (has been|was|is) (cancelled|canceled|closed|withdrawn)", r"no longer (hiring|recruiting) for this"],
        "rejection": [r"not (be )?moving forward", r"(decided|chosen) to (proceed|move forward) with other candidates", r"regret to inform you", r"not (been )?selected", r"position has been filled"],
        "prescreen": [r"phone screen", r"(initial|introductory) (call|conversation) with (our|a) recruiter", r"recruiter screen"],
        "scheduling": [r"schedule (a|an|your) (call|interview|conversation)", r"(pick|choose|book) a time (slot )?(that|to|for)", r"your availability for (a|an) (call|interview)"],
        "application": [r"thank you for applying", r"thanks for (your application|applying)", r"your application (has been|was) (received|submitted)"],
        "referral": [r"referred you", r"employee referral"],
        "status_update": [r"status update", r"update on (the status of )?your application"],
        "application_confirmation": [r"we('ve| have)? received your application", r"confirm(ing)? (the )?receipt of your application"],
        "contact": [r"\bcall me\b", r"\breach out to me\b", r"\bgive me a ring\b"],
    },
    labels={
        "offer": [r"offer letter", r"pleased to (offer|extend)", r"offer of employment"],
        "head_hunter": [r"my client is (hiring|looking)", r"on behalf of (my|our) client", r"confidential search for"],
        "noise": [r"unsubscribe", r"job alert", r"weekly digest", r"recommended jobs for you"],
        "prescreen": [r"screening call", r"screening questions"],
        "job_application": [r"your application", r"application received"],
        "interview_invite": [r"interview", r"meet (with )?the (hiring )?team", r"invite you to (a|an) (call|conversation)"],
        "other": [r"background check", r"reference check", r"onboarding"],
        "referral": [r"a friend suggested", r"was referred by"],
        "ghosted": [r"haven't heard (back )?from you", r"no response to our"],
    },
    vetoes={"noise": [r"interview (is )?(scheduled|confirmed)", r"offer letter"], "head_hunter": [r"\bour own team\b"], "referral": [r"referral (program|bonus)"]},
)


def alternation(patterns: list[str]) -> str:
    """One pattern, case-insensitive and Unicode-aware, dots over line ends."""
    return "(?iUs)(?:" + "|".join(patterns) + ")"


def matches(text: Column, patterns: list[str] | None) -> Column:
    return text.rlike(alternation(patterns)) if patterns else F.lit(False)


def classify(subject: Column, body: Column, rules: Rules = DEFAULT, *, headhunter: Column | None = None, trusted: Column | None = None, has_domain: Column | None = None) -> Column:
    """The label, or null. ``trusted``: the domain is a mail system's, a job board's or a known company's."""
    no = F.lit(False)
    headhunter, trusted = headhunter if headhunter is not None else no, trusted if trusted is not None else no
    has_domain = has_domain if has_domain is not None else F.lit(True)
    subject = F.coalesce(subject, F.lit(""))
    text = F.concat_ws(" ", subject, F.coalesce(body, F.lit("")))
    reply, s = is_reply(subject), rules.staged

    def step(name: str, label: str | None = None) -> Column:
        hit = matches(text, s.get(name))
        return hit & ~matches(text, rules.vetoes.get(label)) if label and rules.vetoes_everywhere else hit

    scheduling, prescreen = step("scheduling"), step("prescreen", "prescreen")
    out = F.when(matches(subject, s.get("confirmation_subject")), "job_application")
    out = out.when(matches(subject, s.get("assessment_subject")), "other")
    out = out.when(step("incomplete"), "other").when(step("cancelled", "cancelled"), "cancelled").when(step("rejection", "rejection"), "rejection")
    out = out.when(prescreen & ~reply, "prescreen")
    out = out.when(scheduling & reply, "other").when(scheduling, "interview_invite")
    out = out.when(step("application", "job_application"), "job_application").when(step("referral", "referral"), "referral")
    out = out.when(step("status_update"), "other").when(step("application_confirmation"), "job_application")
    for label in LOOP:
        if label not in rules.labels:
            continue
        hit = matches(text, rules.labels[label]) & ~matches(text, rules.vetoes.get(label))
        if label == "head_hunter":
            out = out.when(hit & (headhunter | (~trusted & step("contact"))), label)
        elif label == "referral":
            out = out.when(hit & (headhunter | (~trusted & (has_domain | step("referral")))), label)
        else:
            out = out.when(hit, label)
    return out.when(prescreen, "other")


def explain(text: Column, rules: dict[str, list[str]]) -> Column:
    """Array of (label, pattern) of every pattern that matches."""
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), F.lit("(?iUs)" + p).alias("pattern")) for label, ps in rules.items() for p in ps))
    return F.filter(pairs, lambda p: F.regexp_like(text, p["pattern"]))


def canonical_label(label: str | Column) -> Column:
    """One vocabulary for labels."""
    c = F.col(label) if isinstance(label, str) else label
    mapping = F.create_map(*(F.lit(x) for kv in CANONICAL.items() for x in kv))
    return F.coalesce(mapping[F.lower(c)], F.lower(c))


def arbitrate(rule: Column, ml_label: Column, ml_confidence: Column) -> tuple[Column, Column, Column]:
    """(label, confidence, source): a rule's hit is certain, otherwise the model speaks."""
    hit = rule.isNotNull()
    return F.coalesce(rule, ml_label), F.when(hit, 1.0).otherwise(ml_confidence), F.when(hit, "rule").when(ml_label.isNotNull(), "ml").otherwise("none")


# fixed values: what makes an invitation an offer or a meeting like any other, and what gives a meeting away
OFFER, GENERIC = r"\boffer\b|\bcompensation\b|\bsalary\b|\brate\b|\bnegotiat", r"meeting with|meeting invitation"
DETAILS = r"meeting id|passcode|join.*meeting|zoom\.us|meet\.google|teams\.microsoft"


def adjusted(label: Column, text: Column, confidence: Column, offer: str = OFFER, generic: str = GENERIC, details: str = DETAILS) -> Column:
    """An interview that reads like an offer, or is generic and unsure, is other; other with meeting details is an interview."""
    interview = label == "interview_invite"
    out = F.when(interview & text.rlike(f"(?i){offer}"), "other").when(interview & text.rlike(f"(?i){generic}") & (confidence < 0.7), "other")
    return out.when(label.isin("other", "response") & text.rlike(f"(?i){details}"), "interview_invite").otherwise(label)


def overridden(label: Column, *, personal: Column, job_board: Column, headhunter: Column, confirmation: Column, forwarded: Column, user_sent: Column) -> Column:
    """Overrides in their order; labels that a head-hunter cannot have become head_hunter."""
    blocked = label.isin("job_application", "interview_invite", "rejection", "prescreen")
    out = F.when(personal, "noise").when(job_board & ~confirmation, "noise").when(headhunter & blocked, "head_hunter")
    return out.when(forwarded, "other").when(user_sent, "other").otherwise(label)


_SPANS = "array<struct<start:int,end:int>>"


def match_spans(text: Column, pattern: str) -> Column:
    """Places (from 0, end exclusive) of all matches of a pattern that never matches nothing: lengths of what lies between them, summed up."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(s["spans"], F.struct(begin.alias("start"), end.alias("end"))).alias("spans"))

    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def joined_spans(spans: Column) -> Column:
    """Overlapping and touching spans made one, in order."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"])
        return F.when(touches, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.array_append(done, x))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def highlights(text: Column, rules: Rules) -> tuple[Column, Column]:
    """(hits, highlights) over all lists of ``rules``: which list's which pattern matches where, and the text's places to mark.

    ``hits``: array of (list, pattern, spans), patterns without a match left out; null text has none.
    """
    given = F.coalesce(text, F.lit(""))
    lists = [(f"{kind}:{name}", p) for kind, group in (("staged", rules.staged), ("label", rules.labels), ("veto", rules.vetoes)) for name, patterns in group.items() for p in patterns]
    every = F.array(*(F.struct(F.lit(name).alias("list"), F.lit(p).alias("pattern"), match_spans(given, alternation([p])).alias("spans")) for name, p in lists))
    hits = F.filter(every, lambda h: F.size(h["spans"]) > 0)
    return hits, joined_spans(F.flatten(F.transform(hits, lambda h: h["spans"])))


def status_dates(body: Column, day: Column, patterns: dict[str, list[str]]) -> Column:
    """C11: struct of dates, the message's day where a body pattern of the status matches."""
    return F.struct(*(F.when(matches(body, p), day).alias(f"{name}_date") for name, p in patterns.items()))


def auto_review(label: Column, confidence: Column, company_valid: Column, reingest: bool = False) -> Column:
    """C12"""
    hidden = is_not(label, "noise", "other") if reingest else is_not(label, "noise")
    return (confidence >= 0.85) & hidden & company_valid


def _ors(patterns: list[str], col: str) -> str:
    joined = "|".join(patterns).replace("'", "''")
    return f"regexp_matches({col}, '(?is)(?:{joined})')"


def _oracle(rules: Rules) -> str:
    s, v = rules.staged, rules.vetoes
    steps = [
        (_ors(s["confirmation_subject"], "subject"), "job_application"), (_ors(s["assessment_subject"], "subject"), "other"), (_ors(s["incomplete"], "t"), "other"), (_ors(s["cancelled"], "t"), "cancelled"),
        (_ors(s["rejection"], "t"), "rejection"), (_ors(s["prescreen"], "t") + " AND NOT reply", "prescreen"), (_ors(s["scheduling"], "t") + " AND reply", "other"), (_ors(s["scheduling"], "t"), "interview_invite"),
        (_ors(s["application"], "t"), "job_application"), (_ors(s["referral"], "t"), "referral"), (_ors(s["status_update"], "t"), "other"), (_ors(s["application_confirmation"], "t"), "job_application"),
    ]
    for label in LOOP:
        if label in rules.labels:
            c = _ors(rules.labels[label], "t") + (f" AND NOT {_ors(v[label], 't')}" if label in v else "")
            if label == "head_hunter":
                c += f" AND (hh OR {_ors(s['contact'], 't')})"
            steps.append((c, label))
    steps.append((_ors(s["prescreen"], "t"), "other"))
    cases = " ".join(f"WHEN {c} THEN '{x}'" for c, x in steps)
    return f"WITH x AS (SELECT id, subject, subject || ' ' || body AS t, starts_with(subject, 'Re: ') AS reply, company_id % 20 IN (3, 7) AS hh FROM messages) SELECT id, CASE {cases} END AS label FROM x"


#: The default rules and patterns that the test tables' messages hold.
TABLE_RULES = DEFAULT.plus(
    staged={
        "confirmation_subject": [r"role 6 at firm 1\b"],
        "incomplete": [r"role 5 .*number 9"],
        "cancelled": [r"role 4 .*number 8"],
        "rejection": [r"purchase number [0-4]\b"],
        "prescreen": [r"click number 1\b"],
        "scheduling": [r"click number [23]\b"],
        "application": [r"signup number [0-5]\b"],
        "referral": [r"signup number 6\b"],
        "status_update": [r"view number 0\b"],
        "application_confirmation": [r"signup number 7\b"],
        "contact": [r"number 8\b"],
    },
    labels={
        "offer": [r"purchase number 5\b"],
        "head_hunter": [r"click number [89]\b"],
        "noise": [r"error number [0-6]\b"],
        "job_application": [r"signup number [89]\b"],
        "interview_invite": [r"click number [4-7]\b"],
        "other": [r"view number [1-5]\b"],
        "referral": [r"purchase number 6\b"],
        "ghosted": [r"view number 6\b"],
    },
    vetoes={"noise": [r"error number 3\b"], "head_hunter": [r"role 0"], "referral": [r"role 1"]},
)


@query("c01_c02_rule_classification", _oracle(TABLE_RULES))
def _(t):
    heads = email_domain("sender").isin("d3.example.com", "d7.example.com")
    return t.messages.select("id", classify(F.col("subject"), F.col("body"), TABLE_RULES, headhunter=heads).alias("label"))


@query("c03_c04_simple_rules_before_after", "WITH x AS (SELECT CASE WHEN regexp_matches(body, '(?i)purchase number [0-4]') THEN 'rejection' WHEN regexp_matches(body, '(?i)signup') THEN 'job_application' END AS old_label, CASE WHEN regexp_matches(body, '(?i)purchase number [0-4]|view number 9') THEN 'rejection' WHEN regexp_matches(body, '(?i)signup') THEN 'job_application' END AS new_label FROM messages) SELECT old_label, new_label, count(*) AS n FROM x GROUP BY ALL")
def _(t):
    def simple(rejection: list[str]) -> Column:
        return F.when(matches(F.col("body"), rejection), "rejection").when(matches(F.col("body"), ["signup"]), "job_application")

    old, new = simple(["purchase number [0-4]"]), simple(["purchase number [0-4]", "view number 9"])
    return t.messages.groupBy(old.alias("old_label"), new.alias("new_label")).agg(F.count("*").alias("n"))


@query("c05_application_related", "SELECT id FROM messages WHERE regexp_matches(subject || ' ' || substr(body, 1, 500), '(?is)(?:role [12]\\b|signup number 9)')")
def _(t):
    return t.messages.filter(matches(F.concat_ws(" ", "subject", F.substring("body", 1, 500)), [r"role [12]\b", "signup number 9"])).select("id")


@query("c06_arbitration", "SELECT id, CASE WHEN regexp_matches(body, '(?i)purchase') THEN 'rejection' ELSE ml_label END AS label, CASE WHEN regexp_matches(body, '(?i)purchase') THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN regexp_matches(body, '(?i)purchase') THEN 'rule' WHEN ml_label IS NOT NULL THEN 'ml' ELSE 'none' END AS source FROM messages")
def _(t):
    label, confidence, source = arbitrate(F.when(matches(F.col("body"), ["purchase"]), "rejection"), F.col("ml_label"), F.col("confidence"))
    return t.messages.select("id", label.alias("label"), confidence.alias("confidence"), source.alias("source"))


@query("c08_post_adjustment", "SELECT id, CASE WHEN ml_label = 'interview_invite' AND contains(lower(body), 'offer') THEN 'other' WHEN ml_label = 'interview_invite' AND contains(body, 'number 4') AND confidence < 0.7 THEN 'other' WHEN ml_label IN ('other', 'response') AND contains(body, 'number 5') THEN 'interview_invite' ELSE ml_label END AS label FROM messages")
def _(t):
    return t.messages.select("id", adjusted(F.col("ml_label"), F.col("body"), F.col("confidence"), "offer", "number 4", "number 5").alias("label"))


@query("c09_overrides", "WITH x AS (SELECT *, company_id % 20 AS d FROM messages) SELECT id, CASE WHEN d = 8 THEN 'noise' WHEN d = 9 AND NOT contains(body, 'signup') THEN 'noise' WHEN d IN (3, 7) AND ml_label IN ('job_application', 'interview_invite', 'rejection', 'prescreen') THEN 'head_hunter' WHEN starts_with(subject, 'Fwd:') THEN 'other' WHEN company_id = 77 THEN 'other' ELSE ml_label END AS label FROM x")
def _(t):
    d = email_domain("sender")
    label = overridden(F.col("ml_label"), personal=d == "d8.example.com", job_board=d == "d9.example.com", headhunter=d.isin("d3.example.com", "d7.example.com"), confirmation=F.col("body").contains("signup"), forwarded=F.col("subject").startswith("Fwd:"), user_sent=F.col("company_id") == 77)
    return t.messages.select("id", label.alias("label"))


@query("c11_status_dates", "SELECT id, CASE WHEN contains(body, 'click') THEN CAST(ts AS DATE) END AS response_date, CASE WHEN contains(body, 'purchase') THEN CAST(ts AS DATE) END AS rejection_date FROM messages")
def _(t):
    dates = status_dates(F.col("body"), F.to_date("ts"), {"response": ["click"], "rejection": ["purchase"]})
    return t.messages.select("id", dates.alias("d")).select("id", "d.*")


@query("c12_auto_review", "SELECT id FROM messages WHERE confidence >= 0.85 AND ml_label IS DISTINCT FROM 'noise' AND company_id % 2 = 0")
def _(t):
    return t.messages.filter(auto_review(F.col("ml_label"), F.col("confidence"), F.col("company_id") % 2 == 0)).select("id")


@query("c16_reclassify_compare", "WITH x AS (SELECT id, ml_label AS old_label, CASE WHEN id % 7 = 0 THEN 'other' ELSE ml_label END AS new_label, confidence AS old_conf, CASE WHEN id % 4 = 0 THEN confidence + 0.25 ELSE confidence END AS new_conf FROM messages WHERE NOT reviewed) SELECT id, old_label, new_label FROM x WHERE old_label IS DISTINCT FROM new_label OR abs(new_conf - old_conf) > 0.05")
def _(t):
    x = t.messages.filter(~F.col("reviewed")).select("id", F.col("ml_label").alias("old_label"), F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("ml_label")).alias("new_label"), F.col("confidence").alias("old_conf"), F.when(F.col("id") % 4 == 0, F.col("confidence") + 0.25).otherwise(F.col("confidence")).alias("new_conf"))
    return changed(x).select("id", "old_label", "new_label")


def changed(rows: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows whose label, or confidence by more than ``least``, is new."""
    return rows.filter(~F.col("old_label").eqNullSafe(F.col("new_label")) | (F.abs(F.col("new_conf") - F.col("old_conf")) > least))


@query("c17_real_changes", "WITH x AS (SELECT id, coalesce(ml_label, '') AS old_label, CASE WHEN id % 7 = 0 THEN 'other' WHEN id % 5 = 0 THEN upper(coalesce(ml_label, '')) || ' ' ELSE coalesce(ml_label, '') END AS new_label FROM messages) SELECT lower(trim(old_label)) = lower(trim(new_label)) AS cosmetic, count(*) AS n FROM x WHERE old_label <> new_label GROUP BY 1")
def _(t):
    old = F.coalesce("ml_label", F.lit(""))
    new = F.when(F.col("id") % 7 == 0, "other").when(F.col("id") % 5 == 0, F.concat(F.upper(old), F.lit(" "))).otherwise(old)
    return t.messages.select(old.alias("o"), new.alias("n_")).filter("o <> n_").groupBy((F.lower(F.trim("o")) == F.lower(F.trim("n_"))).alias("cosmetic")).agg(F.count("*").alias("n"))


@query("c18_disagreements", "SELECT id, ml_label FROM messages WHERE reviewed AND ml_label IS DISTINCT FROM CASE WHEN contains(body, 'purchase') THEN 'rejection' WHEN contains(body, 'signup') THEN 'job_application' END")
def _(t):
    predicted = F.when(F.col("body").contains("purchase"), "rejection").when(F.col("body").contains("signup"), "job_application")
    return t.messages.filter(F.col("reviewed") & ~F.col("ml_label").eqNullSafe(predicted)).select("id", "ml_label")


@query("c21_rule_explanation", "SELECT id, array_to_string(list_filter(['noise', 'other', 'interview_invite'], lambda l: CASE l WHEN 'noise' THEN regexp_matches(body, '(?i)error number [0-6]\\b') WHEN 'other' THEN regexp_matches(body, '(?i)view number [1-5]\\b') ELSE regexp_matches(body, '(?i)click number [4-7]\\b') END), ',') AS labels FROM messages")
def _(t):
    found = explain(F.col("body"), {"noise": [r"error number [0-6]\b"], "other": [r"view number [1-5]\b"], "interview_invite": [r"click number [4-7]\b"]})
    return t.messages.select("id", F.array_join(F.transform(found, lambda p: p["label"]), ",").alias("labels"))


@query("c21_highlights")
def _(t):
    m = t.messages.select("id", F.concat_ws(" ", "subject", "body").alias("text"))
    hits, _ = highlights(F.col("text"), TABLE_RULES)
    rows = m.select("id", "text", hits.alias("hits")).withColumn("marks", joined_spans(F.flatten(F.transform("hits", lambda h: h["spans"]))))
    shown = F.transform("marks", lambda x: F.substring("text", x["start"] + 1, x["end"] - x["start"]))
    places = F.transform("marks", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return rows.select("id", F.array_join(F.transform("hits", lambda h: h["list"]), ",").alias("lists"), F.array_join(places, ",").alias("places"), F.array_join(shown, "|").alias("shown"))


@query("m10_m19_label_vocabulary", "SELECT CASE lower(status) WHEN 'rejected' THEN 'rejection' WHEN 'interview' THEN 'interview_invite' WHEN 'application' THEN 'job_application' WHEN 'headhunter' THEN 'head_hunter' ELSE lower(status) END AS label, count(*) AS n FROM companies GROUP BY 1")
def _(t):
    return t.companies.groupBy(canonical_label("status").alias("label")).agg(F.count("*").alias("n"))

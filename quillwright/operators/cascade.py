"""The employer of a mail from its subject, sender and body (E06, F18, F19): candidates in a fixed order, each with its own guard.

A stage offers a value; where the stage's guard refuses it (a person, a job title, no valid name, too short), the next stage is
asked. What the sender's display name says is remembered early and taken up twice: at once if it looks like an organisation, and in the
end if nothing else was found. Dictionaries (known names, aliases, domains) are DataFrames and are met by joins: equality on
lower-case names, suffixes for domains, ``matching.held_names`` for names inside texts. Everything else is column expressions, and
a stage's expression is evaluated only where the stages before it gave nothing (``coalesce``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import address, display_name, email_domain, normal_name, valid_name
from ..plans.lineage import written
from ..registry import query
from .matching import first_by_order, held_names
from .resolve import plain_body, resolve, suffix_join

# fixed values: patterns, their flags (i: whatever the case; \w, \s and \b are Unicode's, as (?U) says) and words, in the order of their use
REPLY = r"^(Re|RE|Fwd|FW|Fw):\s*"
MEETING = r"meeting id|passcode|join.*meeting|zoom\.us|teams\.microsoft"
ENCODED = r"(?:[A-Za-z0-9+/]{60,}\n?)+"
ORGANIZER = r"ORGANIZER[^:]*:mailto:([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
SENT_TO = r"(?:the following items were sent to|sent to)\s+([A-Z][A-Za-z0-9\s&.,'-]+?)\s*[.\n]"
LINKED = r"<strong>\s*<a[^>]+>([A-Z][A-Za-z0-9\s&.,'-]+?)</a>\s*</strong>.*?about your application"
SENT_TO_TAIL = r"\s+(and|About|Your|Application|Details)$"
CONFIRMATIONS = (
    r"position\s+(?:here\s+)?at\s+([A-Z][A-Za-z0-9\s&.,'-]+?)(?:\.|[\r\n]|\s+Thank)",
    r"position\s+(?:here\s+)?(?:at|with)\s+([A-Z][A-Za-z0-9\s&.,'-]{2,30})[\r\n.]",
    r"application\s+for\s+(?:our|the)\s+.{5,50}?\s+at\s+([A-Z][A-Za-z0-9\s&.,'-]+?)(?:\.|[\r\n])",
    r"considering\s+us\s+at\s+([A-Z][A-Za-z0-9\s&.,'-]+?)\s+as",
    r"considering\s+([A-Z][A-Za-z0-9\s&.,'-]+?)\s+as\s+(?:a\s+)?(?:potential|future)\s+employer",
)
CONFIRMATION_TAIL = r"\s+(and|the|a|as|at|for|with|in)$"
AGENCY_DOMAIN, AGENCY = "intelligencecareers.gov", r"application to (?:the\s+)?([A-Z][A-Za-z0-9\s&.,'-]+?)(?:\s+\(|\!|\.|$)"
SYSTEM_WORDS = r"\b(Workday|Recruiting Team|Careers|Talent Acquisition Team|HR|Hiring|Notification|Notifications|Team|Portal)\b"
SYSTEM_TAIL = r"\s*@\s*(icims|workday|greenhouse|lever|indeed)\s*$"
ORGANISATION_WORDS = ("Corporation", "Inc", "LLC", "Ltd", "Group", "Technologies", "Systems")
COLON = r"^([A-Z][A-Za-z0-9&.\- ]+):"
SPECIAL = r"applying for ([\w\s\-]+) position @ ([A-Z][\w\s&\-]+)"
SUBJECTS = (
    (r"^([A-Z][a-zA-Z]+(?:\s+(?:[A-Z][a-zA-Z]+|&[A-Z]?))*?)(?:\s+application|\s+-)", "i"),
    (r"application (?:to|for|with)\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"(?:from|with|at)\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"position\s+@\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"^([A-Z][\w&-]+(?:\s+[\w&-]+){0,2}?)\s+(?:Job|Application|Interview)\b", "i"),
    (r"-\s*([A-Z][\w&-]+(?:\s+[\w&-]+){0,2}?)\s*-\s*", ""),
    (r"-\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})$", ""),
    (r"(?:your application with|application with|interest in|position at)\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"update on your ([A-Z][\w&-]+(?:\s+[\w&-]+){0,2}) application\b", "i"),
    (r"thank you for your application with\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"thank you for applying to\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"applying to\s+([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"@\s*([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
    (r"applying for ([\w\s\-]{1,50}) position @ ([A-Z][\w&-]+(?:\s+[\w&-]+){0,2})\b", "i"),
)
TITLES = r"\b(CTO|Engineer|Manager|Director|Intern|Analyst)\b"
CORPORATE = ("inc", "llc", "ltd", "co", "corp", "corporation", "company", "technologies", "systems", "group")


def _re(pattern: str, flags: str = "i") -> str:
    return f"(?{flags}U){pattern}"


def _found(c: Column, pattern: str, flags: str = "i", group: int = 1) -> Column:
    """The group of the first match, trimmed; null if there is none or it is blank."""
    return F.nullif(F.trim(F.regexp_extract(c, _re(pattern, flags), group)), F.lit(""))


def _without(c: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(c, _re(pattern), ""))


def _bare_end(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,;:]+$", "")


def personal(name: Column) -> Column:
    """A person's name by its look: two capitalised words of at most twelve letters, or one of at most ten; no corporate word."""
    n = F.trim(name)
    words = F.split(n, r"\s+")
    shaped = F.forall(words, lambda w: w.rlike(r"^[A-Z][a-z]+(?:-[A-Z][a-z]+)?$"))
    corporate = F.exists(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", "").isin(*CORPORATE))
    short = ((F.size(words) == 2) & F.forall(words, lambda w: F.length(w) <= 12)) | ((F.size(words) == 1) & (F.length(n) <= 10))
    return F.coalesce((F.length(n) <= 40) & shaped & short & ~corporate, F.lit(False))


def unwrapped(display: Column) -> Column:
    """F20 on a display name: the part after " @ " or " at " if the part before it is a person."""
    at = F.contains(display, F.lit(" @ "))
    split = F.when(at, F.split(display, " @ ", 2)).otherwise(F.split(display, _re(r"\s+at\s+"), 2))
    first, second = F.trim(F.get(split, F.lit(0))), F.trim(F.get(split, F.lit(1)))
    return F.when(personal(first) & (second != ""), second).otherwise(display)


def remembered_name(display: Column) -> Column:
    """the display name without a person before it and words that mail systems add; null at two characters or less."""
    bare = _without(_without(unwrapped(display), SYSTEM_WORDS), SYSTEM_TAIL)
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.length(bare) > 2, bare)


def organizer_domain(body: Column) -> Column:
    """The domain of the organizer in base64-coded calendar data of a body; null if there is none."""
    texts = F.transform(F.regexp_extract_all(body, F.lit(f"({ENCODED})"), F.lit(1)), lambda x: F.try_to_binary(F.regexp_replace(x, "[\r\n]", ""), F.lit("base64")).cast("string"))
    calendars = F.filter(texts, lambda x: F.contains(x, F.lit("BEGIN:VCALENDAR")) | F.contains(x, F.lit("ORGANIZER")))
    found = F.filter(F.transform(calendars, lambda x: F.lower(F.regexp_extract(x, _re(ORGANIZER), 1))), lambda x: x != "")
    return F.when(body.rlike(ENCODED), F.substring_index(F.get(found, F.lit(0)), "@", -1))


class _Offers:
    """Stages in order: (name, condition, value, guard). A value counts where the condition and the guard hold."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Column, Column, Callable[[Column], Column]]] = []

    def add(self, name: str, when: Column, value: Column, guard: Callable[[Column], Column] = lambda v: F.lit(True)) -> None:
        self.stages.append((name, F.coalesce(when, F.lit(False)), value, guard))

    def first(self) -> Column:
        """struct(company, stage) of the first stage with a value; a value is worked out once, for the stage's guard and result."""

        def offer(name: str, when: Column, value: Column, guard) -> Column:
            one = F.transform(F.array(value), lambda v: F.when(v.isNotNull() & guard(v), F.struct(v.alias("company"), F.lit(name).alias("stage"))))
            return F.when(when, F.get(one, F.lit(0)))

        return F.coalesce(*(offer(*stage) for stage in self.stages))

    def refused(self) -> Column:
        """The names of the stages whose guard refuses what they would offer, whether they are reached or not."""
        return F.array_compact(F.array(*(F.when(when & value.isNotNull() & ~guard(value), F.lit(name)) for name, when, value, guard in self.stages)))


def subject_company(mails: DataFrame, domains: DataFrame, names: DataFrame, aliases: DataFrame, explain: bool = False) -> DataFrame:
    """``mails`` (id, subject, sender, body, ...) with ``company``, ``stage`` (that found it) and ``canonical`` (alias, known or after_at, if it was replaced).

    ``domains``: domain, kind (ats, company, ...), company, ord; ``names``: name, ord; ``aliases``: alias, company, ord. ``id`` is unique.
    ``explain`` adds ``refused``, the stages with a value that their guard refuses. Nulls count as empty texts; a mail without any
    candidate has null in ``company`` and ``stage``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    contents = mails.select("id", text("subject").alias("whole"), text("sender").alias("sender"), text("body").alias("body"))
    # mails repeat, from templates: each distinct one is worked out once, under a number of its own
    each = written(contents.select("whole", "sender", "body").distinct().withColumn("id", F.monotonically_increasing_id()), "distinct-mails")
    rows = each
    rows = rows.withColumn("subject", F.trim(F.regexp_replace(F.trim("whole"), _re(REPLY), ""))).withColumn("plain", F.coalesce(plain_body("body"), F.lit("")))
    host, organizer = email_domain("sender"), organizer_domain(F.col("body"))
    rows = rows.withColumn("host", F.when(organizer.isNotNull() & (host.isNull() | F.col("body").rlike(_re(MEETING))), organizer).otherwise(host))
    rows = rows.withColumn("display", display_name("sender")).withColumn("shown", F.trim(unwrapped(F.col("display"))))
    rows = rows.withColumn("prefix", F.substring_index(F.substring_index(F.lower(F.trim(address("sender"))), "@", 1), "+", 1)).withColumn("kept", remembered_name(F.col("display")))
    rows = suffix_join(rows, "host", domains.filter("kind = 'ats'").select("domain", "ord", F.lit(True).alias("ats")), small=False).drop("matched", "ord")
    rows = suffix_join(rows, "host", domains.filter("kind = 'company'").select("domain", "ord", F.col("company").alias("mapped")), small=False).drop("matched", "ord")
    rows = written(rows.withColumn("ats", F.coalesce("ats", F.lit(False))), "mail-senders")
    spelled = first_by_order(names, F.lower("name"), ["name"])
    canonical = first_by_order(aliases, F.lower("alias"), ["company"])

    def looked_up(df: DataFrame, c: str, dim: DataFrame, value: str, out: str) -> DataFrame:
        return df.join(dim.select(F.col("k").alias("k_"), F.col(value).alias(out)), F.lower(c) == F.col("k_"), "left").drop("k_")

    for c, out in (("shown", "shown"), ("prefix", "prefix"), ("kept", "kept")):
        rows = looked_up(rows, c, spelled, "name", f"{out}_known")
    for c in ("shown", "prefix"):
        rows = looked_up(rows, c, canonical, "company", f"{c}_alias")
    inside = held_names(rows, "id", "subject", names, whole_words=False).select("id", F.col("name").alias("subject_known"))
    rows = rows.join(inside, "id", "left")
    # which of the names that the subject's patterns give are known ones
    given = F.array(*(F.nullif(normal_name(_found(F.col("subject"), p, f)), F.lit("")) for p, f in SUBJECTS))
    rows = rows.withColumn("patterns", given)
    doubtful = rows.select("id", F.explode(F.array_distinct(F.filter("patterns", lambda v: v.isNotNull() & personal(v)))).alias("v"))
    cleared = doubtful.join(spelled, F.lower("v") == F.col("k"), "left_semi").groupBy("id").agg(F.collect_set("v").alias("cleared"))
    rows = rows.join(cleared, "id", "left").withColumn("cleared", F.coalesce("cleared", F.array().cast("array<string>")))

    subject, low, plain = F.col("subject"), F.lower("whole"), F.col("plain")
    application = F.contains(low, F.lit("application")) | F.contains(low, F.lit("applying")) | F.contains(low, F.lit("applied"))
    body = F.col("body") != ""
    early = _Offers()
    sender = F.col("ats") & (F.col("sender") != "")
    early.add("ats_display_known", sender, F.col("shown_known"))
    early.add("ats_display_alias", sender, F.col("shown_alias"))
    early.add("ats_prefix_alias", sender, F.col("prefix_alias"))
    early.add("ats_prefix_known", sender, F.col("prefix_known"))
    sent = F.coalesce(_found(plain, SENT_TO), _found(F.col("body"), LINKED, "is"))
    early.add("sent_to_body", body & low.rlike(r"\bapplication\b"), _bare_end(_without(sent, SENT_TO_TAIL)), lambda v: (F.length(v) > 2) & valid_name(v))
    for k, pattern in enumerate(CONFIRMATIONS):
        early.add(f"confirmation_{k}", body & application, normal_name(_bare_end(_without(_found(plain, pattern), CONFIRMATION_TAIL))), lambda v: (F.length(v) > 1) & valid_name(v))
    early.add("agency_body", body & application & (F.col("host") == AGENCY_DOMAIN), normal_name(_found(plain, AGENCY)), valid_name)
    rows = rows.withColumn("found", early.first())
    # what is remembered: only where a confirmation's body gave nothing so far
    rows = rows.withColumn("kept", F.when(F.col("found").isNull() & body & application, F.col("kept")))
    words = F.split("kept", " ")
    looks = (F.size(words) >= 3) | F.exists(words, lambda w: F.length(w) > 12)
    for w in ORGANISATION_WORDS:
        looks |= F.contains("kept", F.lit(w))
    late = _Offers()
    late.add("domain_map", ~F.col("ats"), F.col("mapped"))
    late.add("known_in_subject", F.lit(True), F.col("subject_known"))
    late.add("display_organisation", F.lit(True), F.col("kept"), lambda v: F.col("kept_known").isNotNull() | looks)
    late.add("colon_prefix", F.lit(True), _found(subject, COLON, ""))
    for k in range(len(SUBJECTS)):
        late.add(f"subject_{k}", F.lit(True), F.get("patterns", F.lit(k)), lambda v: ~personal(v) | F.array_contains("cleared", v))
    special = F.struct(_found(subject, SPECIAL, "", 2).alias("company"), F.lit("special_position").alias("stage"))
    rows = rows.withColumn("found", F.when(special["company"].isNotNull(), special).otherwise(F.coalesce("found", late.first())))
    if explain:
        rows = rows.withColumn("refused", F.concat(early.refused(), late.refused()))
    rows = written(rows.withColumn("company", F.col("found.company")).withColumn("stage", F.col("found.stage")).drop("found", "patterns", "cleared"), "mail-offers")

    # known spellings inside the found name or the subject, or what stands after "at"
    both = rows.filter("company IS NOT NULL").select("id", F.concat_ws("\n", "company", "subject").alias("both"))
    by_alias = held_names(both, "id", "both", aliases.select(F.col("alias").alias("name"), "ord", "company"), longest=False).select("id", F.col("company").alias("by_alias"))
    by_name = held_names(both, "id", "both", names, whole_words=False, longest=False).select("id", F.col("name").alias("by_name"))
    rows = rows.join(by_alias, "id", "left").join(by_name, "id", "left")
    behind = F.coalesce(_found(F.col("company"), r"position at\s+(.+)$"), F.when(F.col("company").rlike(_re(r"\bat\b|@")), F.nullif(F.trim(F.element_at(F.split("company", _re(r"\bat\b|@")), -1)), F.lit(""))))
    behind = F.array_join(F.slice(F.split(_without(behind, r"^the\s+"), r"\s+"), 1, 4), " ")
    behind = F.when((behind != "") & ~personal(behind), behind)
    rows = rows.withColumn("canonical", F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "known").when(behind.isNotNull(), "after_at"))
    rows = rows.withColumn("company", F.coalesce("by_alias", "by_name", behind, "company"))
    # last guards: a job title; a person, unless some dictionary, the sender or the subject's "with X" vouches for the name
    trusted = spelled.select("k").union(domains.filter("company IS NOT NULL").select(F.lower("company"))).distinct().select(F.col("k").alias("k_"), F.lit(True).alias("vouched"))
    rows = rows.join(trusted, F.lower("company") == F.col("k_"), "left").drop("k_")
    ends = F.lower(F.regexp_replace("whole", r"\s+$", ""))
    with_name = F.endswith(ends, F.lower(F.concat(F.lit("with "), "company"))) & F.regexp_replace(F.substring(ends, F.lit(1), F.length(ends) - F.length("company") - 5), r"(?U)^.*(\w)$", "$1").rlike(r"(?U)^\W?$|\W$")
    vouched = F.coalesce("vouched", F.lit(False)) | (F.col("stage") == "domain_map") | (F.col("ats") & (F.lower("company") == F.lower("display"))) | with_name
    title = F.col("company").rlike(_re(TITLES))
    gone = F.coalesce(title | (personal(F.col("company")) & ~vouched), F.lit(False))
    if explain:
        why = F.array_compact(F.array(F.when(title, F.lit("job_title")), F.when(personal(F.col("company")) & ~vouched & ~title, F.lit("person"))))
        rows = rows.withColumn("refused", F.concat("refused", F.coalesce(why, F.array().cast("array<string>"))))
    rows = rows.withColumn("gone", gone).withColumn("company", F.when(~F.col("gone"), F.nullif(F.col("company"), F.lit(""))))
    likely_person = (F.size(words) == 2) & F.forall(words, lambda w: F.length(w) < 12)
    take = F.col("company").isNull() & F.col("kept").isNotNull() & (~likely_person | F.col("kept_known").isNotNull())
    if explain:
        rows = rows.withColumn("refused", F.when(F.col("company").isNull() & F.col("kept").isNotNull() & ~take, F.array_append("refused", F.lit("display_fallback"))).otherwise(F.col("refused")))
    rows = rows.withColumn("take", take)
    company = F.nullif(normal_name(F.when(F.col("take"), F.col("kept")).otherwise(F.col("company"))), F.lit(""))
    stage = F.when(F.col("take"), "display_fallback").when(~F.col("gone"), F.col("stage"))
    out = rows.select("id", company.alias("company"), F.when(company.isNotNull(), stage).alias("stage"), F.when(company.isNotNull() & ~F.col("take"), F.col("canonical")).alias("canonical"), *(["refused"] if explain else []))
    known = written(each.join(out, "id", "left").drop("id"), "mail-companies")
    out = contents.join(known, ["whole", "sender", "body"], "left").drop("whole", "sender", "body")
    return mails.drop("company", "stage", "canonical", "refused").join(out, "id", "left")


@query("e06_f18_f19_subject_cascade")
def _(t):
    return subject_company(t.mails, t.mail_domains, t.firm_names, t.firm_aliases, explain=True).select("id", "company", "stage", "canonical", F.array_join("refused", ",").alias("refused"))


@query("e01_e13_with_subject_cascade")
def _(t):
    found = subject_company(t.mails, t.mail_domains, t.firm_names, t.firm_aliases).select("id", F.col("company").alias("subject_company"))
    return resolve(t.mails, t.mail_domains, t.firm_aliases, me="me@home.example", subject=found).select("id", "resolved", "provenance")

"""Scalar text functions (F01-F29, F51, F52) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corporate suffixes that a name loses; an input of the engine, of its own choice.
SUFFIXES = ("inc", "llc", "ltd", "corp", "gmbh", "plc")
JOB_WORDS = ("engineer", "manager", "developer", "analyst", "director", "role")
PRONE_TO_NOISE = ("no-reply", "noreply", "newsletter", "notifications")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def email_domain(sender: str | Column) -> Column:
    """domain of the address in angle brackets, else of the first address; lower case; null if there is none."""
    inside = F.regexp_extract(_c(sender), r"<[^<>@\s]+@([^<>@\s]+)>", 1)
    plain = F.regexp_extract(_c(sender), r"[^<>@\s]+@([A-Za-z0-9.-]+)", 1)
    return F.lower(F.coalesce(F.nullif(inside, F.lit("")), F.nullif(plain, F.lit(""))))


def display_name(sender: str | Column) -> Column:
    """what stands before an address in angle brackets, without quotes."""
    return F.trim(F.regexp_replace(F.regexp_extract(_c(sender), r"^(.*?)<[^>]*>\s*$", 1), '"', ""))


def address(sender: str | Column) -> Column:
    inside = F.regexp_extract(_c(sender), r"<([^>]*)>\s*$", 1)
    return F.when(inside != "", inside).otherwise(F.trim(_c(sender)))


def strip_reply(subject: str | Column) -> Column:
    """without one reply or forward prefix."""
    return F.regexp_replace(_c(subject), r"(?i)^\s*(re|fwd|fw)\s*:\s*", "")


def is_reply(subject: str | Column) -> Column:
    """F04"""
    return _c(subject).rlike(r"(?i)^\s*(re|fwd|fw)\s*:")


def normal_name(name: str | Column) -> Column:
    """without a corporate suffix and trailing separators, white space collapsed."""
    bare = F.regexp_replace(_c(name), r"(?i)[,\s]+(" + "|".join(SUFFIXES) + r")\.?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\s,.;:|-]+$", ""), r"\s+", " "))


def matching_key(name: str | Column) -> Column:
    """lower case, without commas and full stops, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_c(name), "[,.]", ""), r"\s+", " ")))


def composite_key(*parts: str | Column) -> Column:
    """parts joined by ::, the empty text for null."""
    return F.concat_ws("::", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


def valid_name(name: str | Column, bad_starts: list[str] = ()) -> Column:
    """not blank, at most eight words, no job word, none of the patterns at its start."""
    n = F.trim(_c(name))
    ok = n.isNotNull() & (n != "") & (F.size(F.split(n, r"\s+")) <= 8) & ~F.lower(n).rlike(r"\b(" + "|".join(JOB_WORDS) + r")\b")
    return F.coalesce(ok & ~n.rlike("^(?i:" + "|".join(bad_starts) + ")") if bad_starts else ok, F.lit(False))


def person_like(name: str | Column) -> Column:
    """two or three capitalised words of letters, no corporate suffix."""
    n = F.trim(_c(name))
    words = F.split(n, r"\s+")
    proper = F.forall(words, lambda w: w.rlike(r"^[A-Z][a-z]+\.?$|^[A-Z]\.?$"))
    company = F.exists(words, lambda w: F.lower(F.regexp_replace(w, r"\.", "")).isin(*SUFFIXES, "group", "firm", "company"))
    return F.coalesce((F.size(words) >= 2) & (F.size(words) <= 3) & proper & ~company, F.lit(False))


def clean_candidate(name: str | Column) -> Column:
    """without a leading article, a corporate suffix, role and noise words."""
    bare = F.regexp_replace(_c(name), r"(?i)^(the|a|an)\s+", "")
    bare = F.regexp_replace(bare, r"(?i)\b(careers?|jobs?|recruiting|talent|team|hiring|" + "|".join(JOB_WORDS) + r")\b", "")
    return normal_name(bare)


def noise_name(name: str | Column) -> Column:
    """an automatic sender's name, many digits, or no letter."""
    n = F.lower(_c(name))
    return F.coalesce(n.rlike("|".join(PRONE_TO_NOISE)) | (F.regexp_count(n, F.lit(r"\d")) >= 4) | ~n.rlike("[a-z]"), F.lit(True))


def token_jaccard(a: str | Column, b: str | Column) -> Column:
    """share of common words among all words of two names."""
    x, y = (F.array_distinct(F.split(matching_key(c), " ")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def job_id(subject: str | Column) -> Column:
    """F16: an id after 'job', 'req' or '#'; null if there is none."""
    return F.nullif(F.regexp_extract(_c(subject), r"(?i)(?:job|req(?:uisition)?|id|#)[\s:#-]*([A-Z]?-?\d{3,})", 1), F.lit(""))


def job_title(subject: str | Column) -> Column:
    """what an application is for, up to the employer; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(_c(subject), r"(?i)application for (.+?)(?: at | with |$)", 1)), F.lit(""))


#: Subject patterns in the order of their use; group 1 is the employer.
SUBJECT_PATTERNS = (r"(?i)\bat ([A-Z][\w&. -]*?)\s*$", r"(?i)^your application (?:to|with) (.+?)(?:[!.]|$)", r"(?i)^(.+?) (?:application|interview) (?:update|invitation)")


def first_match(c: str | Column, patterns: tuple[str, ...]) -> Column:
    """group 1 of the first pattern that matches, trimmed; null if none does."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(_c(c), p, 1)), F.lit("")) for p in patterns))


def person_at_company(name: str | Column) -> Column:
    """'Person @ Company' as a struct; nulls where it isn't of that form."""
    person, company = (F.nullif(F.trim(F.regexp_extract(_c(name), r"^([^@]+)@\s*([^@]+)$", i)), F.lit("")) for i in (1, 2))
    ok = person_like(person)
    return F.struct(F.when(ok, person).alias("person"), F.when(ok, company).alias("company"))


def ats_display_name(name: str | Column) -> Column:
    """a sender's display name without words that mail systems add."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(name), r"(?i)\b(via|from|at)\s+\S+\s*$", ""), r"(?i)\b(careers?|hiring team|talent acquisition|recruiting|workday|no-?reply)\b", ""))


def title_label(label: str | Column) -> Column:
    """F22"""
    return F.initcap(F.replace(_c(label), F.lit("_"), F.lit(" ")))


def snippet(body: str | Column, length: int = 200) -> Column:
    """one line of at most ``length`` characters."""
    return F.trim(F.regexp_replace(_c(body), r"\s+", " ")).substr(1, length)


def first_lines(body: str | Column, lines: int = 30) -> Column:
    return F.array_join(F.slice(F.split(_c(body), "\n"), 1, lines), "\n")


# fixed values: operators of a mail query, characters that a pattern escapes, fragments and limits of unsafe input
QUERY_OPERATORS = ("label", "from", "to", "subject", "in", "is", "has", "before", "after")
SPECIAL = r"[\s#$&()*+\-.?\[\\\]^{|}~]"
UNSAFE = ("<script", "javascript:", "onerror=", "onload=", "<?php", "<%", "__import__", "eval(", "exec(", "../", "..\\", "%2e%2e", "\x00")
UNSAFE_PATTERNS = (r"\(\?#", r"\(\?=.*\)\+", r"\(\?!.*\)\+", r"(\(.*\)\+){3,}")
PATTERN_LENGTH, PATTERN_QUANTIFIERS = 500, 20


def query_terms(text: str | Column) -> Column:
    """terms of a mail query: words of three characters or more, then quoted phrases, once each whatever the case, escaped for a pattern."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "(?i)(" + "|".join(QUERY_OPERATORS) + "):", " ")
    words = F.split(F.regexp_replace(bare, '"[^"]+"', " "), r"[^A-Za-z0-9@._'+-]+")
    every = F.filter(F.concat(words, F.regexp_extract_all(bare, F.lit('"([^"]+)"'), F.lit(1))), lambda t: F.length(t) >= 3)
    low = F.transform(every, F.lower)
    first = F.filter(every, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return F.transform(first, lambda t: F.regexp_replace(t, f"({SPECIAL})", r"\\$1"))


def any_term(terms: Column) -> Column:
    """one pattern for all terms; null for none."""
    return F.when(F.size(terms) > 0, F.concat(F.lit("("), F.array_join(terms, "|"), F.lit(")")))


def safe_pattern(pattern: str | Column) -> Column:
    """not blank, not too long or intricate, none of the unsafe constructs. (Whether it compiles is left to the rule's compiler.)"""
    p = _c(pattern)
    bad = p.rlike("|".join(f"(?:{x})" for x in UNSAFE_PATTERNS)) | (F.length(p) > PATTERN_LENGTH) | (F.regexp_count(p, F.lit(r"[*+?{]")) > PATTERN_QUANTIFIERS)
    return F.coalesce((p != "") & ~bad, F.lit(False))


def sanitised_input(value: str | Column, longest: int = 200, pattern: bool = False) -> Column:
    """trimmed input, with HTML characters escaped (a pattern stays as it is); null if blank, too long or unsafe."""
    v = F.regexp_replace(_c(value), r"^\s+|\s+$", "")
    low = F.lower(v)
    bad = F.exists(F.array(*(F.lit(x) for x in UNSAFE)), lambda x: low.contains(x))
    ok = (v != "") & (F.length(v) <= longest) & ~bad & (safe_pattern(v) if pattern else F.lit(True))
    shown = v
    for raw, escaped in (() if pattern else (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))):
        shown = F.replace(shown, F.lit(raw), F.lit(escaped))
    return F.when(ok, shown)


def split_part(value: str | Column, separator: str, at: int) -> Column:
    """one part of a separated value (from 0); null beyond the last."""
    return F.get(F.split(_c(value), F.lit(separator).cast("string")) if separator.isalnum() else F.split(_c(value), "[" + separator + "]"), F.lit(at))


def percentage(share: str | Column, digits: int = 1) -> Column:
    """a share of 1 as a percentage; null and 0 give 0."""
    return F.round(F.coalesce(_c(share).cast("double"), F.lit(0.0)) * 100, digits)


def without_headers(body: str | Column) -> Column:
    """without a block of mail headers at the very start."""
    return F.regexp_replace(_c(body), r"(?i)^(?:(?:from|to|cc|subject|date|sent|reply-to):[^\n]*\n)+\n*", "")


def valid_domain(domain: str | Column) -> Column:
    """labels of letters, digits and inner hyphens; at least two; at most 253 characters."""
    d = F.lower(F.trim(_c(domain)))
    return F.coalesce((F.length(d) <= 253) & d.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"), F.lit(False))


def domain_suffixes(domain: str | Column) -> Column:
    """the domain and each domain above it, longest first."""
    labels = F.split(F.lower(_c(domain)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registrable_domain(url: str | Column) -> Column:
    """the last two labels of a URL's host."""
    host = F.lower(F.regexp_extract(_c(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.substring_index(F.regexp_replace(host, r"^www\.", ""), ".", -2), F.lit(""))


def host_name_guess(url: str | Column) -> Column:
    """a name guessed from the registrable domain."""
    return F.initcap(F.replace(F.substring_index(registrable_domain(url), ".", 1), F.lit("-"), F.lit(" ")))


def mentions_any(text: str | Column, words: list[str]) -> Column:
    """whether a text holds one of the words, whatever the case."""
    low = F.lower(_c(text))
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: low.contains(w))


def body_hash(body: str | Column) -> Column:
    """SHA-256 of the body, white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(_c(body), F.lit("")), r"\s+", " ")), 256)

"""The subject cascade's registered query against a plain loop over stages and dictionaries; the matcher against a loop over names."""

import base64
import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillwright import registry
from quillwright.operators import cascade as c
from quillwright.operators import matching
from quillwright.operators.matching import held_names
from quillwright.plans.adapters import Tables

FOLDER = "/root/testdata/sf0.001"
SUFFIX = re.compile(r"(?i)[,\s]+(inc|llc|ltd|corp|gmbh|plc)\.?\s*$")


def normal(v):
    return re.sub(r"\s+", " ", re.sub(r"[\s,.;:|-]+$", "", SUFFIX.sub("", v))).strip(" ") if v else None


def valid(v):
    v = (v or "").strip(" ")
    return bool(v) and len(re.split(r"\s+", v)) <= 8 and not re.search(r"\b(engineer|manager|developer|analyst|director|role)\b", v.lower())


def person(v):
    v = (v or "").strip(" ")
    w = v.split()
    if not w or len(v) > 40 or any(x.lower().strip(".,") in c.CORPORATE for x in w) or not all(re.fullmatch(r"[A-Z][a-z]+(?:-[A-Z][a-z]+)?", x) for x in w):
        return False
    return (len(w) == 2 and all(len(x) <= 12 for x in w)) or (len(w) == 1 and len(v) <= 10)


def group(pattern, text, flags=re.I, n=1):
    m = re.search(pattern, text, flags)
    return (m[n].strip(" ") or None) if m else None


def unwrap(display):
    parts = display.split(" @ ", 1) if " @ " in display else re.split(r"\s+at\s+", display, maxsplit=1, flags=re.I)
    return parts[1].strip() if len(parts) == 2 and person(parts[0]) and parts[1].strip() else display


def under(host, domains):
    return [(d, v) for d, v in domains if host and (host == d or host.endswith("." + d))]


def brute(mail, domains, names, aliases):
    """(company, stage, canonical) of one mail; dictionaries are lists in order."""
    whole, sender, body = (mail[k] or "" for k in ("subject", "sender", "body"))
    known, nick = {n.lower(): n for n in reversed(names)}, {a.lower(): v for a, v in reversed(aliases)}
    subject = re.sub(c.REPLY, "", whole.strip(" "), flags=re.I).strip(" ")
    plain = " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(style|script)\b.*?</\1>", " ", body)).split()) if re.search("<html|<style", body.lower()) else body
    address = (re.search(r"<([^>]*)>\s*$", sender) or [None, sender.strip()])[1]
    display = (m[1].replace('"', "").strip(" ") if (m := re.match(r"^(.*?)<[^>]*>\s*$", sender)) else "")
    host = address.split("@")[1].lower() if "@" in address else None
    for block in re.findall(c.ENCODED, body):
        m = re.search(c.ORGANIZER, base64.b64decode(block.replace("\n", "")).decode(errors="ignore"), re.I)
        if m and (host is None or re.search(c.MEETING, body, re.I)):
            host = m[1].lower().split("@")[1]
    ats = bool(under(host, [(d, 1) for d, k, _ in domains if k == "ats"]))
    mapped = under(host, [(d, v) for d, k, v in domains if k == "company"])
    mapped = sorted(mapped, key=lambda x: x[0] != host)[0][1] if mapped else None
    application = any(w in whole.lower() for w in ("application", "applying", "applied"))
    found = kept = None

    def offer(stage, value, ok=True):
        nonlocal found
        if found is None and value and ok:
            found = (value, stage)

    if ats:
        shown, prefix = unwrap(display).strip().lower(), address.lower().split("@")[0].split("+")[0]
        offer("ats_display_known", known.get(shown))
        offer("ats_display_alias", nick.get(shown))
        offer("ats_prefix_alias", nick.get(prefix))
        offer("ats_prefix_known", known.get(prefix))
    if body and re.search(r"\bapplication\b", whole, re.I):
        v = group(c.SENT_TO, plain) or group(c.LINKED, body, re.I | re.S)
        v = v and re.sub(c.SENT_TO_TAIL, "", v, flags=re.I).strip(" ").rstrip(".,;:")
        offer("sent_to_body", v, v and len(v) > 2 and valid(v))
    if body and application:
        for k, p in enumerate(c.CONFIRMATIONS):
            v = group(p, plain)
            v = v and normal(re.sub(c.CONFIRMATION_TAIL, "", v, flags=re.I).strip(" ").rstrip(".,;:"))
            offer(f"confirmation_{k}", v, v and len(v) > 1 and valid(v))
        if host == c.AGENCY_DOMAIN:
            v = normal(group(c.AGENCY, plain))
            offer("agency_body", v, valid(v))
        if not found:
            kept = re.sub(r"\s+", " ", re.sub(c.SYSTEM_TAIL, "", re.sub(c.SYSTEM_WORDS, "", unwrap(display), flags=re.I).strip(" "), flags=re.I)).strip(" ")
            kept = kept if len(kept) > 2 else None
    if not ats:
        offer("domain_map", mapped)
    inside = [n for n in names if n.lower() in subject.lower()]
    offer("known_in_subject", max(inside, key=lambda n: (len(n), -names.index(n)), default=None))
    if kept:
        offer("display_organisation", kept, kept.lower() in known or len(kept.split()) >= 3 or any(w in kept for w in c.ORGANISATION_WORDS) or any(len(w) > 12 for w in kept.split()))
    offer("colon_prefix", group(c.COLON, subject, 0))
    for k, (p, flags) in enumerate(c.SUBJECTS):
        v = normal(group(p, subject, re.I if flags else 0))
        offer(f"subject_{k}", v, v and (not person(v) or v.lower() in known))
    if v := group(c.SPECIAL, subject, 0, 2):
        found = (v, "special_position")
    company, stage = found or (None, None)
    canonical = None
    if company:
        both = company + "\n" + subject
        if hit := [v for a, v in aliases if re.search(r"\b" + re.escape(a) + r"\b", both, re.I)]:
            company, canonical = hit[0], "alias"
        elif hit := [n for n in names if n.lower() in both.lower()]:
            company, canonical = hit[0], "known"
        else:
            after = group(r"position at\s+(.+)$", company)
            parts = re.split(r"\bat\b|@", company, flags=re.I)
            after = after or (parts[-1].strip(" ") if len(parts) > 1 else "")
            after = " ".join(re.sub(r"^the\s+", "", after, flags=re.I).split()[:4])
            if after and not person(after):
                company, canonical = after, "after_at"
        if re.search(c.TITLES, company, re.I):
            company = None
        elif person(company):
            vouched = company.lower() in known or company.lower() in {v.lower() for *_, v in domains if v} or stage == "domain_map" or (ats and company.lower() == display.lower())
            if not vouched and not re.search(rf"\bwith\s+{re.escape(company)}\s*$", whole, re.I):
                company = None
    if not company and kept and (not (len(kept.split()) == 2 and all(len(w) < 12 for w in kept.split())) or kept.lower() in known):
        company, stage, canonical = kept, "display_fallback", None
    company = normal(company) or None
    return (company, stage, canonical) if company else (None, None, None)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_query(spark):
    t = Tables(spark, FOLDER)
    domains = [(r.domain, r.kind, r.company) for r in t.mail_domains.orderBy("ord").collect()]
    names = [r.name for r in t.firm_names.orderBy("ord").collect()]
    aliases = [(r.alias, r.company) for r in t.firm_aliases.orderBy("ord").collect()]
    want = {m.id: brute(m, domains, names, aliases) for m in t.mails.collect()}
    rows = registry.queries()["e06_f18_f19_subject_cascade"](spark, FOLDER).collect()
    got = {r.id: (r.company, r.stage, r.canonical) for r in rows}
    wrong = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong
    stages = {s for _, s, _ in got.values() if s}
    assert stages >= {"ats_display_known", "ats_display_alias", "ats_prefix_alias", "sent_to_body", "confirmation_0", "confirmation_1", "confirmation_2", "confirmation_3", "confirmation_4", "agency_body", "domain_map", "known_in_subject", "display_organisation", "colon_prefix", "special_position", "subject_0", "subject_1", "subject_2"}
    refused = collections.Counter(x for r in rows for x in r.refused.split(",") if x)
    assert all(refused[x] for x in ("sent_to_body", "confirmation_0", "display_organisation", "display_fallback", "subject_2", "job_title", "person"))
    assert {x for *_, x in got.values()} >= {"alias", "known"}


def test_edges(spark):
    """Nulls, empty and long texts, no dictionary at all, a known person-like name, "with X" at the end."""
    mails = [(1, None, None, None), (2, "", "", ""), (3, "Interview with John Smith", "x@y.example", None), (4, "News from John Smith today", "x@y.example", "b"), (5, "x " * 20_000 + "from Quiet Garden K1", None, "y" * 50_000), (6, "Hello from Grace Hopper", "a@b.example", "")]
    df = spark.createDataFrame(mails, "id bigint, subject string, sender string, body string").withColumn("stage", F.lit("old"))
    domains = spark.createDataFrame([], "domain string, kind string, company string, ord int")
    aliases = spark.createDataFrame([], "alias string, company string, ord int")
    for known in ([], [("Grace Hopper", 1)]):
        names = spark.createDataFrame(known, "name string, ord int")
        got = {r.id: r.company for r in c.subject_company(df, domains, names, aliases).collect()}
        assert got[1] is None and got[2] is None and got[5] == "Quiet Garden K1"
        assert got[6] == ("Grace Hopper" if known else None)
        for i in (3, 4):
            assert got[i] == brute(dict(zip(("id", "subject", "sender", "body"), mails[i - 1], strict=True)), [], [k for k, _ in known], [])[0]
    assert c.subject_company(df.limit(0), domains, names, aliases).collect() == []


@pytest.mark.parametrize("whole_words", [True, False])
@pytest.mark.parametrize("longest", [True, False])
def test_held_names(spark, whole_words, longest):
    rng = random.Random(7)
    word = lambda: rng.choice(["ab", "Abc", "x.y", "été", "q", "C++", "no-one", "12"])
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)}) + ["", "!!", "ab\\Ec"]
    texts = [(k, rng.choice([" ", ", "]).join(word().upper() if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(900, None), (901, ""), (902, "(AB), q! ab\\Ec")]
    want = {}
    for k, t in texts:
        held = []
        for i, n in enumerate(names):
            hit = t and n.strip() and (re.search(rf"(?<!\w){re.escape(n)}(?!\w)", t, re.I) and re.search(r"\w", n) if whole_words else n.lower() in t.lower())
            if hit:
                held.append(((-len(n) if longest else 0), i, n))
        if held:
            want[k] = min(held)[2]
    dims = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, ord int").withColumn("value", F.upper("name"))
    got = held_names(spark.createDataFrame(texts, "k int, t string"), "k", "t", dims, whole_words, longest).collect()
    assert {r.k: r.name for r in got} == want and all(r.value == r.name.upper() for r in got)


def test_many_names(spark):
    """100,000 names: hashes are joined, no text is compared with more than the few names that share its words."""
    names = spark.range(100_000).select(F.concat(F.lit("Firm "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " Works").otherwise("")).alias("name"), F.col("id").alias("ord"))
    texts = spark.range(2_000).select(F.col("id").alias("k"), F.concat(F.lit("news of firm "), (F.col("id") * 41).cast("string"), F.lit(" works, and Firm "), (F.col("id") * 3).cast("string")).alias("t"))
    got = {r.k: r.name for r in held_names(texts, "k", "t", names).collect()}
    for k in range(2_000):
        a, b = 41 * k, 3 * k
        held = [f"Firm {a} Works" if a % 2 == 0 else f"Firm {a}"] + ([f"Firm {b}"] if b % 2 else [])
        held = [h for h in held if int(h.split()[1]) < 100_000]
        assert got.get(k) == (max(held, key=len) if held else None)
    assert "Cartesian" not in (plan := held_names(texts, "k", "t", names)._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_names_that_begin_alike(spark):
    """A text meets the names that it holds, not all those with the same first characters; mails that repeat are worked out once."""
    names = spark.createDataFrame([(f"Nationba Works K{i}", i) for i in range(500)], "name string, ord int")
    texts = spark.createDataFrame([(i, f"News from nationba works K{i}.") for i in range(100)], "id int, t_ string")
    (found,) = matching._parts(texts, "id", names)
    assert found.count() == sum(str(i).startswith(str(j)) for i in range(100) for j in range(500))
    domains = spark.createDataFrame([], "domain string, kind string, company string, ord int")
    mails = spark.createDataFrame([(i, f"Your application to Nationba Works K{i % 3}", "a@b.example", None) for i in range(30)], "id int, subject string, sender string, body string")
    out = c.subject_company(mails, domains, names, spark.createDataFrame([], "alias string, company string, ord int")).collect()
    assert sorted(r.id for r in out) == list(range(30)) and all(r.company.startswith("Nationba Works K") for r in out)

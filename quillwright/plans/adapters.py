"""Projections of the driver's tables to the engine's logical tables.

Each logical table is one SELECT that Spark and DuckDB both run; ``{name}`` stands for another table. ``Tables`` gives the
DataFrames of a folder, ``oracle`` puts the same SELECTs before a DuckDB query as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "messages": """
        SELECT event_id AS id, 'e' || CAST(event_id AS STRING) AS msg_id, user_id AS company_id,
            CASE event_id % 5 WHEN 0 THEN 'domain_mapping' WHEN 1 THEN 'subject_parse' WHEN 2 THEN 'ml_prediction' WHEN 3 THEN 'sender_name_match' END AS company_source,
            'User ' || CAST(user_id AS STRING) || ' <u' || CAST(user_id AS STRING) || '@d' || CAST(user_id % 20 AS STRING) || '.example.com>' AS sender,
            CASE WHEN event_id % 4 = 0 THEN 'Re: ' ELSE '' END || 'Application for Role ' || CAST(event_id % 7 AS STRING) || ' at Firm ' || CAST(user_id % 20 AS STRING) AS subject,
            'Dear user, ' || event_type || ' number ' || CAST(user_id % 10 AS STRING) AS body,
            CAST(ts AS TIMESTAMP) AS ts, 't' || CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) AS thread_id,
            CASE event_type WHEN 'signup' THEN 'job_application' WHEN 'purchase' THEN 'rejection' WHEN 'click' THEN 'interview_invite' WHEN 'view' THEN 'other'
                ELSE CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'noise' END END AS ml_label,
            CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, event_id % 3 = 0 AS reviewed,
            CASE WHEN event_id % 2 = 0 THEN 'rule' ELSE 'ml' END AS classification_source
        FROM {events}""",
    "companies": """
        SELECT c_custkey AS id, c_name AS name, 'd' || CAST(c_custkey % 20 AS STRING) || '.example.com' AS domain,
            CASE c_mktsegment WHEN 'MACHINERY' THEN 'headhunter' WHEN 'BUILDING' THEN 'application' WHEN 'AUTOMOBILE' THEN 'interview' WHEN 'FURNITURE' THEN 'rejected' END AS status,
            CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE lower(c_mktsegment) END AS focus_area,
            make_date(2023, 12, CAST(1 + c_custkey % 28 AS INT)) AS first_contact, make_date(2024, 1, CAST(1 + c_custkey % 28 AS INT)) AS last_contact,
            CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE make_date(2024, 1, CAST(1 + c_custkey % 30 AS INT)) END AS last_job_search_date, c_nationkey AS nation
        FROM {customer}""",
    "threads": """
        SELECT 'o' || CAST(o.o_orderkey AS STRING) AS thread_id, o.o_custkey AS company_id, CAST(o.o_orderdate AS DATE) AS sent_date,
            CASE o.o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'P' THEN 'ghosted' ELSE 'application' END AS status,
            l.rejection_date, l.interview_date, l.prescreen_date, o.o_orderpriority AS job_title, 'J' || CAST(o.o_orderkey % 50 AS STRING) AS job_id,
            CASE o.o_orderstatus WHEN 'F' THEN 'rejection' WHEN 'P' THEN 'noise' ELSE 'job_application' END AS ml_label,
            o.o_orderkey % 11 = 0 AS interview_completed, o.o_orderkey % 5 = 0 AS reviewed
        FROM {orders} o LEFT JOIN (
            SELECT l_orderkey, CAST(max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS DATE) AS rejection_date,
                CAST(min(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS DATE) AS interview_date,
                CAST(min(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS DATE) AS prescreen_date
            FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    # the same threads, most of them without a rejection
    "open_threads": """
        SELECT thread_id, company_id, sent_date, status, CASE WHEN company_id % 4 = 0 THEN rejection_date END AS rejection_date, interview_date, prescreen_date, ml_label FROM {threads}""",
    # the same messages in the time of the orders; some companies are never rejected, and some have noise alone
    "history": """
        SELECT id, company_id, CAST(ts AS DATE) - CAST(8190 + company_id % 200 AS INT) AS day,
            CASE WHEN company_id % 5 = 0 THEN CASE WHEN ml_label IS NULL THEN 'other' ELSE 'noise' END WHEN company_id % 3 = 0 AND ml_label = 'rejection' THEN 'other' ELSE ml_label END AS ml_label
        FROM {messages}""",
    # messages of every kind that the resolution cascade tells apart: ``tier`` is the kind
    "letters": """
        SELECT id, ml_label, id % 16 AS tier,
            CASE id % 16 WHEN 0 THEN 'Me <Me@home.example>' WHEN 1 THEN 'A <a@d3.example.com>' WHEN 2 THEN 'B <b@mail.d2.example.com>' WHEN 3 THEN 'Jobs <no@usastaffing.gov>' WHEN 4 THEN 'Board <apply@indeed.com>'
                WHEN 9 THEN 'FIRM FOUR Careers <c@unknown.example>' ELSE 'X <x@unknown.example>' END AS sender,
            CASE WHEN id % 16 = 0 THEN 'Ann <ann@hr.d1.example.com>' ELSE 'Me <me@home.example>' END AS recipient,
            CASE id % 16 WHEN 4 THEN 'Indeed Application: Role' WHEN 5 THEN 'Application for Role 3 at Green Hill' WHEN 6 THEN 'Your application to Senior Engineer' WHEN 13 THEN 'Application for Role 4 at Firm II' WHEN 14 THEN 'Application for Role 4 at FIRM ONE' ELSE 'Hello' END AS subject,
            CASE id % 16 WHEN 3 THEN '<html><style>@ at the Park</style><p>A post at the Bureau of Maps, in the Department of Roads</p></html>' WHEN 4 THEN 'The following items were sent to Blue River and more' WHEN 6 THEN 'red lake wrote to you'
                WHEN 7 THEN 'the position @ bluestone.' WHEN 8 THEN 'Thanks for applying to Quiet Garden' ELSE 'nothing here' END AS body,
            CASE id % 16 WHEN 10 THEN 'Stone Works Group' WHEN 11 THEN 'John Smith' END AS organization,
            CASE id % 16 WHEN 6 THEN 'Red Lake' WHEN 7 THEN 'Absent Name' WHEN 8 THEN 'noise' END AS predicted
        FROM {messages}""",
    # dimensions: (domain, kind, company, ord); first in order wins
    "domains": """
        SELECT * FROM (VALUES ('d3.example.com', 'headhunter', CAST(NULL AS STRING), 1), ('d7.example.com', 'headhunter', NULL, 2), ('example.net', 'ats', NULL, 3), ('example.org', 'job_board', NULL, 4),
            ('d1.example.com', 'company', 'Firm One', 5), ('d2.example.com', 'company', 'Firm Two', 6), ('d4.example.com', 'company', 'Firm Four', 7), ('d5.example.com', 'company', 'Firm Five', 8),
            ('d6.example.com', 'company', 'Firm Six', 9), ('example.com', 'company', 'Example Group', 10), ('d8.example.com', 'personal', NULL, 11), ('d9.example.com', 'job_board', NULL, 12)) AS v(domain, kind, company, ord)""",
    "aliases": """
        SELECT * FROM (VALUES ('Firm 1', 'Firm One', 1), ('Firm 2', 'Firm Two', 2), ('Firm II', 'Firm Two', 3), ('Firm 4', 'Firm Four', 4), ('Firm 5', 'Firm Five', 5), ('Fünf', 'Firm Five', 6)) AS v(alias, company, ord)""",
    # dictionaries as long as the tables: domains and nicknames of firms
    "firm_domains": "SELECT 'd' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN '.example.com' ELSE '.co.example' END AS domain, 'Firm ' || CAST(c_custkey % 50 AS STRING) AS company, c_custkey AS ord FROM {customer}",
    "nicknames": "SELECT 'Nick ' || CAST(s_suppkey AS STRING) AS alias, 'Firm ' || CAST(s_suppkey % 50 AS STRING) AS company, s_suppkey AS ord FROM {supplier}",
    "truth": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' ELSE 'low' END AS label FROM {labels}",
}
SQL["hh_companies"] = """
        SELECT DISTINCT c.id FROM {companies} c LEFT JOIN (SELECT DISTINCT company_id FROM {messages} WHERE ml_label = 'head_hunter' OR sender LIKE '%@d3.example.com%' OR sender LIKE '%@d7.example.com%') m
        ON m.company_id = c.id WHERE c.status = 'headhunter' OR m.company_id IS NOT NULL"""
# firms with names of several looks, some like a person's; mails about them, a kind for each stage and guard of the subject cascade (Spark's SQL only)
SQL["firms"] = """
        SELECT c_custkey AS id, initcap(lower(translate(n_name, '0123456789_', 'abcdefghij'))) || ' ' || CASE c_custkey % 6 WHEN 0 THEN 'Works' WHEN 1 THEN 'Systems' WHEN 2 THEN 'Foods' WHEN 3 THEN 'Labs' WHEN 4 THEN 'Trade-House' ELSE 'Oil & Gas' END
            || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' K' || CAST(c_custkey AS STRING) END AS name
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""
SQL["firm_names"] = "SELECT name, min(id) AS ord FROM {firms} WHERE id % 3 = 1 GROUP BY name"
SQL["firm_aliases"] = "SELECT 'nick' || CAST(id AS STRING) AS alias, name AS company, id AS ord FROM {firms} WHERE id % 5 = 0"
SQL["mail_domains"] = """
        SELECT 'd' || CAST(id AS STRING) || '.firms.example' AS domain, 'company' AS kind, name AS company, 100 + id AS ord FROM {firms} WHERE id % 2 = 0
        UNION ALL SELECT * FROM VALUES ('example.net', 'ats', NULL, 1), ('talent.example', 'ats', NULL, 2), ('example.org', 'job_board', NULL, 3), ('d3.example.com', 'headhunter', NULL, 4)"""
_SUBJECTS = ["{f} application received", "Your application to {f}", "News from {f}", "The position @ {f}", "{f} Interview", "Role 3 - {f} - Boston", "Status - {f}", "Your interest in {f}", "An update on your {f} application", "thank you for your application with {f}", "thank you for applying to {f}", "applying to {f}", "Hello @ {f}", "Re: RE: applying for Field Lead position @ {f}"]
_KINDS = [  # (sender, subject, body); {f} is the firm's name, {i} its id
    ("{f} <no-reply@example.net>", "Welcome", "Hello"),
    ("Ann Lee @ {f} <no-reply@mail.example.net>", "Welcome", "Hello"),
    ("nick{i} <no-reply@talent.example>", "Welcome", "Hello"),
    ("X1 <nick{i}+auto@mail.talent.example>", "Welcome", "Hello"),
    ("X1 <apply@example.org>", "Indeed Application: Role", "<html><style>p</style><p>The following items were sent to {f}. Good luck</p></html>"),
    ("X1 <apply@example.org>", "An application", "<strong> <a href=1>{f}</a></strong> answers about your application"),
    ("X1 <apply@example.org>", "An application", "It was sent to AB.\nBye"),
    ("X1 <a@b.example>", "Your application", "Thank you for the position here at {f}. Bye"),
    ("X1 <a@b.example>", "We applied it", "A position with {f}\nBye"),
    ("X1 <a@b.example>", "Your application", "Your application for our Field Lead 3 at {f}.\nBye"),
    ("X1 <a@b.example>", "Applying", "Thank you for considering us at {f} as you go on"),
    ("X1 <a@b.example>", "Applying", "Thank you for considering {f} as a potential employer"),
    ("X1 <a@b.example>", "Your application", "The position at Senior Engineer. Thank you"),
    ("X1 <x@intelligencecareers.gov>", "Your application", "Your application to the {f} (AB) is here"),
    ("X1 <x@hr.d{i}.firms.example>", "Hello", "Hello"),
    ("X1 <a@b.example>", "We at {f} thank you", "Hello"),
    ("{f} Recruiting Team <a@b.example>", "Your application", "Hello"),
    ("Bo Li @ Zeta Technologies <a@b.example>", "Your application", "Hello"),
    ("Mary Jones Careers <a@b.example>", "Your application", "Hello"),
    ("X1 <a@b.example>", "{f}: hello", "Hello"),
    ("X1 <a@b.example>", "Interview with John Smith", "Hello"),
    ("X1 <a@b.example>", "News from John Smith", "Hello"),
    ("X1 <a@b.example>", "Mary Jones: a note", "Hello"),
    ("X1 <a@b.example>", "Your application for Senior Engineer Two", "Hello"),
    ("X1 <a@b.example>", "the Field post at {f}", "Hello"),
    ("X1 <a@b.example>", "Greetings nick{i}, application to Somebody Else Works", "Hello"),
    ("Me <Me@home.example>", "Hello", "Hello"),
    ("A <a@d3.example.com>", "Hello", "Hello"),
    ("John Smith <j@example.net>", "Hello from John Smith", "Hello"),
    ("relay <x@relay.example>", "Invitation", "{calendar} join the meeting"),
    *(("X1 <a@b.example>", x, "Hello") for x in _SUBJECTS),
]


def _filled(text: str) -> str:
    calendar = "base64(CAST('BEGIN:VCALENDAR x ORGANIZER;CN=Somebody Here:mailto:boss@d' || CAST(f.id AS STRING) || '.firms.example END:VCALENDAR' AS BINARY))"
    parts = re.split(r"({f}|{i}|{calendar})", text)
    return " || ".join({"{f}": "f.name", "{i}": "CAST(f.id AS STRING)", "{calendar}": calendar}.get(p) or "'" + p.replace("\n", "\\n") + "'" for p in parts if p)


SQL["mails"] = f"""
        SELECT m.id, m.ml_label, CASE m.id % {len(_KINDS)} {" ".join(f"WHEN {k} THEN {_filled(x[0])}" for k, x in enumerate(_KINDS))} END AS sender, 'Ann <ann@hr.d' || CAST(f.id AS STRING) || '.firms.example>' AS recipient,
            CASE m.id % {len(_KINDS)} {" ".join(f"WHEN {k} THEN {_filled(x[1])}" for k, x in enumerate(_KINDS))} END AS subject, CASE m.id % {len(_KINDS)} {" ".join(f"WHEN {k} THEN {_filled(x[2])}" for k, x in enumerate(_KINDS))} END AS body,
            CASE WHEN m.id % 3 = 0 THEN f.name || ' Holding' END AS organization, CAST(NULL AS STRING) AS predicted
        FROM {{messages}} m JOIN {{firms}} f ON f.id = 1 + (m.id * 7 + m.id % 31) % 149"""
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """The logical and the driver's tables of one folder, as DataFrames; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._built = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in SQL:
                used = {n: getattr(self, n) for n in re.findall(r"{(\w+)}", SQL[name])}
                self._built[name] = self.spark.sql(SQL[name], **used)
            else:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the logical tables that it names as common table expressions."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"(?<![\w.']){name}(?![\w(])", text) and name not in ordered:
                need(SQL[name].replace("{", "").replace("}", ""))
                ordered.append(name)

    need(sql)
    tables = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', SQL[n])})" for n in dict.fromkeys(ordered)]
    if not tables:
        return sql
    body, word = sql.strip(), "WITH"
    if body.upper().startswith("WITH RECURSIVE "):
        body, word = "WITH " + body[15:], "WITH RECURSIVE"
    return f"{word} {', '.join(tables)}" + (f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}")

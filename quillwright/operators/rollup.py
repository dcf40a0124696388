"""State roll-up: message -> thread -> company."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sem import AS_OF, AS_OF_ORDERS, elapsed_days, is_not
from ..registry import query

MILESTONES = {"rejection": ("rejection", "rejected", "cancelled"), "interview": ("interview_invite", "interview"), "prescreen": ("prescreen",), "offer": ("offer",)}


def days_until_ghosted(argument: int | None = None, setting: int | None = None, variable: str = "GHOSTED_DAYS_THRESHOLD", default: int = 30) -> int:
    """argument, then setting, then environment, then the default; at least 1, at most 3650."""
    env = os.environ.get(variable, "")
    value = argument if argument is not None else setting if setting is not None else int(env) if env.strip().isdigit() else default
    return max(1, min(3650, value))


def thread_state(messages: DataFrame, interview_confidence: float = 0.7) -> DataFrame:
    """One row a thread: milestone dates by label, latest label; one aggregate with map-side combine."""
    day, label = F.to_date("ts"), F.col("ml_label")
    sure = F.coalesce(F.col("confidence") >= interview_confidence, F.lit(False))
    return messages.groupBy("thread_id").agg(
        F.min_by("company_id", F.struct("ts", "id")).alias("company_id"),
        F.min(day).alias("sent_date"),
        F.max(F.when(label.isin(*MILESTONES["rejection"]), day)).alias("rejection_date"),
        F.min(F.when(label.isin(*MILESTONES["interview"]) & sure, day)).alias("interview_date"),
        F.min(F.when(label.isin(*MILESTONES["prescreen"]), day)).alias("prescreen_date"),
        F.max_by(label, F.when(label.isNotNull(), F.struct("ts", "id"))).alias("ml_label"),
        F.count("*").alias("messages"),
    )


_STATE = "SELECT thread_id, min_by(company_id, (ts, id)) AS company_id, min(CAST(ts AS DATE)) AS sent_date, max(CASE WHEN ml_label IN ('rejection', 'rejected', 'cancelled') THEN CAST(ts AS DATE) END) AS rejection_date, min(CASE WHEN ml_label IN ('interview_invite', 'interview') AND confidence >= 0.7 THEN CAST(ts AS DATE) END) AS interview_date, min(CASE WHEN ml_label = 'prescreen' THEN CAST(ts AS DATE) END) AS prescreen_date, max_by(ml_label, (ts, id)) FILTER (ml_label IS NOT NULL) AS ml_label, count(*) AS messages FROM messages GROUP BY 1"


@query("r02_r03_thread_state", _STATE)
def _(t):
    return thread_state(t.messages)


EMPTY_STATE = {"ml_label": None, "ml_confidence": None, "prescreen_date": None, "interview_date": None}
_PAIRS = {"prescreen": ("prescreen_date", "interview_invite", "interview_date"), "interview_invite": ("interview_date", "prescreen", "prescreen_date")}


def propagate(state: dict, label: str | None, confidence: float | None, day) -> dict:  # noqa: ANN001  a date
    """R01, one message on its own thread's row: a changed label sets its milestone's date if that is empty, and then clears the other
    milestone's date if the label before had set it on the same day; the last confidence stays."""
    new = dict(state)
    if label is not None and label != state["ml_label"]:
        new["ml_label"] = label
        own, other, date = _PAIRS.get(label, (None, None, None))
        if own and state[own] is None:
            new[own] = day
            if state["ml_label"] == other and state[date] == day:
                new[date] = None
    if confidence is not None:
        new["ml_confidence"] = confidence
    return new


PROPAGATED = ("job_application", "interview_invite", "prescreen")
_STATE_TYPE = "struct<label:string,confidence:double,prescreen:date,interview:date>"


def propagation_events(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """What each message does: (target, kind, ts, id, label, confidence, day, company_id, created).

    ``messages``: id, thread_id, company_id, ts, ml_label, confidence; ``threads``: thread_id, company_id, sent_date. A message updates its own
    thread's row. Where there is none, an application creates it; a prescreen or interview joins the company's earliest row (then), or
    creates one where the company has none. So a thread's row begins with its first application, or with the first of the three labels of
    a company without a row. A message with neither, or without a company, does nothing.
    """
    order = F.struct("ts", "id")
    m = messages.filter("thread_id IS NOT NULL").select("thread_id", "company_id", "ts", "id", F.col("ml_label").alias("label"), "confidence", F.to_date("ts").alias("day"))
    own = threads.select("thread_id").distinct()
    update = m.join(own, "thread_id", "left_semi").withColumn("kind", F.lit("update")).withColumn("target", F.col("thread_id"))
    loose = m.join(own, "thread_id", "left_anti")
    asks = loose.filter(F.col("label").isin(*PROPAGATED) & F.col("company_id").isNotNull())
    earliest = threads.filter("company_id IS NOT NULL").groupBy("company_id").agg(F.min(F.struct("sent_date", "thread_id")).alias("old"))
    applied = asks.filter("label = 'job_application'").groupBy("thread_id").agg(F.min(order).alias("began"))
    first = asks.join(earliest, "company_id", "left_anti").groupBy("company_id").agg(F.min_by("thread_id", order).alias("thread_id"), F.min(order).alias("began"))
    began = applied.unionByName(first.select("thread_id", "began")).groupBy("thread_id").agg(F.min("began").alias("began"))
    made = loose.join(began, "thread_id")
    mine = made.filter(order >= F.col("began")).withColumn("kind", F.when(order == F.col("began"), "create").otherwise("update")).withColumn("target", F.col("thread_id"))
    created = mine.filter("kind = 'create'").groupBy("company_id").agg(F.min(F.struct("ts", "id", "day", "thread_id")).alias("new"))
    early = asks.filter("label <> 'job_application'").join(began, "thread_id", "left").filter(F.col("began").isNull() | (order < F.col("began")))
    early = early.join(earliest, "company_id", "left").join(created, "company_id", "left")
    new = F.when(F.struct(F.col("new.ts"), F.col("new.id")) < order, F.struct(F.col("new.day").alias("sent_date"), F.col("new.thread_id").alias("thread_id")))
    target = F.when(F.col("old").isNull() | (new["sent_date"] < F.col("old.sent_date")), new).otherwise(F.col("old"))
    join = early.withColumn("target", F.coalesce(target, F.col("old"))["thread_id"]).filter("target IS NOT NULL").withColumn("kind", F.lit("join"))
    names = ["target", "kind", "ts", "id", "label", "confidence", "day", "company_id"]
    return update.select(*names).unionByName(mine.select(*names)).unionByName(join.select(*names))


def propagate_labels(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """The state of each thread's row that a message touches: an ordered fold of its messages (a thread is a conversation), JVM-side.

    A changed label sets its milestone's date if that is empty, and clears the other milestone's date if the label before had set it on the
    same day; the last confidence stays; a message that only joins sets an empty date. ``threads`` also has ml_label, prescreen_date, interview_date.
    """
    events = propagation_events(messages, threads)
    event = F.struct("ts", "id", "kind", "label", "confidence", "day")
    by = events.groupBy(F.col("target").alias("thread_id")).agg(F.array_sort(F.collect_list(event)).alias("e"), F.max_by("company_id", F.when(F.col("kind") == "create", 1)).alias("c"))
    start = threads.select("thread_id", F.col("company_id").alias("t_company"), F.struct(F.col("ml_label").alias("label"), F.lit(None).cast("double").alias("confidence"), F.col("prescreen_date").alias("prescreen"), F.col("interview_date").alias("interview")).alias("s"))

    def step(s: Column, x: Column) -> Column:
        joins = x["kind"] == "join"
        change = ~joins & x["label"].isNotNull() & ~x["label"].eqNullSafe(s["label"])

        def date(label: str, own: str, other_label: str, other: str) -> Column:
            sets = (x["label"] == label) & s[own].isNull() & (joins | change)
            clears = change & (x["label"] == other_label) & s[other].isNull() & (s["label"] == label) & (s[own] == x["day"])  # as in ``propagate``
            return F.when(sets, x["day"]).when(~F.coalesce(clears, F.lit(False)), s[own]).alias(own)

        label = F.when(change, x["label"]).otherwise(s["label"])
        return F.struct(label.alias("label"), F.when(joins, s["confidence"]).otherwise(F.coalesce(x["confidence"], s["confidence"])).alias("confidence"), date("prescreen", "prescreen", "interview_invite", "interview"), date("interview_invite", "interview", "prescreen", "prescreen"))

    empty = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("date").alias("prescreen"), F.lit(None).cast("date").alias("interview"))
    state = F.aggregate("e", F.coalesce("s", empty).cast(_STATE_TYPE), lambda s, x: step(s, x).cast(_STATE_TYPE))
    out = by.join(start, "thread_id", "left").withColumn("x", state)
    return out.select("thread_id", F.coalesce("t_company", "c").alias("company_id"), F.col("s").isNull().alias("created"), F.col("x.label").alias("ml_label"), F.col("x.confidence").alias("ml_confidence"), F.col("x.prescreen").alias("prescreen_date"), F.col("x.interview").alias("interview_date"))


_R01 = """WITH b AS (SELECT m.*, CAST(m.ts AS DATE) AS day FROM messages m WHERE thread_id NOT IN (SELECT thread_id FROM threads)), q AS (SELECT * FROM b WHERE ml_label IN ('job_application', 'interview_invite', 'prescreen') AND company_id IS NOT NULL),
old AS (SELECT company_id, min_by(thread_id, (sent_date, thread_id)) AS thread_id, min(sent_date) AS sent_date FROM threads GROUP BY 1),
began AS (SELECT thread_id, min((ts, id)) AS k FROM (SELECT thread_id, ts, id FROM q WHERE ml_label = 'job_application' UNION ALL SELECT thread_id, ts, id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts, id) AS rn FROM q WHERE company_id NOT IN (SELECT company_id FROM old)) WHERE rn = 1) GROUP BY 1),
made AS (SELECT b.*, (b.ts, b.id) = k AS first FROM b JOIN began USING (thread_id) WHERE (b.ts, b.id) >= k),
new AS (SELECT company_id, min((ts, id)) AS k, min_by(thread_id, (ts, id)) AS thread_id, min(day) AS sent_date FROM made WHERE first GROUP BY 1),
joined AS (SELECT q.ts, q.id, q.ml_label, q.day, CASE WHEN new.k < (q.ts, q.id) AND (old.thread_id IS NULL OR new.sent_date < old.sent_date) THEN new.thread_id ELSE old.thread_id END AS target FROM q LEFT JOIN began USING (thread_id) LEFT JOIN old USING (company_id) LEFT JOIN new USING (company_id) WHERE q.ml_label <> 'job_application' AND (began.k IS NULL OR (q.ts, q.id) < began.k)),
e AS (SELECT thread_id, company_id, ts, id, ml_label, confidence, day, true AS own FROM made UNION ALL SELECT target, NULL, ts, id, ml_label, NULL, day, false FROM joined WHERE target IS NOT NULL)
SELECT e.thread_id, coalesce(any_value(t.company_id), any_value(e.company_id)) AS company_id, any_value(t.thread_id) IS NULL AS created, coalesce(max_by(e.ml_label, (e.ts, e.id)) FILTER (own AND e.ml_label IS NOT NULL), any_value(t.ml_label)) AS ml_label, max_by(e.confidence, (e.ts, e.id)) FILTER (own AND e.confidence IS NOT NULL) AS ml_confidence, any_value(t.prescreen_date) AS prescreen_date, coalesce(any_value(t.interview_date), min(e.day) FILTER (e.ml_label = 'interview_invite')) AS interview_date FROM e LEFT JOIN threads t ON t.thread_id = e.thread_id GROUP BY 1"""


@query("r01_label_propagation", _R01)
def _(t):
    return propagate_labels(t.messages, t.threads)


@query("r04_r23_consistency_repair", "WITH s AS (SELECT company_id, max(CAST(ts AS DATE)) AS seen FROM messages WHERE ml_label = 'rejection' GROUP BY 1) SELECT t.thread_id, s.seen AS rejection_date FROM threads t JOIN s USING (company_id) WHERE t.rejection_date IS DISTINCT FROM s.seen AND t.status = 'rejected'")
def _(t):
    s = t.messages.filter("ml_label = 'rejection'").groupBy("company_id").agg(F.max(F.to_date("ts")).alias("seen"))
    wrong = ~F.col("rejection_date").eqNullSafe(F.col("seen"))
    return t.threads.filter("status = 'rejected'").join(s, "company_id").filter(wrong).select("thread_id", F.col("seen").alias("rejection_date"))


def ghosted(threads: DataFrame, messages: DataFrame, companies: DataFrame, rejecting: DataFrame, as_of: str, days: int) -> DataFrame:
    """Threads to be marked: old, of no ``rejecting`` company, of a quiet company, neither head-hunter nor noise. ``messages``: company_id, day."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    still_open = F.col("rejection_date").isNull() & is_not("ml_label", "noise") & is_not("status", "ghosted", "rejected")
    old = threads.filter(still_open & (F.col("sent_date") <= cutoff) & (F.col("interview_date").isNull() | (F.col("interview_date") <= cutoff)))
    heads = companies.filter("status = 'headhunter'").select(F.col("id").alias("company_id"))
    last = messages.groupBy("company_id").agg(F.max("day").alias("last_message"))
    kept = old.join(rejecting.select("company_id"), "company_id", "left_anti").join(heads, "company_id", "left_anti").join(last, "company_id", "left")
    quiet = F.coalesce("last_message", F.greatest("sent_date", "interview_date", "prescreen_date")) <= cutoff
    return kept.filter(quiet).select("thread_id", F.lit("ghosted").alias("status"))


def rejecting_companies(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Companies with a rejection on a thread or in a message."""
    return threads.filter("rejection_date IS NOT NULL").select("company_id").union(messages.filter("ml_label = 'rejection'").select("company_id"))


@query("r05_t05_ghosting", f"WITH r AS (SELECT company_id FROM open_threads WHERE rejection_date IS NOT NULL UNION SELECT company_id FROM history WHERE ml_label = 'rejection'), l AS (SELECT company_id, max(day) AS d FROM history GROUP BY 1) SELECT t.thread_id, 'ghosted' AS status FROM open_threads t LEFT JOIN l USING (company_id) WHERE t.rejection_date IS NULL AND t.ml_label IS DISTINCT FROM 'noise' AND t.status NOT IN ('ghosted', 'rejected') AND t.sent_date <= DATE '{AS_OF_ORDERS}' - 30 AND (t.interview_date IS NULL OR t.interview_date <= DATE '{AS_OF_ORDERS}' - 30) AND t.company_id NOT IN (SELECT company_id FROM r) AND t.company_id NOT IN (SELECT id FROM companies WHERE status = 'headhunter') AND coalesce(l.d, greatest(t.sent_date, t.interview_date, t.prescreen_date)) <= DATE '{AS_OF_ORDERS}' - 30")
def _(t):
    return ghosted(t.open_threads, t.history, t.companies, rejecting_companies(t.open_threads, t.history), AS_OF_ORDERS, 30)


def company_status(label: Column, age: Column, days: int) -> Column:
    """Status from the latest labelled message and its age in whole days."""
    return F.when(label.isin("rejection", "rejected"), "rejected").when(label == "head_hunter", "headhunter").when(label == "offer", "offer").when(age >= days, "ghosted").when(label == "interview_invite", "interview").when(label == "job_application", "application").otherwise("follow-up")


@query("r06_company_status", f"WITH l AS (SELECT company_id, max_by(ml_label, (ts, id)) AS label, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 86400) AS BIGINT) AS age FROM messages WHERE ml_label IS DISTINCT FROM 'noise' AND ml_label IS NOT NULL GROUP BY 1) SELECT company_id, CASE WHEN label IN ('rejection', 'rejected') THEN 'rejected' WHEN label = 'head_hunter' THEN 'headhunter' WHEN label = 'offer' THEN 'offer' WHEN age >= 2 THEN 'ghosted' WHEN label = 'interview_invite' THEN 'interview' WHEN label = 'job_application' THEN 'application' ELSE 'follow-up' END AS status FROM l")
def _(t):
    last = t.messages.filter("ml_label IS NOT NULL AND ml_label <> 'noise'").groupBy("company_id").agg(F.max_by("ml_label", F.struct("ts", "id")).alias("label"), F.max("ts").alias("ts"))
    return last.select("company_id", company_status(F.col("label"), elapsed_days("ts", F.lit(AS_OF).cast("timestamp")), 2).alias("status"))


@query("r07_label_sync", "SELECT thread_id FROM threads t WHERE ml_label <> 'job_application' AND EXISTS (SELECT 1 FROM messages m WHERE m.company_id = t.company_id AND m.ml_label = 'job_application')")
def _(t):
    apps = t.messages.filter("ml_label = 'job_application'").select("company_id")
    return t.threads.filter("ml_label <> 'job_application'").join(apps, "company_id", "left_semi").select("thread_id")


@query("r08_backfill_threads", "SELECT thread_id, min_by(company_id, (ts, id)) AS company_id, min(CAST(ts AS DATE)) AS sent_date, 'application' AS status FROM messages WHERE ml_label = 'job_application' AND company_id NOT IN (SELECT company_id FROM threads WHERE status = 'ghosted') GROUP BY 1")
def _(t):
    gone = t.threads.filter("status = 'ghosted'").select("company_id")
    apps = t.messages.filter("ml_label = 'job_application'").join(gone, "company_id", "left_anti")
    return apps.groupBy("thread_id").agg(F.min_by("company_id", F.struct("ts", "id")).alias("company_id"), F.min(F.to_date("ts")).alias("sent_date"), F.lit("application").alias("status"))


@query("r09_local_date_repair", "WITH f AS (SELECT thread_id, min(ts) AS ts FROM messages GROUP BY 1) SELECT thread_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS sent_date FROM f WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) <> CAST(ts AS DATE)")
def _(t):
    from ..functions.sem import local_date

    first = t.messages.groupBy("thread_id").agg(F.min("ts").alias("ts"))
    return first.filter(local_date("ts") != F.to_date("ts")).select("thread_id", local_date("ts").alias("sent_date"))


@query("r10_missing_milestones", "SELECT DISTINCT t.thread_id FROM threads t JOIN messages m USING (company_id) WHERE m.ml_label = 'interview_invite' AND NOT starts_with(m.subject, 'Re: ') AND t.interview_date IS NULL")
def _(t):
    told = t.messages.filter((F.col("ml_label") == "interview_invite") & ~F.col("subject").startswith("Re: ")).select("company_id")
    return t.threads.filter("interview_date IS NULL").join(told, "company_id", "left_semi").select("thread_id")

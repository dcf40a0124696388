"""Training and prediction (C07, C13-C15) on pyspark.ml, and the sources' and decoders' queries on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import posting
from ..functions import html, mail
from ..plans.lineage import written
from ..registry import query
from ..sources.readers import PastedSpec, assign_threads, decoding_summary, page_texts


def prepared(rows: DataFrame, label: str = "ml_label", rare: int = 10, least: int = 2) -> DataFrame:
    """Labels of fewer than ``rare`` rows become other; classes of fewer than ``least`` go; balanced weights."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    merged = rows.join(F.broadcast(sizes), label).withColumn(label, F.when(F.col("__n") < rare, "other").otherwise(F.col(label))).drop("__n")
    again = merged.groupBy(label).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    total, classes = again.agg(F.sum("__n"), F.count("*")).first()
    if not classes:
        return merged.withColumn("weight", F.lit(1.0)).limit(0)
    return merged.join(F.broadcast(again), label).withColumn("weight", F.lit(total / classes) / F.col("__n")).drop("__n")


def pipeline(subject_terms: int = 10_000, body_terms: int = 40_000, min_df: float = 2, max_df: float = 0.9, label: str = "ml_label") -> Pipeline:
    """TF-IDF of words and pairs of words of subject and body, normalised; ``y`` is the label's index."""
    stages = []
    for part, size in (("subject", subject_terms), ("body", body_terms)):
        stages += [
            RegexTokenizer(inputCol=part, outputCol=f"{part}_w", pattern=r"\W+", minTokenLength=2),
            NGram(n=2, inputCol=f"{part}_w", outputCol=f"{part}_p"),
            SQLTransformer(statement=f"SELECT *, concat({part}_w, {part}_p) AS {part}_t FROM __THIS__"),
            CountVectorizer(inputCol=f"{part}_t", outputCol=f"{part}_c", vocabSize=size, minDF=min_df, maxDF=max_df),
            IDF(inputCol=f"{part}_c", outputCol=f"{part}_i"),
            Normalizer(inputCol=f"{part}_i", outputCol=f"{part}_v"),
        ]
    stages += [VectorAssembler(inputCols=["subject_v", "body_v"], outputCol="features"), StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc")]
    return Pipeline(stages=stages)


def split(rows: DataFrame, label: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Stratified: of each label the ``share`` of rows with the least seeded hashes of the key, the same on every run."""
    h = F.xxhash64(F.lit(seed), "id")
    marks = rows.groupBy(F.col(label).alias("__l")).agg(F.percentile_approx(h, F.lit(share), F.lit(100_000)).alias("__t"))  # a row for each label
    marked = rows.join(marks, F.col(label).eqNullSafe(F.col("__l")))
    return tuple(marked.filter(c).select(*rows.columns) for c in (h > F.col("__t"), h <= F.col("__t")))


FOLDS, STRENGTH = 3, 0.5


class Calibrated:
    """Features, and for each fold a regression on the other folds with isotonic calibrators, one against the rest, on the fold."""

    def __init__(self, features: PipelineModel, folds: list[tuple[LogisticRegressionModel, list[IsotonicRegressionModel]]]) -> None:
        self.features, self.folds, self.labels = features, folds, features.stages[-1].labels

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p``: calibrated probabilities, normalised in each fold, the folds' mean; even where a fold gives zeros alone."""
        out, k = self.features.transform(rows), len(self.labels)
        parts = []
        for f, (base, curves) in enumerate(self.folds):
            out = base.setProbabilityCol(f"__p{f}").setRawPredictionCol(f"__r{f}").setPredictionCol(f"__y{f}").transform(out)
            for j, curve in enumerate(curves):
                out = out.withColumn(f"__x{f}_{j}", F.coalesce(F.get(vector_to_array(f"__p{f}"), F.lit(j)), F.lit(0.0)))
                out = curve.setFeaturesCol(f"__x{f}_{j}").setPredictionCol(f"__c{f}_{j}").transform(out)
            each = [F.col(f"__c{f}_{j}") for j in range(k)]
            total = reduce(lambda a, b: a + b, each)
            parts.append([F.when(total > 0, c / total).otherwise(1.0 / k) for c in each])
        mean = [reduce(lambda a, b: a + b, column) / len(parts) for column in zip(*parts, strict=True)]
        return out.select(*rows.columns, F.array(*mean).alias("p"))


def train(rows: DataFrame, label: str = "ml_label") -> Calibrated:
    """C13 on ``rows`` (id, subject, body, label)."""
    given = prepared(rows, label)
    features = pipeline(label=label).fit(given)
    known = written(features.transform(given).select("id", "features", "y", "weight"), "training")
    fold, k = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(FOLDS)), len(features.stages[-1].labels)
    folds = []
    for f in range(FOLDS):
        others = known.filter(fold != f)
        base = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1 / (STRENGTH * max(1, others.count())), maxIter=30).fit(others)
        held = written(base.transform(known.filter(fold == f)).select(vector_to_array("probability").alias("p"), "y"), "calibration")
        curve = lambda j: held.select(F.coalesce(F.get("p", F.lit(j)), F.lit(0.0)).alias("x"), (F.col("y") == j).cast("double").alias("t"))  # noqa: B023, E731
        folds.append((base, [IsotonicRegression(featuresCol="x", labelCol="t").fit(curve(j)) for j in range(k)]))
    return Calibrated(features, folds)


def predict(model: Calibrated, rows: DataFrame, rule: Column, threshold: float = 0.6) -> DataFrame:
    """A rule's hit at 0.95, otherwise the best class by calibrated probability; ``ignore`` is set below the threshold or for noise."""
    out = model.probabilities(rows).withColumn("__p", F.array_max("p"))
    best = F.get(F.array(*(F.lit(x) for x in model.labels)), F.array_position("p", F.col("__p")).cast("int") - 1)
    return out.select(*rows.columns, F.coalesce(rule, best).alias("label"), F.when(rule.isNotNull(), 0.95).otherwise(F.col("__p")).alias("score")).withColumn("ignore", (F.col("label") == "noise") | (F.col("score") < threshold))


def telling_terms(model: Calibrated, part: str = "subject") -> list[str]:
    """Vocabulary terms of three letters or more without digits."""
    return [w for w in model.features.stages[{"subject": 3, "body": 9}[part]].vocabulary if len(w) >= 3 and not any(c.isdigit() for c in w)]


@query("c07_c13_c15_train_and_predict")
def _(t):
    rows = t.messages.filter("reviewed AND ml_label IS NOT NULL").select("id", "subject", "body", "ml_label")
    known, test = split(rows, "ml_label")
    return predict(train(known), test, F.when(F.col("body").contains("signup"), "job_application")).select("id", "ml_label", "label", "score", "ignore")


@query("c15_telling_terms")
def _(t):
    model = pipeline().fit(prepared(t.messages.filter("reviewed AND ml_label IS NOT NULL").select("id", "subject", "body", "ml_label")))
    terms = [(part, w) for part in ("subject", "body") for w in telling_terms(Calibrated(model, []), part)]
    return t.spark.createDataFrame(terms, "part string, term string")


@query("c14_weak_labels", "SELECT CASE WHEN contains(body, 'purchase') THEN 'rejection' WHEN contains(body, 'signup') THEN 'job_application' WHEN contains(body, 'click') THEN 'interview_invite' ELSE 'other' END AS weak, count(*) AS n FROM messages WHERE ml_label IS NULL OR ml_label = 'other' GROUP BY 1")
def _(t):
    body = F.col("body")
    weak = F.when(body.contains("purchase"), "rejection").when(body.contains("signup"), "job_application").when(body.contains("click"), "interview_invite").otherwise("other")
    return t.messages.filter("ml_label IS NULL OR ml_label = 'other'").groupBy(weak.alias("weak")).agg(F.count("*").alias("n"))


@query("s05_f33_f35_mail_decoding", "SELECT id, subject, body FROM messages")
def _(t):
    head = F.concat(F.lit("From: "), "sender", F.lit("\nSubject: =?utf-8?B?"), F.base64(F.col("subject").cast("binary")), F.lit("?=\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nContent-Type: text/plain; charset=utf-8\n\n"))
    return t.messages.select("id", mail.decoded(F.concat(head, "body")).alias("m")).select("id", "m.subject", "m.body")


@query("s04_f32_api_messages", "SELECT id, subject, body, id % 4 <> 0 AS has_html FROM messages")
def _(t):
    # one part; alternatives; alternatives beside an attachment; alternatives inside related parts beside an attachment
    code = lambda c: F.translate(F.base64(c.cast("binary")), "+/\r\n", "-_")
    part = lambda kind, c: F.concat(F.lit(f'{{"mimeType":"{kind}","body":{{"data":"'), code(c), F.lit('"}}'))
    multi = lambda kind, *parts: F.concat(F.lit(f'{{"mimeType":"multipart/{kind}","parts":['), F.concat_ws(",", *parts), F.lit("]}"))
    file = F.lit('{"mimeType":"text/html","filename":"a.html","body":{"data":"PGI-bm88L2I-"}}')
    page = F.concat(F.lit("<html><style>p {}</style><p>"), "body", F.lit("</p></html>"))
    both = multi("alternative", part("text/plain", F.lit("plain")), part("text/html", page))
    kinds = [part("text/plain", F.col("body")), both, multi("mixed", file, both), multi("mixed", multi("related", both), file)]
    payload = F.get(F.array(*kinds), (F.col("id") % 4).cast("int"))
    raw = F.concat(F.lit('{"id":"'), "msg_id", F.lit('","payload":{"headers":[{"name":"Subject","value":"'), "subject", F.lit('"}],'), F.substr(payload, F.lit(2)), F.lit("}"))
    m = t.messages.select("id", raw.alias("raw")).select("id", mail.api_metadata("raw").alias("m"), mail.api_body("raw").alias("b"))
    return m.select("id", mail.header(F.col("m"), "subject").alias("subject"), "b.body", F.col("b.body_html").isNotNull().alias("has_html"))


def _raw_mails(t) -> DataFrame:  # noqa: ANN001
    """Raw mails of the messages: headers in two charsets, plain and HTML parts, a calendar, and an id of its own on every third."""
    subject = F.when(F.col("id") % 2 == 0, F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat("subject", F.lit(" é")), "utf-8")), F.lit("?="))).otherwise(F.concat(F.lit("=?iso-8859-1?Q?"), F.replace("subject", F.lit(" "), F.lit("_")), F.lit("_=E9?=")))
    own = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Message-ID: <"), "msg_id", F.lit("@x.example>\n"))).otherwise(F.lit(""))
    extra = [(7, 0, "List-Unsubscribe: <mailto:u@x.example>"), (8, 1, "Precedence: bulk"), (9, 2, "Auto-Submitted: auto-generated"), (10, 3, "Reply-To: r@x.example"), (11, 4, "Organization: Acme Works")]
    hints = F.concat(*(F.when(F.col("id") % n == k, f"{line}\n").otherwise("") for n, k, line in extra))
    head = F.concat(F.lit("From: "), "sender", F.lit("\nSubject: "), subject, F.lit("\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n"), own, hints, F.lit('MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n'))
    plain = F.concat(F.lit("--b\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(F.concat("body", F.lit(" ü")), "utf-8")), F.lit("\n"))
    page = F.concat(F.lit("--b\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>page=20of </p><b>"), "msg_id", F.lit(" =C3=BC</b>\n"))
    invite = F.concat(F.lit("--b\nContent-Type: text/calendar\n\nBEGIN:VEVENT\nORGANIZER;CN=X:mailto:Boss"), F.col("company_id").cast("string"), F.lit("@D2.example.com\nEND:VEVENT\n"))
    return t.messages.select("id", F.concat(head, F.when(F.col("id") % 4 < 3, plain).otherwise(F.lit("")), page, F.when(F.col("id") % 5 == 0, invite).otherwise(F.lit("")), F.lit("--b--\n")).alias("raw"))


@query("s05_f34_f35_nested_mail", "SELECT id, subject || ' é' AS subject, CASE WHEN id % 4 < 3 THEN body || ' ü' ELSE 'page of ' || msg_id || ' ü' END AS body, CASE WHEN id % 5 = 0 THEN 'boss' || company_id || '@d2.example.com' END AS organizer FROM messages")
def _(t):
    m = _raw_mails(t).select("id", mail.decoded("raw").alias("m"))
    return m.select("id", "m.subject", F.trim("m.body").alias("body"), "m.organizer")


@query("s06_f48_html_first_mail", "SELECT id, md5(subject || ' é' || 'Mon, 01 Jan 2024 10:00:00 +0000' || sender) AS msg_id, 'page of ' || msg_id || ' ü' AS body FROM messages")
def _(t):
    return _raw_mails(t).select("id", mail.decoded_html_first("raw").alias("m")).select("id", "m.msg_id", "m.body")


@query("s07_mail_with_id", "SELECT id, CASE WHEN id % 3 = 0 THEN msg_id || '@x.example' END AS msg_id, CASE WHEN id % 3 <> 0 THEN 'no message id' END AS error FROM messages")
def _(t):
    m = _raw_mails(t).select("id", mail.decoded_with_id("raw").alias("m"))
    return m.select("id", F.when(F.col("m.error").isNull(), F.col("m.msg_id")).alias("msg_id"), "m.error")


@query("s07_thread_assignment", "WITH k AS (SELECT subject, company_id, max_by(thread_id, (ts, id)) AS thread_id FROM messages WHERE id % 5 <> 0 GROUP BY 1, 2) SELECT m.msg_id, coalesce(k.thread_id, m.msg_id) AS thread_id FROM messages m LEFT JOIN k USING (subject, company_id) WHERE m.id % 5 = 0")
def _(t):
    # every fifth message is new mail, the others are known
    new = t.messages.filter("id % 5 = 0").select("msg_id", "subject", "company_id")
    return assign_threads(new, t.messages.filter("id % 5 <> 0")).select("msg_id", "thread_id")


@query("s08_s21_decoding_summary", "SELECT CASE WHEN id % 3 = 0 THEN 'ok' ELSE 'no message id' END AS outcome, count(*) AS n, count(*) FILTER (id % 5 = 0) AS invitations, count(*) FILTER (id % 7 = 0) AS newsletters FROM messages GROUP BY 1")
def _(t):
    return decoding_summary(_raw_mails(t).select(mail.decoded_with_id("raw").alias("m")).select("m.*"))


@query("f36_header_hints", "SELECT id, id % 7 = 0 AS newsletter, id % 8 = 1 AS bulk, false AS no_reply, id % 9 = 2 AS auto_submitted, CASE WHEN id % 10 = 3 THEN 'r@x.example' END AS reply_to, CASE WHEN id % 11 = 4 THEN 'Acme Works' END AS organization FROM messages")
def _(t):
    return _raw_mails(t).select("id", mail.decoded("raw")["header_hints"].alias("h")).select("id", "h.*")


@query("f42_mail_dates", "SELECT id, date_trunc('second', ts) AS ts FROM messages")
def _(t):
    # both forms, in turn
    text = F.when(F.col("id") % 2 == 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss Z")).otherwise(F.date_format("ts", "d MMM yyyy HH:mm:ss Z"))
    return t.messages.select("id", mail.parsed_date(text).alias("ts"))


@query("s14_pasted_spec", "SELECT s_suppkey AS id, 'from' AS name, '(a' || CAST(s_suppkey AS STRING) || '@x.example OR b@x.example)' AS value FROM supplier UNION ALL SELECT s_suppkey, 'subject', s_name FROM supplier")
def _(t):
    key = F.col("s_suppkey").cast("string")
    spec = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("From: (a"), key, F.lit("@x.example OR\n  b@x.example)\nSubject: "), "s_name", F.lit("\nnonsense\n")).alias("spec"))
    return spec.lateralJoin(PastedSpec(F.col("spec").outer()), None).select("id", "name", "value")


@query("s15_f30_page_text")
def _(t):
    return page_texts(t.pages).select("page_id", F.length("text").alias("n_chars"))


@query("f31_f39_page_content")
def _(t):
    return t.pages.select("page_id", F.length(html.sanitised("html")).alias("sanitised"), F.length(html.main_content("html")).alias("content"), html.career_link("html").alias("career"))


@query("f41_posting_text")
def _(t):
    return t.pages.select("page_id", posting("html").alias("p")).select("page_id", "p.source", "p.text")

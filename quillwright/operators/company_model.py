"""A company model for very many classes (C20): complement naive Bayes as sparse counts of (class, term), trained and used by equi-joins.

With N(t), N_c(t), N_c and N for counts of a term, a term in a class, a class and all, the weight of a term for a class is
log((N(t) - N_c(t) + a) / (N - N_c + a V)), and a text goes to the class whose complement explains it worst. Written as a sum over all terms that
is a dense product of texts and classes. But terms that a class lacks differ between classes by the class's size only, so

    score(text, c) = |text| log(N - N_c + a V) + sum over shared terms f(t) (log(N(t) + a) - log(N(t) - N_c(t) + a))

ranks the classes just the same, and needs no more than the classes that share a term with the text, and the smallest class, which is the
best of all others. No vector is as wide as the number of classes. ``most_classes`` leaves out terms that stand in more classes
(stop words), as a model's vocabulary does; it bounds the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..registry import query

ALPHA, MOST_CLASSES = 1.0, 1000


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _counts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, F.explode(terms(F.col(text))).alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("f"))


def train(rows: DataFrame, label: str, text: str, alpha: float = ALPHA, most_classes: int = MOST_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(vocabulary: t, c, gain), (classes: c, base): rows without a label or a text are left out."""
    pairs = _counts(rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("c"), F.col(text).alias("text")), ["c"], "text")
    by_term = pairs.groupBy("t").agg(F.sum("f").alias("n_t"), F.count("*").alias("classes")).filter(F.col("classes") <= most_classes)
    kept = written(pairs.join(by_term, "t"), "company-terms")
    total = kept.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n"), F.count_distinct("t").alias("v")).first()
    gain = F.log(F.col("n_t") + alpha) - F.log(F.col("n_t") - F.col("f") + alpha)
    classes = kept.groupBy("c").agg(F.sum("f").alias("n_c")).select("c", F.log(total["n"] - F.col("n_c") + alpha * total["v"]).alias("base"))
    return kept.select("t", "c", gain.alias("gain")), classes


def predict(rows: DataFrame, key: str, text: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, predicted, score): the best class of each text, the first by name of equals (to nine decimals); texts without a known term have none."""
    vocabulary, classes = model
    # texts are dealt out by key once; with a vocabulary that is broadcast, all that follows for a key stays in its task
    found = _counts(rows.select(key, text).repartition(F.col(key)), [key], text).join(vocabulary.select("t").distinct(), "t", "left_semi")
    length = found.groupBy(key).agg(F.sum("f").alias("length"))
    shared = found.join(vocabulary, "t").groupBy(key, "c").agg(F.sum(F.col("f") * F.col("gain")).alias("gain"))
    smallest = classes.groupBy().agg(F.min_by(F.struct("c", "base"), F.struct(-F.round("base", 9), "c")).alias("s"))  # one row
    score = F.struct(-F.round(F.col("length") * F.col("base") + F.col("gain"), 9), F.col("c"))  # the best is the least
    best = shared.join(length, key).join(classes, "c").groupBy(key, "length").agg(F.min(score).alias("b"))
    other = F.struct(-F.round(F.col("length") * F.col("s.base"), 9), F.col("s.c"))  # a shared class has this and a gain: it is never worse
    met = best.join(F.broadcast(smallest), F.lit(True)).select(key, F.least("b", other).alias("b"))
    return met.select(key, F.col("b.c").alias("predicted"), (-F.col("b.col1")).alias("score"))


_SQL = """WITH d AS (SELECT id, 'Firm ' || company_id % 20 AS c, lower(subject || ' ' || body) AS text FROM messages), x AS (SELECT id, c, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS t FROM d),
pairs AS (SELECT c, t, count(*) AS f FROM x WHERE id % 2 = 0 GROUP BY 1, 2), voc AS (SELECT t, sum(f) AS n_t FROM pairs GROUP BY 1), size AS (SELECT c, sum(f) AS n_c FROM pairs GROUP BY 1), total AS (SELECT sum(f) AS n, count(DISTINCT t) AS v FROM pairs),
f AS (SELECT id, t, count(*) AS f FROM x JOIN voc USING (t) GROUP BY 1, 2),
scored AS (SELECT f.id, s.c, round(sum(-f.f * ln((v.n_t - coalesce(p.f, 0) + 1) / (total.n - s.n_c + total.v))), 7) AS score FROM f JOIN voc v USING (t) CROSS JOIN size s CROSS JOIN total LEFT JOIN pairs p ON p.c = s.c AND p.t = f.t GROUP BY 1, 2)
SELECT id, min_by(c, (-score, c)) AS predicted FROM scored GROUP BY 1"""


@query("c20_company_model", _SQL)
def _(t):
    rows = t.messages.select("id", F.concat(F.lit("Firm "), (F.col("company_id") % 20).cast("string")).alias("company"), F.concat_ws(" ", "subject", "body").alias("text"))
    model = train(rows.filter("id % 2 = 0"), "company", "text")
    return predict(rows, "id", "text", model).select("id", "predicted")

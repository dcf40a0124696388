"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query


def merged_dictionary(new: DataFrame, old: DataFrame) -> DataFrame:
    """(domain, company, change): old entries (domain, old) with new ones (domain, company) put in: added, updated, same or kept."""
    change = F.when(F.col("old").isNull(), "added").when(F.col("company").isNull(), "kept").when(F.col("company") == F.col("old"), "same").otherwise("updated")
    return new.join(old, "domain", "full_outer").select("domain", F.coalesce("company", "old").alias("company"), change.alias("change"))


@query("u01_distinct", "SELECT DISTINCT job_title, status FROM threads")
def _(t):
    return t.threads.select("job_title", "status").distinct()


@query("u02_union_distinct", "SELECT company_id FROM messages WHERE ml_label = 'noise' UNION SELECT company_id FROM threads WHERE status = 'ghosted'")
def _(t):
    return t.messages.filter("ml_label = 'noise'").select("company_id").union(t.threads.filter("status = 'ghosted'").select("company_id")).distinct()


@query("u03_or_of_queries", "SELECT id FROM companies WHERE focus_area IS NULL OR focus_area = '' OR status IS NULL")
def _(t):
    return t.companies.filter(F.col("focus_area").isNull() | (F.col("focus_area") == "") | F.col("status").isNull()).select("id")


@query("u04_unified_events", "SELECT company_id, rejection_date AS day, 'thread' AS origin FROM threads WHERE rejection_date IS NOT NULL UNION ALL SELECT company_id, CAST(ts AS DATE), 'message' FROM messages WHERE ml_label = 'rejection'")
def _(t):
    a = t.threads.filter("rejection_date IS NOT NULL").select("company_id", F.col("rejection_date").alias("day"), F.lit("thread").alias("origin"))
    return a.unionByName(t.messages.filter("ml_label = 'rejection'").select("company_id", F.to_date("ts").alias("day"), F.lit("message").alias("origin")))


@query("u05_m08_set_comparison", "WITH a AS (SELECT DISTINCT company_id AS id FROM messages), b AS (SELECT id FROM companies WHERE status = 'application') SELECT (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) AS in_both, (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS only_first, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS only_second")
def _(t):
    # one full join tells all three figures
    a = t.messages.select(F.col("company_id").alias("id")).distinct().withColumn("a", F.lit(1))
    b = t.companies.filter("status = 'application'").select("id").distinct().withColumn("b", F.lit(1))
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return a.join(b, "id", "full_outer").agg(F.count_if(has_a & has_b).alias("in_both"), F.count_if(has_a & ~has_b).alias("only_first"), F.count_if(has_b & ~has_a).alias("only_second"))


@query("u06_union_of_dictionaries", "SELECT domain FROM domains WHERE kind = 'company' UNION SELECT domain FROM domains WHERE kind = 'personal' UNION SELECT DISTINCT domain FROM companies")
def _(t):
    d = t.domains
    return d.filter("kind IN ('company', 'personal')").select("domain").union(t.companies.select("domain")).distinct()


@query("u07_label_overlap", "WITH s AS (SELECT DISTINCT ml_label, company_id FROM messages WHERE ml_label IS NOT NULL) SELECT a.ml_label AS first, b.ml_label AS second, count(*) AS n FROM s a JOIN s b USING (company_id) WHERE a.ml_label < b.ml_label GROUP BY 1, 2")
def _(t):
    # a company has at most one row for each label: sets are collected instead of a self-join
    sets = t.messages.filter("ml_label IS NOT NULL").groupBy("company_id").agg(F.array_sort(F.collect_set("ml_label")).alias("s"))
    pairs = sets.select(F.explode("s").alias("first"), "s").select("first", F.explode("s").alias("second")).filter("first < second")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n"))


@query("u08_augment_with_dictionary", "WITH used AS (SELECT domain, count(*) AS n FROM companies GROUP BY 1) SELECT domain, n FROM used UNION ALL SELECT DISTINCT domain, 0 FROM domains WHERE domain NOT IN (SELECT domain FROM used)")
def _(t):
    used = t.companies.groupBy("domain").agg(F.count("*").alias("n"))
    missing = t.domains.select("domain").distinct().join(used, "domain", "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return used.unionByName(missing)


@query("u09_k17_dictionary_diff", "WITH new AS (SELECT 'd' || CAST(s_suppkey * 2 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '.example.com' ELSE '.co.example' END AS domain, 'Firm ' || CAST(s_suppkey * 2 % CASE WHEN s_suppkey % 4 = 0 THEN 47 ELSE 50 END AS STRING) AS company FROM supplier) SELECT coalesce(n.domain, o.domain) AS domain, CASE WHEN o.domain IS NULL THEN 'added' WHEN n.domain IS NULL THEN 'kept' WHEN n.company = o.company THEN 'same' ELSE 'updated' END AS change FROM new n FULL JOIN firm_domains o ON o.domain = n.domain")
def _(t):
    key = F.col("s_suppkey")
    domain = F.concat(F.lit("d"), (key * 2).cast("string"), F.when(key % 3 == 0, ".example.com").otherwise(".co.example"))
    new = t.supplier.select(domain.alias("domain"), F.concat(F.lit("Firm "), F.when(key % 4 == 0, key * 2 % 47).otherwise(key * 2 % 50).cast("string")).alias("company"))
    return merged_dictionary(new, t.firm_domains.select("domain", F.col("company").alias("old"))).select("domain", "change")

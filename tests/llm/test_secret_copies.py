"""Copies of a random string say nothing about other strings."""

import random

from pyspark.sql import functions as F

from quillwright.llm import secrets

CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def found(spark, texts):
    table = spark.createDataFrame([(i, f"x {k} y") for i, k in enumerate(texts)], "doc_id bigint, text string")
    return {r.doc_id for r in secrets.find_secrets(table).filter(F.size("spans") > 0).collect()}


def test_copies_do_not_lift_the_threshold(spark):
    rng = random.Random(11)
    keys = ["".join(rng.choice(CODE) for _ in range(40)) for _ in range(60)]
    words = ["thing", "nation", "other", "when", "house", "river", "cloud", "stone"]
    junk = ["A1" + "".join(rng.choice(words) for _ in range(7))[:38] for _ in range(400)]
    table = spark.createDataFrame([(k,) for k in keys], "text string").select("text", F.transform(secrets.matches(F.col("text"), secrets.CANDIDATE, "random"), lambda x: x.withField("inside", F.lit(False))).alias("c"))
    bins = {r.text: r.bin for r in secrets.battery(table).select("text", F.explode("c").alias("x")).select("text", "x.bin").collect()}
    copied = next(k for k in keys if 20 <= bins.get(k, 0) <= 45)
    got = found(spark, keys + junk + [copied] * 2000)
    alone = found(spark, keys + junk)
    assert set(range(460, 2460)) <= got
    assert got & set(range(460)) == alone and len([i for i in alone if i < 60]) >= 50
    assert not [i for i in alone if i >= 60]


def test_a_single_string_of_a_stratum(spark):
    rng = random.Random(11)
    assert found(spark, ["".join(rng.choice(CODE) for _ in range(150))]) == {0}


def test_strings_alone_in_their_strata(spark):
    """Random strings outside the base kinds, alone or few in a stratum, in each encoding."""
    rng, missed, total = random.Random(4), 0, 0
    codes = {"b36": "abcdefghijklmnopqrstuvwxyz0123456789", "B36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "b62": CODE[:62], "b64": CODE}
    for code in codes.values():
        for many in (1, 5):
            keys = ["".join(rng.choice(code) for _ in range(40)) for _ in range(many)]
            missed += many - len(found(spark, keys))
            total += many
    assert missed <= 1 and total == 24


def test_very_many_matches_in_one_text(spark):
    """Positions of 100,000 matches, base spans among them, and a text with each of them redacted."""
    n = 100_000
    one = spark.createDataFrame([(1, "é token=abcdef " * n)], "doc_id bigint, text string")
    r = secrets.find_secrets(one, keep_text=False).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last"), F.element_at("base", 2).alias("second")).first()
    assert (r.n, r.last.start, r.last.end, r.second.start) == (n, 15 * (n - 1) + 2, 15 * n - 1, 17)
    assert secrets.redact(one).first().text == "é [SECRET] " * n

"""A corpus pipeline of five of the training-data operators; each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwright.llm import langid, mixing, near_dup, secrets, sentencepiece_tok
from quillwright.llm.common import cut, new_folder, remove, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits a byte, in the best language, beyond which a text is like none of the learned languages.
FOREIGN_BITS = 6.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the predicted language; reject texts without a letter and texts like none of the languages.

    Null and empty texts have no letter: they go. Documents without a language are predicted but not learned from. Repeated rows are judged
    alike, each on its own; an empty table gives an empty one; columns beyond those of documents are left out.
    """
    found = langid.identify(docs, langid.fit(docs.select("text", "lang")))
    sure = (F.col("lang_pred") != "und") & (F.coalesce("bits_per_byte", F.lit(0.0)) <= FOREIGN_BITS)
    return found.filter(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates (SimHash, five-word shingles, similarity 0.8 or more): the one with the least id, or else the first stored.

    Null and empty texts are a class of their own; an id counts before none; rows that are equal in all columns are copies like others.
    """
    # ids can repeat or be null: rows are numbered in their order, once, in a written table
    numbered = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    classes = near_dup.near_duplicates(numbered).join(numbered.select("row", "doc_id"), "row")
    least = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return numbered.join(least.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; every document stays. A null text stays null, ``n_chars`` is that of the text as it is now."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit rates whose token totals are those without the toxic documents; a document is kept floor(rate) times, and once more with the rest's probability.

    Null and empty texts have no token; of several labels of a document the first in the order (toxic, low, high) counts, labels without an id or value
    are left out; without any label posteriors are even; repeated rows get equal rates and are drawn each on its own.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.draw(mixing.mix(docs.select(*COLUMNS), labels, gone="toxic")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token ids, their number, and whether decoding gives the text back and sentencepiece gives the same ids.

    A null text has null ids, round trip and parity, and 0 tokens; an empty one has no token and gives itself back.
    """
    return sentencepiece_tok.encode_decode(docs.select(*COLUMNS)).select(*COLUMNS, "ids", "n_tokens", "roundtrip", "parity")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The stages are models, iterations and a tokenizer: tests compare them with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. A stage's own tables, and then its input, are removed once its output is written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)

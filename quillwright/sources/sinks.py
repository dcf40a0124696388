"""Sinks (K01, K10-K16, K23): appends, reports and snapshots. A snapshot is written whole, then put in place by a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """K01/K14"""
    df.write.mode("append").partitionBy(*by).parquet(path)


def csv_report(df: DataFrame, path: str) -> None:
    """CSV with a header; one file for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame, path: str) -> None:
    """NDJSON."""
    df.write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """A new version beside the old one; readers follow the last line of ``_current``, written when all data is there."""
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    df.sparkSession.createDataFrame([(version,)], "value string").coalesce(1).write.mode("append").text(f"{root}/_versions/{version}")


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The latest complete version (names sort by time)."""
    last = spark.read.text(f"{root}/_versions/*").agg(F.max("value")).first()[0]
    return spark.read.parquet(f"{root}/{last}")


def write_dictionary(aliases: DataFrame, domains: DataFrame, path: str) -> None:
    """Dictionaries back to one sorted JSON document; they are configuration, of bounded size."""
    data = {
        "aliases": {r["alias"]: r["company"] for r in aliases.orderBy("alias").collect()},
        "domains": {r["domain"]: r["company"] for r in domains.filter("kind = 'company'").orderBy("domain").collect()},
        **{key: [r["domain"] for r in domains.filter(F.col("kind") == kind).orderBy("domain").collect()] for key, kind in (("ats", "ats"), ("headhunter", "headhunter"), ("job_boards", "job_board"))},
    }
    aliases.sparkSession.createDataFrame([(json.dumps(data, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:  # noqa: ANN001  a pyspark.ml model
    """K16"""
    model.write().overwrite().save(path)

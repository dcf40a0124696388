"""Operator 5 — global shuffle into shards by a two-pass external shuffle.

Pass 1 scatters records uniformly over memory-sized buckets by a seeded hash of the whole record and its place in the input (not of
the key alone, so that a key, a source or a null id that holds a third of all rows spreads out; nor of the record alone, so that rows
that are equal in every column do too). Pass 2 shuffles each bucket in memory by
Fisher-Yates, with a generator seeded by (seed, bucket), and writes it. The bucket's rows are sorted before, so that a
repeated task gives the same permutation. A cheap first job counts the buckets, and their offsets are a table that meets the buckets by a join (no list of buckets on
the driver); a row's rank in the whole shuffle is then its bucket's offset plus its place (a bucket whose size differs from the count fails: the input must read the same twice, as files do), and rank g of n goes to shard floor(g * shards / n): counts differ by one at most and
a bucket touches one or two shards, so few files are written.

Law: ``rows``. Defined results: null text — size 16, CRC-32 of no bytes; repeated rows — each gets a slot of its own (rows
that are equal in every column are interchangeable); empty table — an empty result; extra columns are carried along, but for those
named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, field, free, new_folder, pieces, without

SHARDS, SEED, BUCKET_BYTES, GROUP = 40, 20240229, 8 << 20, 4096


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0 .. n - 1."""
    order = np.arange(n)
    draws = rng.integers(0, np.arange(1, n + 1)) if n else order  # draws[i] is uniform on 0 .. i
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def two_pass_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write all rows of ``docs``, shuffled, under ``path`` (a folder for each shard) and return them with ``shard``, ``slot``.

    ``bucket_bytes`` is a bucket's share of the stored input; about four times as much is held in a worker.
    """
    spark = docs.sparkSession
    buckets = pieces(docs, bucket_bytes)
    docs = docs.select(*without(docs.columns, "shard", "slot"))
    # a full hash of the row, maps and variants aside, which Spark doesn't hash
    hashed = [F.monotonically_increasing_id(), *(f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)]
    bucket, place = free(docs.columns, "bucket"), free(docs.columns, "place")
    given = docs.select(F.pmod(F.xxhash64(F.lit(seed), *hashed), F.lit(buckets)).alias(bucket), F.xxhash64(F.lit(seed + 1), *hashed).alias(place), "*")
    # rows before each bucket: sums inside groups of buckets, and over the groups; one number for the whole reaches the driver
    sizes = cut(given.groupBy(F.col(bucket).alias("b")).agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("b") / GROUP)), "shuffle-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = sizes.groupBy("g").agg(F.sum("n").alias("m")).select("g", F.coalesce(F.sum("m").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("near", near).join(groups, "g").select(F.col("b").alias(bucket), "n", (F.col("far") + F.col("near")).alias("before"))
    path = path or f"{new_folder(spark, 'shards')}/data"
    schema = ", ".join(["shard int", "slot bigint", *map(field, docs.schema)])

    def shuffle(key: tuple, table: pa.Table, counted: pa.Table) -> pa.Table:
        b, n, first = key[0].as_py(), *(counted.column(c)[0].as_py() if counted.num_rows else 0 for c in ("n", "before"))
        if table.num_rows != n:
            raise ValueError(f"bucket {b}: {n} rows when counted, {table.num_rows} now: write the input to a table first")
        table = table.sort_by([(place, "ascending")]).drop_columns([bucket, place])
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, b]))
        rank = first + np.arange(table.num_rows)
        shard = rank * shards // total
        slot = rank - -(-shard * total // shards)
        table = table.take(pa.array(order))
        return pa.table([pa.array(shard.astype(np.int32)), pa.array(slot), *table.columns], names=["shard", "slot", *table.column_names])

    given.groupBy(bucket).cogroup(offsets.groupBy(bucket)).applyInArrow(shuffle, schema).write.partitionBy("shard").parquet(path)
    if not total:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def op5_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return two_pass_shuffle(docs).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Operator 13 — line dedup by levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; of it only a 128-bit hash is kept (two
XXH64 with different seeds). Documents arrive in batches, by ascending id. ``LineRuns`` holds what earlier batches had as
runs: tables of (hash, first document) that are bucketed by the hash and sorted within buckets. A new batch sums up its own
keys (least document of each), merge-anti-joins them with every run, where neither side of a run is shuffled or sorted
anew, and writes what is left as a run of its own. ``fanout`` runs of one level are compacted into one of the next, so
there are O(fanout * log(batches)) runs. In the end each key stands once in the runs, with the least document that holds it.

A line is dropped where its (hash, document) isn't in the runs. That anti-join is by hash *and* document, so a line that
millions of documents share is spread over all tasks. The places of dropped lines go back to their document, and what is left is
joined natively. DataFrame functions only: no Python touches a row.

Broadcast: nothing by hint. Driver: the ``batches`` - 1 id bounds and the names of the runs.

Defined results: null or empty text — one empty line, which stays; keys of under ``least`` code points always stay; a line that
repeats within one document stays there each time; rows of one id count as one document (all keep the line if the id is the
least); all rows without an id count as one document, after all others; rows that are equal in id and text are treated alike; empty table — an empty result;
extra columns are carried along, but for those named like a result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, new_folder, remove, without

SPACE = " \t\n\v\f\r"
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, BATCHES, FANOUT = 10, 8, 3
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER_CASE)


class LineRuns:
    """Levels of sorted runs of (k1, k2, z, d): a key's hash and its first document (z: it has no id; d: the id)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a batch's sums come in so many parts, too
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_folder(self.spark, "line-run")
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.paths[name]}/data").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.paths.pop(name))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (k1, k2, z, d), repeats allowed; every batch's documents come after those of the batches before."""
        first = keys.groupBy(*KEY).agg(F.min(F.struct("z", "d")).alias("first"))
        for name in self.names():
            first = first.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        self._push(0, self._write(first.select(*KEY, "first.*")))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:  # runs share no key: compaction is a union, written in order
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._union(old).repartition(self.buckets, *KEY))
            for gone in old:
                self._drop(gone)
            self._push(level + 1, merged)

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.union(self.spark.table(name))
        return out

    def owners(self) -> DataFrame:
        return self._union(self.names())

    def close(self) -> None:
        """Remove all runs."""
        for name in self.names():
            self._drop(name)
        self.levels = []


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and ``n_lines`` (before), ``n_dropped``. The id column is a number."""
    spark = docs.sparkSession
    docs = docs.select(*without(docs.columns, "n_lines", "n_dropped"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.col(f"`{id_column}`")
    row = [number.isNull().alias("z"), F.coalesce(number, F.lit(0)).alias("d"), F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")]
    shares = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(number, shares)).first()[0] if shares else []
    batch = sum((F.col("d") > F.lit(b)).cast("int") for b in bounds or []) + F.lit(0)
    lines = docs.select(*row, F.posexplode(F.split(whole, "\n", -1)).alias("at", "line")).withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= least)
    lines = lines.select(F.when(F.col("z"), len(bounds or [])).otherwise(batch).alias("batch"), "z", "d", "t1", "t2", "at", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"))
    path = f"{new_folder(spark, 'lines')}/data"
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(len(bounds or []) + 1):
        runs.add(lines.filter(F.col("batch") == b).select(*KEY, "z", "d"))
    gone = lines.join(runs.owners(), [*KEY, "z", "d"], "left_anti").groupBy("z", "d", "t1", "t2").agg(F.collect_list("at").alias("gone"))
    gone = cut(gone, "lines-gone")
    runs.close()
    remove(path)
    names = {c: free([*docs.columns, "z", "d", "t1", "t2", "gone"], f"own_{c}") for c in ("z", "d", "t1", "t2")}
    gone = gone.select(*(F.col(c).alias(names[c]) for c in names), F.col("gone").alias(free(docs.columns, "gone")))
    dropped, split = F.col(free(docs.columns, "gone")), F.split(whole, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), dropped)
    found = docs.select("*", *(c.alias(n) for c, n in zip(row, names.values(), strict=True))).join(gone, list(names.values()), "left")
    left = F.when(dropped.isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(kept, lambda k: F.get(split, k)), "\n"))
    n_dropped = F.coalesce(F.size(F.array_distinct(dropped)), F.lit(0)).cast("bigint")
    return found.select(*(left.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns), F.size(split).cast("bigint").alias("n_lines"), F.when(dropped.isNull(), F.lit(0).cast("bigint")).otherwise(n_dropped).alias("n_dropped"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Rows of one id count as one document there, too; rows without an id as one after all others.
ORACLE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
exploded AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place, len(parts) AS n FROM rows),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM exploded),
held AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS owner, count(DISTINCT coalesce(doc_id, 9223372036854775807)) AS n_docs FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT y.*, coalesce(h.n_docs >= 2 AND coalesce(y.doc_id, 9223372036854775807) <> h.owner, false) AS gone FROM keyed y LEFT JOIN held h ON y.k = h.k)
SELECT doc_id, max(n) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

"""Dictionaries that change while a stream runs (S09, K13): a versioned dimension, looked at again for every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .readers import dictionary


class VersionedDictionary:
    """A JSON dictionary that is read anew when its file is another one: by modification time and length, through Spark's file listing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version, self.frames = spark, path, None, {}

    def current(self) -> tuple[str, dict[str, DataFrame]]:
        """(version, dimensions) as of now; the version tells files apart and sorts by time."""
        found = self.spark.read.format("binaryFile").load(self.path).agg(F.max("modificationTime").alias("t"), F.sum("length").alias("n"), F.count("*").alias("k")).first()
        if not found["k"]:
            raise FileNotFoundError(self.path)
        version = f"{found['t'].isoformat(timespec='milliseconds')}/{found['n']}"
        if version != self.version:
            self.version, self.frames = version, dictionary(self.spark, self.path)
        return self.version, self.frames


def with_dictionary(rows: DataFrame, words: VersionedDictionary, use: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], path: str | None = None) -> str:
    """Run a stream whose batches meet the dictionary as it is when the batch begins; returns the folder that holds ``rows`` and the checkpoint.

    Each row carries ``dictionary_version``. A batch is a folder named after it, so a repeated batch replaces itself. Given the same ``path`` again,
    the stream goes on where it stopped.
    """
    path = path or new_path(rows.sparkSession, "versioned")

    def put(batch: DataFrame, number: int) -> None:
        version, frames = words.current()
        use(batch, frames).withColumn("dictionary_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).start().awaitTermination()
    return path

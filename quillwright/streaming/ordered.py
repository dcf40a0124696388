"""Keyed state over a stream in event-time order (``transformWithState``), whatever order and batches rows arrive in.

Keys are dealt out to buckets by a hash, and a bucket is one grouping key of Spark's, so that the state store is asked a few times a bucket and
batch, not a few times a key. A row waits in its bucket's list state until the watermark has passed it; a timer at the earliest waiting row then
folds all rows of a key up to the watermark, by time and the columns after it, into the key's state. As no row at or before the watermark
can come any more, the result is that of one sorted batch. A key without waiting rows is forgotten ``idle`` after its last row. A bucket's waiting rows and states are
in memory when they are folded; ``buckets`` has to stay the same for a stream's life.

Needs the RocksDB state store: ``in_event_order`` sets it for the session, unless another one is set.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Buckets of keys.
BUCKETS = 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (key, state or none, waiting rows in order) -> (new state, rows to give)
Fold = Callable[[tuple, tuple | None, list[tuple]], tuple[tuple, list[tuple]]]


class OrderedFold(StatefulProcessor):
    """Rows (key, us, *columns) of a bucket, folded key by key in order as the watermark passes them."""

    def __init__(self, columns: list[str], row_type: StructType, state_type: StructType, out: list[str], fold: Fold, idle_ms: int) -> None:
        self.columns, self.row_type, self.state_type, self.out, self.fold, self.idle_ms = columns, row_type, state_type, out, fold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_type)
        # (key, instant of its last row, *state) of each key
        self.states = handle.getListState("states", StructType([StructField("key_", StringType()), StructField("last_", LongType()), *self.state_type.fields]))

    def _timer(self, ms: int) -> None:
        """One timer a bucket."""
        for old in list(self.handle.listTimers()):
            if old != ms:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            part = part[["key_", "us_", *self.columns]].astype(object)
            given = list(part.where(part.notna(), None).itertuples(index=False, name=None))
            self.waiting.appendList(given)
            least = min(r[1] for r in given)
            first = least if first is None else min(first, least)
        timers = list(self.handle.listTimers())
        if first is not None:  # a timer that is already earlier stays
            due = first // 1000 + 1
            if not timers or due < min(timers):
                self._timer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        ready, left, states, out = {}, [], {r[0]: tuple(r) for r in self.states.get()}, []
        for r in map(tuple, self.waiting.get()):
            if r[1] <= now * 1000:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                left.append(r)
        for k, rows in ready.items():
            rows.sort(key=lambda r: tuple((x is None, x) if x is not None else (True,) for x in r))
            state, given = self.fold(tuple(json.loads(k).values()), states[k][2:] if k in states else None, rows)
            states[k] = (k, rows[-1][0], *state)
            out += given
        wait = {r[0] for r in left}
        kept = [x for x in states.values() if x[0] in wait or x[0] in ready or x[1] // 1000 + self.idle_ms > now]
        for state, rows in ((self.waiting, left), (self.states, kept)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        due = [min(r[1] for r in left) // 1000 + 1] if left else []
        due += [max(now + 1, x[1] // 1000 + self.idle_ms) for x in kept if x[0] not in wait]
        if due:
            self.handle.registerTimer(min(due))
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def in_event_order(rows: DataFrame, keys: list[str], ts: str, columns: list[str], state: str, out: str, fold: Fold, late: str = "30 days", idle: str = "30 days", mode: str = "append", buckets: int = BUCKETS) -> DataFrame:
    """``fold`` over the rows of each key by (``ts``, *``columns``); ``late`` bounds the disorder, ``state`` and ``out`` are schemas.

    The rows given to ``fold`` are tuples (microseconds, *columns), nulls as None and after other values; keys are
    strings, numbers or booleans.
    """
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    given = rows.withWatermark(ts, late).select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket_"), packed.alias("key_"), ts, F.unix_micros(ts).alias("us_"), *columns)
    row_type = StructType([given.schema[c] for c in ("key_", "us_", *columns)])
    out_type = StructType.fromDDL(out)
    processor = OrderedFold(columns, row_type, StructType.fromDDL(state), out_type.fieldNames(), fold, int(pd.Timedelta(idle).total_seconds() * 1000))
    return given.groupBy("bucket_").transformWithStateInPandas(processor, out_type, mode, "EventTime")

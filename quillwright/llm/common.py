"""Shared plumbing of the training-data operators.

* ``shared_dir`` / ``cut`` — the only places where lineage is cut; both use the folder named in
  ``spark.checkpoint.dir``. ``scratch`` removes what was put there inside its block.
* ``ShardedCounts`` — counts of 64-bit hashes over a whole corpus, kept as sorted arrays in files of the shared
  folder, one file per hash range, memory-mapped by the workers that look hashes up.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ---------------------------------------------------------------- shared folder


_own: dict[str, str] = {}  # temporary folders of local applications
_made: list[str] = []  # folders that this driver has put into the shared one


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one (tests) gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = _own.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="quillwright-")
        _own[spark.sparkContext.applicationId] = path  # the setting itself can't be changed in a running session
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared one, as a URI."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = filesystem(path)
    fs.create_dir(at, recursive=True)
    _made.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, and nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for df in tables:
        remove(df.cut_path)
        if df.cut_path in _made:
            _made.remove(df.cut_path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables and folders made inside the block; a result must have been written elsewhere by then."""
    mark = len(_made)
    try:
        yield
    finally:
        for path in _made[mark:]:
            remove(path)
        del _made[mark:]


def free(names: Iterable[str], wish: str) -> str:
    """``wish``, with underscores before it until no column has the name (Spark's names ignore case)."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def without(names: Iterable[str], *gone: str) -> list[str]:
    """``names`` but for those in ``gone``, whatever their case."""
    out = {g.lower() for g in gone}
    return [n for n in names if n.lower() not in out]


def field(f) -> str:
    """A field of a schema in DDL."""
    return f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if not urlparse(path).scheme:
        path = os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def remove(path: str) -> None:
    fs, at = filesystem(path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)


def write_file(path: str, *parts) -> None:
    """Write under another name, then rename: a lost or repeated task never leaves half a file."""
    fs, at = filesystem(path)
    temp = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    fs.move(temp, at)


class Mapped:
    """Read-only arrays of the shared folder.

    Files of a local or mounted file system are memory-mapped where they are. Of any other store, which can't be mapped,
    the files used last are held in memory, up to ``bound`` bytes. A missing file is an error.
    """

    def __init__(self, bound: int = 256 << 20) -> None:
        self._maps: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()
        self._held, self._bound = 0, bound

    def array(self, path: str, dtype) -> np.ndarray:
        key = (path, str(dtype))
        if key in self._maps:
            self._maps.move_to_end(key)
            return self._maps[key]
        fs, at = filesystem(path)
        if isinstance(fs, pafs.LocalFileSystem):
            found = np.asarray(np.memmap(at, dtype=dtype, mode="r")) if os.path.getsize(at) else np.empty(0, dtype)  # plain arrays: slicing a memmap is slow
        else:
            with fs.open_input_stream(at) as src:
                found = np.frombuffer(src.read(), dtype)
            self._held += found.nbytes
            while self._held > self._bound and self._maps:
                self._held -= self._maps.popitem(last=False)[1].nbytes
        self._maps[key] = found
        return found

    def close(self) -> None:
        self._maps.clear()
        self._held = 0

    def __enter__(self) -> Mapped:
        return self

    def __exit__(self, *_) -> None:
        self.close()


# ---------------------------------------------------------------- sizes


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``'s inputs (file sizes for file tables); where it has none (rows from the driver), the strings are measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if total < 1 << 60:
        return total
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(16)).cast("double"))).first()[0] or 0)


def pieces(df: DataFrame, target_bytes: int) -> int:
    """How many pieces of about ``target_bytes`` of input there are: grows in proportion to the input."""
    return max(1, -(-plan_bytes(df) // target_bytes))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished, unreferenced plans before the next pass writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def placed(df: DataFrame, order: list, name: str, place: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in the whole order: range partitions are sorted and written, and their sizes (a row a
    partition on the driver) give the places. ``order`` should tell rows apart, or else equal rows share a partition."""
    at = free(df.columns, "at")
    table = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)
    sizes = sorted((r[0], r[1]) for r in table.groupBy(F.shiftright(at, 33)).count().collect())
    starts, part, start = [], free(df.columns, "part"), free([*df.columns, place], "start")
    for k, n in sizes:
        starts.append((k, starts[-1][1] + starts[-1][2] if starts else 0, n))
    begun = df.sparkSession.createDataFrame([(k, before) for k, before, _ in starts], f"`{part}` bigint, `{start}` bigint")
    joined = table.join(F.broadcast(begun), F.shiftright(at, 33) == F.col(f"`{part}`"))
    out = joined.select(*(f"`{c}`" for c in df.columns), (F.col(f"`{start}`") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(place))
    out.cut_path = table.cut_path
    return out


# ---------------------------------------------------------------- words and hashes


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets everything when it holds ``bound`` words, so memory stays bounded."""

    def __init__(self, bound: int = 300_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or b"").translate(LOWER).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of MurmurHash3), for arrays."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def unique_sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, dtype=counts.dtype)


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them; by hashing, as values repeat much."""
    code, found = pd.factorize(values)
    by = np.argsort(found)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return found[by], rank[code]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# ---------------------------------------------------------------- counts of hashes

Extractor = Callable[[list], np.ndarray]


class ShardedCounts:
    """Sorted hash arrays of a corpus with their counts: shard s holds the hashes whose top bits are s.

    ``offsets[s]`` is the rank of the shard's first hash, so the rank of a hash over all shards is its dense id.
    """

    def __init__(self, folder: str, bits: int, sizes: list[int], total: int, heavy: dict[int, int]) -> None:
        self.folder, self.bits, self.sizes, self.total, self.heavy = folder, bits, sizes, total, heavy
        self.offsets = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))).astype(np.int64)

    @property
    def distinct(self) -> int:
        return int(self.offsets[-1])

    def find(self, maps: Mapped, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense ids (``distinct`` where absent) and counts (0 where absent) of sorted, distinct hashes."""
        ids = np.full(len(hashes), self.distinct, dtype=np.int64)
        counts = np.zeros(len(hashes), dtype=np.int64)
        bounds = [0, len(hashes)]
        if self.bits:
            edges = np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
            bounds = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
        for s, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if lo == hi or not self.sizes[s]:
                continue
            keys = maps.array(f"{self.folder}/{s:06d}.keys", np.uint64)
            at = np.minimum(np.searchsorted(keys, hashes[lo:hi]), len(keys) - 1)
            hit = keys[at] == hashes[lo:hi]
            ids[lo:hi][hit] = at[hit] + self.offsets[s]
            counts[lo:hi][hit] = maps.array(f"{self.folder}/{s:06d}.counts", np.uint64)[at[hit]]
        return ids, counts


def _blobs(bits: int, extract: Extractor, column: str, flush: int):
    """mapInArrow: texts -> one row of sorted hashes and counts for each shard and about ``flush`` hashes."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
        bounds = [0, *edges.tolist(), len(keys)]
        rows = [(s, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        state = extract()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
            for lo in range(0, len(texts), 256):
                got = state(texts[lo : lo + 256].to_pylist())
                held.append(got)
                n += len(got)
                if n >= flush:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def count_hashes(docs: DataFrame, column: str, extract: Callable[[], Extractor], name: str, *, shard_bytes: int = 64 << 20, flush: int = 4_000_000, least: int = 1, heaviest: int = 256) -> ShardedCounts:
    """Count the hashes that ``extract()`` gives for lists of texts, over the whole of ``docs``.

    Each map task sums what it has read before the shuffle, so that a frequent hash costs a row's part in each task and
    cannot make one reducer larger than others; the number of shards follows the input's size, so that one shard's
    arrays fit a worker. ``least`` keeps only hashes with so many occurrences. Each shard reports its ``heaviest``
    counts to the driver (a bounded list).
    """
    spark = docs.sparkSession
    folder = new_folder(spark, name)
    bits = max(0, int(np.ceil(np.log2(pieces(docs, shard_bytes)))))
    blobs = docs.select(column).mapInArrow(_blobs(bits, extract, column, flush), "shard int, keys binary, counts binary")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.uint64)
        keys, counts = unique_sum(keys, counts)
        total = int(counts.sum())
        if least > 1:
            keep = counts >= least
            keys, counts = keys[keep], counts[keep]
        write_file(f"{folder}/{s:06d}.keys", keys.tobytes())
        write_file(f"{folder}/{s:06d}.counts", counts.tobytes())
        top = np.argpartition(counts, -heaviest)[-heaviest:] if len(counts) > heaviest else np.arange(len(counts))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([total], pa.int64()), "top": pa.array([top.astype(np.int64).tolist()], pa.list_(pa.int64())), "top_counts": pa.array([counts[top].astype(np.int64).tolist()], pa.list_(pa.int64()))})

    said = blobs.groupBy("shard").applyInArrow(merge, "shard int, n bigint, total bigint, top array<bigint>, top_counts array<bigint>").collect()
    sizes, total, heavy = [0] * (1 << bits), 0, {}
    for r in said:
        sizes[r["shard"]] = r["n"]
        total += r["total"]
    offsets = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
    for r in said:
        heavy.update({int(offsets[r["shard"]] + i): c for i, c in zip(r["top"], r["top_counts"], strict=True)})
    return ShardedCounts(folder, bits, sizes, total, heavy)


def id_text() -> F.Column:
    """doc_id as UTF-8 text; a null id counts as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")

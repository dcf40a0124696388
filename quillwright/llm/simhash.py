"""Operator 6 — near-duplicate classes from 64-bit SimHash fingerprints, compared bit-sliced.

* fingerprints: 3-word shingles of the lower-cased (A-Z) whole text, XXH64 with seed 42, a bit is 1 if it is set in over
  half of the shingles' hashes, repeats included;
* equal fingerprints are folded first (a map-side combined aggregate), so a group of copies of any size costs one row;
* distinct fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` parts
  of the 64 bits. Each such choice of parts is a table; fingerprints meet in the bucket of a table. The number of parts
  grows with the number of fingerprints, so that a bucket of spread fingerprints stays small at any size;
* in a bucket bit planes are stored vertically: bit b of 64 fingerprints is one word. One fingerprint is compared with
  all lanes of a block by XOR with a constant per plane and a carry-save counter that saturates beyond the radius; a
  block is abandoned as soon as all its lanes are beyond;
* a bucket yields a spanning forest of its links, never all pairs; buckets over ``tile`` rows are dealt out as pairs of
  tiles (no cap, no sampling), so a hot bucket isn't one task's work;
* components come from alternating large-star and small-star rounds on tables in the shared folder.

Defined results: null or empty text — no word, fingerprint zero, linked like any other; null ``doc_id`` — takes part, and
is the smallest id only of a component in which all ids are null; repeated rows — equal results on each; very long texts
are processed whole, in windows; extra columns are ignored by the query and kept by ``near_duplicates``, but for those
named like a result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, field, free, ranges, without, words_of
from .components import components

SEED = 42
_WINDOW = 1 << 16  # shingles whose bits are summed at a time


def shingle_hashes(text: bytes | None, width: int = 3) -> list[int]:
    """XXH64 of each shingle of ``width`` words; of the whole sequence if there are fewer; none for no word."""
    words = words_of(text)
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return [digest(view[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)]


def fingerprints(texts: list, width: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    hashes = [shingle_hashes(t, width) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, count=int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)
    sums = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(flat), _WINDOW):
        part, own = flat[lo : lo + _WINDOW], owner[lo : lo + _WINDOW]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without the text, with ``fp`` (the fingerprint as a signed 64-bit integer)."""
    kept, own = without(docs.columns, text, "fp", "component_id"), free(docs.columns, "bytes")
    given = docs.select(*kept, F.col(text).alias(own))
    fields = ", ".join([*(field(f) for f in given.schema if f.name != own), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fp = fingerprints(part.column(at).cast(pa.binary()).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    return given.mapInArrow(run, fields)


# ---------------------------------------------------------------- bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: planes[b, w] holds bit b of fingerprints 64 w .. 64 w + 63."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int, every: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) pairs at distance ``radius`` or less, by carry-save counting over bit planes.

    ``radius`` is at most 3: ``ones`` and ``twos`` hold the count's two low bits of 64 lanes each and ``over`` tells the
    lanes that have gone beyond. After every few planes, (query, word) blocks with all lanes beyond are dropped.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    words = planes.shape[1]
    q, w = (x.ravel() for x in np.indices((len(queries), words)))
    last = np.zeros(words, np.uint64)
    if lanes % 64:
        last[-1] = ~np.uint64(0) << np.uint64(lanes % 64)
    ones, twos, over = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), last[w]
    masks = np.zeros((64, len(queries)), np.uint64)
    for b in range(64):
        masks[b] = np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1))
    for b in range(64):
        x = planes[b][w] ^ masks[b][q]
        carry = ones & x
        ones ^= x
        over |= twos & carry  # 3 + 1
        twos ^= carry
        if b % every == every - 1:
            alive = over != ~np.uint64(0)
            if not alive.all():
                q, w, ones, twos, over = q[alive], w[alive], ones[alive], twos[alive], over[alive]
                if not len(q):
                    break
    if radius < 3:
        over |= twos if radius < 2 else twos & ones
        if radius == 0:
            over |= ones
    hit = ~over
    found = np.flatnonzero(hit)
    bits = np.unpackbits(hit[found].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return q[found][row], w[found][row] * 64 + lane


def within_wide(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """Masks (query, word of 64 lanes) of the pairs at distance ``radius`` or less, for any radius and fingerprints of several words.

    ``queries`` has a row of words for each fingerprint, ``planes`` the planes of all words, one after another. Counters have as
    many bits as ``radius`` needs and start so high that one more than it overflows; planes are added by a tree of carry-save adders.
    """
    top = radius.bit_length()
    shape = (len(queries), planes.shape[1])
    spare = (1 << top) - 1 - radius
    count = [np.full(shape, ~np.uint64(0) if spare >> i & 1 else 0, np.uint64) for i in range(top)]
    held, half = [np.empty(shape, np.uint64) for _ in range(top + 1)], np.empty(shape, np.uint64)
    flips = np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").T[:, :, None] * ~np.uint64(0)

    def add(level: int, b: int, x: np.ndarray) -> None:
        """Adds 2**level planes from ``b`` on; ``x`` gets the carry of that weight."""
        if not level:
            np.bitwise_xor(planes[b], flips[b], out=x)
            return
        y, c = held[level - 1], count[level - 1]
        add(level - 1, b, x)
        add(level - 1, b + (1 << (level - 1)), y)
        np.bitwise_xor(c, x, out=half)
        np.bitwise_and(c, x, out=x)
        np.bitwise_xor(half, y, out=c)
        np.bitwise_and(half, y, out=half)
        np.bitwise_or(x, half, out=x)

    over = np.zeros(shape, np.uint64)
    if lanes % 64:
        over[:, -1] = ~np.uint64(0) << np.uint64(lanes % 64)
    for b in range(0, len(planes), 1 << top):
        add(top, b, held[top])
        over |= held[top]
    return ~over


def links_in(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into left, into right) of a spanning forest of the links between two lists of fingerprints."""
    n = len(left)
    root = list(range(n if same else n + len(right)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []
    planes = planes_of(right)
    step = max(1, (1 << 18) // planes.shape[1])
    for lo in range(0, n, step):
        q, lane = within(left[lo : lo + step], planes, len(right), radius)
        for i, j in zip((q + lo).tolist(), lane.tolist(), strict=True):
            if same and j <= i:
                continue
            a, b = find(i), find(j if same else n + j)
            if a != b:
                root[a] = b
                out.append((i, j))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _small_buckets(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small buckets at once: the lanes are the buckets' pairs, their differences the planes."""
    before = np.arange(len(fps)) - np.repeat(starts, sizes)
    right = np.repeat(np.arange(len(fps)), before)
    left = ranges(np.repeat(starts, sizes), before)
    hits = []
    for lo in range(0, len(left), 1 << 16):
        a, b = left[lo : lo + (1 << 16)], right[lo : lo + (1 << 16)]
        hits.append(lo + within(np.zeros(1, np.uint64), planes_of(fps[a] ^ fps[b]), len(a), radius)[1])
    hit = np.concatenate(hits) if hits else np.empty(0, np.int64)
    return left[hit], right[hit]


_SMALL = 24


def _bucket_links(radius: int):
    """mapInArrow over rows sorted by (table, key, tile pair, side): node pairs that are linked."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        cols = [rows.column(c).to_numpy() for c in ("t", "key", "pair")]
        fps, side, node = rows.column("fp").to_numpy().view(np.uint64), rows.column("side").to_numpy(), rows.column("node").to_numpy()
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        crossing = np.add.reduceat(side, starts) > 0
        a, b = [], []
        small = np.flatnonzero((sizes > 1) & (sizes <= _SMALL) & ~crossing)
        if len(small):
            at = ranges(starts[small], sizes[small])
            first = np.cumsum(sizes[small]) - sizes[small]
            i, j = _small_buckets(fps[at], first, sizes[small], radius)
            a.append(node[at[i]])
            b.append(node[at[j]])
        for k in np.flatnonzero((sizes > 1) & ((sizes > _SMALL) | crossing)).tolist():
            s, e = int(starts[k]), int(starts[k] + sizes[k])
            if crossing[k]:
                m = s + int((side[s:e] == 0).sum())
                i, j = links_in(fps[s:m], fps[m:e], False, radius)
                j = j + (m - s)
            else:
                i, j = links_in(fps[s:e], fps[s:e], True, radius)
            a.append(node[s + i])
            b.append(node[s + j])
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 100_000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            cols = [rows.column(c).to_numpy() for c in ("t", "key", "pair")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
            if not len(new):
                continue
            last = int(new[-1]) + 1  # the last bucket may go on in the next batch
            yield solve(rows.slice(0, last))
            held = rows.slice(last).to_batches()
            n = rows.num_rows - last
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def tables_for(count: int, radius: int = 3, bucket: int = 1024) -> list[tuple[int, ...]]:
    """Bit positions of each table's key: the fewest parts that keep buckets of spread fingerprints under ``bucket``."""
    for blocks in range(radius + 1, 9):
        parts = [tuple(range(64 * i // blocks, 64 * (i + 1) // blocks)) for i in range(blocks)]
        chosen = [sum(c, ()) for c in itertools.combinations(parts, blocks - radius)]
        if count <= bucket << min(map(len, chosen)):
            break
    return chosen


def links(nodes: DataFrame, radius: int = 3, tile: int = 512) -> DataFrame:
    """(a, b) node pairs whose fingerprints differ in ``radius`` bits or fewer, enough of them to connect each component.

    ``nodes`` has ``node`` (long) and ``fp`` (long), each fingerprint once.
    """
    spark = nodes.sparkSession
    tables = tables_for(nodes.count(), radius)
    masks = F.array(*(F.lit(int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))) for bits in tables))
    rows = nodes.select("node", "fp", F.posexplode(masks).alias("t", "mask")).select("node", "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    big = cut(rows.groupBy("t", "key").count().filter(F.col("count") > tile).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).drop("count"), "simhash-big")
    rows = rows.join(big, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select("node", "fp", "t", "key", (low.cast("long") * F.col("tiles") + high).alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rows = rows.repartition(F.col("t"), F.col("key"), F.col("pair")).sortWithinPartitions("t", "key", "pair", "side")
    return rows.mapInArrow(_bucket_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 3, width: int = 3) -> DataFrame:
    """``docs`` without the text, with ``fp`` and ``component_id`` (the smallest ``key`` reachable by links)."""
    marked = cut(with_fingerprints(docs, text, width), "simhash-fp")
    # a node of the graph is a distinct fingerprint, named by itself: no id is needed, and null ids do no harm
    nodes = cut(marked.groupBy("fp").agg(F.min(key).alias("__least")).withColumn("node", F.col("fp")), "simhash-nodes")
    found = cut(links(nodes.select("node", "fp"), radius).distinct(), "simhash-links")
    joined = components(found)  # node, component
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("__least").alias("component_id"))
    named = cut(named.join(least, "component").select("fp", "component_id"), "simhash-components")
    drop(nodes, found)
    return marked.join(named, "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

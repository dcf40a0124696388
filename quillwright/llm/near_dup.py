"""Near-duplicate classes by shingle similarity: wide SimHash fingerprints find pairs, the exact Jaccard index decides.

* a text's set: XXH64 of its shingles of ``WIDTH`` words (of all words, if there are fewer), repeats once; two texts are
  linked if their sets' Jaccard index is ``4 / 5`` or more; classes are the links' components;
* equal sets are folded first (a map-side combined aggregate), so a group of copies of any size costs one row;
* fingerprints: SimHash of the set with ``BITS`` bits, a bit is 1 if it is set in over half of the shingles' hashes. Sets at 0.8
  differ in 15 % of the bits (16 % where sets are small, 19 % for the smallest, of 4 and 5 shingles), others in half of them;
* candidates: fingerprints are compared bit-sliced, by carry-save counters (``simhash.within_wide``), on ``COMPARED`` bits with a radius of
  ``RADIUS``; those with a neighbour are compared again on all bits, with a radius of ``WHOLE``. A pair at 16 % is beyond one of them in
  6 of 10^6 cases, one at 19 % in 3 of 10^4; of unrelated ones one in 10^5 is within the first, and next to none within both;
* up to ``bucket`` fingerprints are all compared with each other. Of more, those meet that agree in the bits of a table's key; keys have
  as many bits as buckets of ``bucket`` ask for, and there are as many tables as miss a pair at 16 % with a chance of ``MISSED`` at most;
* a pair within both is judged on its whole sets, which are stored once, for texts that have such a neighbour only, in files of
  the shared folder that workers map; it is judged in the first table that it shares, and not if its texts are linked by then;
* buckets over ``tile`` rows are dealt out as pairs of tiles (no cap, no sampling); a bucket yields a spanning forest.

Texts without a word have the empty set, and are linked to each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Mapped, cut, drop, mix, new_folder, remove, write_file
from .components import components
from .simhash import planes_of, shingle_hashes, within_wide

WIDTH, BITS, WHOLE, COMPARED, RADIUS = 5, 256, 72, 128, 40
MISSED, DIFFERENT = 1e-4, 0.16
_WORDS, _SEEN = BITS // 64, COMPARED // 64
_SALTS = np.random.default_rng(42).integers(0, 1 << 64, _WORDS, np.uint64)
_WINDOW, _FILE_BYTES = 1 << 12, 32 << 20


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of sets of shingle hashes: a row of ``_WORDS`` words each."""
    n = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(n)), n)
    sums = np.zeros((len(n), BITS), np.int64)
    for lo in range(0, len(flat), _WINDOW):
        part, own = flat[lo : lo + _WINDOW], owner[lo : lo + _WINDOW]
        bits = np.unpackbits(mix(part[:, None] ^ _SALTS).view(np.uint8).ravel(), bitorder="little").reshape(-1, BITS)
        at = np.arange(len(own))
        start = np.concatenate(([True], own[1:] != own[:-1]))
        start |= (at - np.maximum.accumulate(np.where(start, at, 0))) % 255 == 0  # 255 rows of bytes can be summed eight at a time
        first = np.flatnonzero(start)
        eight = np.add.reduceat(bits.view(np.uint64), first, axis=0)
        np.add.at(sums, own[first], np.ascontiguousarray(eight).view(np.uint8))
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64)


def tables_for(count: int, bucket: int = 2048) -> np.ndarray:
    """Bits of each table's key, a row for a table: chosen so that ``count`` spread fingerprints make buckets of ``bucket`` or fewer."""
    width = 0
    while count > bucket << width:
        width += 1
    d = np.arange(BITS + 1)
    steps = np.log((BITS - d[:-1]) / (d[:-1] + 1)) + np.log(DIFFERENT / (1 - DIFFERENT))
    weight = np.exp(np.concatenate(([0.0], np.cumsum(steps))) + BITS * np.log(1 - DIFFERENT))  # of d different bits
    agree = np.prod([np.maximum(BITS - d - i, 0) / (BITS - i) for i in range(width)], axis=0) * np.ones(BITS + 1)
    tables = 1
    while (weight * (1 - agree) ** tables).sum() > MISSED:
        tables += 1
    rng, rows = np.random.default_rng(42), []
    while width and len(rows) < tables:  # keys of one permutation share no bit
        rows += [*rng.permutation(BITS)[: BITS // width * width].reshape(-1, width)]
    return np.array(rows[:tables] or np.empty((1, 0)), np.int64)


def keys_of(fps: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The key of each fingerprint in each table."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), BITS // 8), axis=1, bitorder="little")
    out = np.zeros((len(fps), len(tables)), np.int64)
    for column in tables.T:
        out = 2 * out + bits[:, column]
    return out


def neighbours(fps: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of some of ``left``, a boolean row of ``right`` for each): who is within the radius of whom (of both, if ``fps`` are whole); ``right`` is ``left`` if it is None."""
    other = left if right is None else right
    if not len(other):
        return
    planes = np.concatenate([planes_of(fps[other, w]) for w in range(fps.shape[1])])
    step = max(1, (1 << 14) // planes.shape[1])
    for lo in range(0, len(left), step):
        part = left[lo : lo + step]
        hits = within_wide(fps[part, :_SEEN], planes[:COMPARED], len(other), RADIUS)
        if fps.shape[1] == _WORDS:
            hits &= within_wide(fps[part], planes, len(other), WHOLE)
        hits = np.unpackbits(hits.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(other)].astype(bool)
        if right is None:
            hits[np.arange(len(part)), lo + np.arange(len(part))] = False
        yield part, hits


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard index of two sorted sets is 4 / 5 or more, in whole numbers."""
    n = len(x) + len(y)
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * n


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, node, fp); a node is a set, named by a hash of it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [shingle_set(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            fp = pa.array([f.tobytes() for f in fingerprints(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), fp], names=["row", "node", "fp"])


def _fps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _spread(tables: np.ndarray):
    """mapInArrow: (node, fp) -> (node, the part of fp that is compared, the keys in all tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = _fps(part.column(1))
                keys = pa.array(list(keys_of(fps, tables)), pa.list_(pa.int64()))
                seen = pa.array([f.tobytes() for f in fps[:, :_SEEN]], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), seen, keys], names=["node", "fp", "keys"])

    return run


def _store(folder: str):
    """mapInArrow over (node, fp, text): writes fingerprint and set of each node to files, gives their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, starts, sizes, parts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            file = uuid.uuid4().int >> 65
            write_file(f"{folder}/{file}.sets", *(p.tobytes() for p in parts))
            cols = [pa.array(nodes, pa.int64()), pa.array([file] * len(nodes), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["node", "file", "start", "size"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for node, fp, text in zip(part.column(0).to_pylist(), _fps(part.column(1)), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    found = shingle_set(text)
                    nodes.append(node)
                    starts.append(held)
                    sizes.append(len(found))
                    parts += [fp, found]
                    held += _WORDS + len(found)
                if held * 8 >= _FILE_BYTES:
                    yield flush()
                    nodes, starts, sizes, parts, held = [], [], [], [], 0
        if nodes:
            yield flush()

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by (t, key, pair) as tables of whole buckets, with the buckets' bounds; a bucket is a tile or two."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cuts(rows: pa.Table) -> np.ndarray:
        cols = [rows.column(c).to_numpy() for c in ("t", "key", "pair")]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1

    def whole(rows: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
        at = [0, *cuts(rows).tolist(), rows.num_rows]
        return rows, [(s, e) for s, e in zip(at, at[1:], strict=False) if e - s > 1]

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < 20_000:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        new = cuts(rows)
        if not len(new):
            continue
        last = int(new[-1])  # the last bucket may go on in the next batch
        yield whole(rows.slice(0, last).combine_chunks())
        held = rows.slice(last).to_batches()
        n = rows.num_rows - last
    if n:
        yield whole(pa.Table.from_batches(held).combine_chunks())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the rows of each bucket that have another one within the radius, without their fingerprints."""
    for rows, bounds in _buckets(batches):
        side = rows.column("side").to_numpy()
        met = np.zeros(rows.num_rows, bool)
        fps = np.concatenate([_fps(c) for c in rows.column("fp").chunks])
        for s, e in bounds:
            left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
            if not len(left):
                continue
            other = right if len(right) else left
            for part, hits in neighbours(fps, left, right if len(right) else None):
                met[part] |= hits.any(axis=1)
                met[other] |= hits.any(axis=0)
        yield from rows.drop_columns(["fp"]).filter(pa.array(met)).combine_chunks().to_batches()


def _links_in(t: int, keys: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of a bucket's links; between two tiles, or inside one if ``right`` is None."""
    label, out = np.arange(len(keys)), []
    sizes = np.array([len(s) for s in sets])
    within = left if right is None else right
    for part, hits in neighbours(fps, left, right):
        for i, hit in zip(part.tolist(), hits, strict=True):
            others = within[hit]
            if right is None:
                others = others[others < i]
            others = others[label[others] != label[i]]
            others = others[(5 * np.minimum(sizes[others], sizes[i]) >= 4 * np.maximum(sizes[others], sizes[i])) & ~(keys[others, :t] == keys[i, :t]).any(axis=1)]
            while len(others := others[label[others] != label[i]]):
                j, others = int(others[0]), others[1:]
                if similar(sets[i], sets[j]):
                    label[label == label[j]] = label[i]
                    out.append((i, j))
    return out


def _bucket_links(folder: str, tables: np.ndarray):
    """mapInArrow over rows sorted by (t, key, pair): node pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Mapped() as files:
            for rows, bounds in _buckets(batches):
                node, file, start, size, side, t = (rows.column(c).to_numpy() for c in ("node", "file", "start", "size", "side", "t"))
                a, b = [], []
                for s, e in bounds:
                    left, right = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
                    if not len(left):
                        continue
                    records = [files.array(f"{folder}/{f}.sets", np.uint64)[o : o + _WORDS + n] for f, o, n in zip(file[s:e].tolist(), start[s:e].tolist(), size[s:e].tolist(), strict=True)]
                    fps, sets = np.array([r[:_WORDS] for r in records]), [np.asarray(r[_WORDS:]) for r in records]
                    for i, j in _links_in(int(t[s]), keys_of(fps, tables), fps, sets, left, right if len(right) else None):
                        a.append(node[s + i])
                        b.append(node[s + j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("t"), F.col("key"), F.col("pair")).sortWithinPartitions("t", "key", "pair", "side")


def near_duplicates(docs: DataFrame, key: str = "row", text: str = "text", tile: int = 4096, bucket: int = 2048) -> DataFrame:
    """(key, class) of each row of ``docs``; ``key`` is a unique long, classes are named by one of their nodes."""
    spark = docs.sparkSession
    given = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))
    marked = cut(given.mapInArrow(_mark, "row bigint, node bigint, fp binary"), "near-marked")
    # a fingerprint follows from its node: any row's will do, and the text of the first row is the node's
    nodes = cut(marked.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp")), "near-nodes")
    tables = tables_for(nodes.count(), bucket)
    spread = nodes.select("node", "fp").mapInArrow(_spread(tables), "node bigint, fp binary, keys array<bigint>")
    spread = spread.select("node", "fp", F.posexplode("keys").alias("t", "key"))
    big = spread.groupBy("t", "key").count().filter(F.col("count") > tile)
    big = cut(big.select("t", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "near-big")
    rows = spread.join(big, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select("node", "fp", "t", "key", (low.cast("long") * F.col("tiles") + high).alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    schema = "node bigint, t int, key bigint, pair bigint, side int"
    maybe = cut(_by_bucket(rows).mapInArrow(_met, schema), "near-maybe")
    whole = maybe.join(nodes.select("node", "fp"), "node").select("node", "fp", "t", "key", "pair", "side")
    met = cut(_by_bucket(whole).mapInArrow(_met, schema), "near-met")
    texts = nodes.join(met.select("node").distinct(), "node", "left_semi").join(given, "row").select("node", "fp", "text")
    folder = new_folder(spark, "near-sets")
    places = cut(texts.mapInArrow(_store(folder), "node bigint, file bigint, start bigint, size bigint"), "near-places")
    links = cut(_by_bucket(met.join(places, "node")).mapInArrow(_bucket_links(folder, tables), "a bigint, b bigint").distinct(), "near-links")
    remove(folder)
    joined = components(links)
    drop(nodes, big, maybe, met, places, links)
    classes = marked.select("row", "node").join(joined, "node", "left")
    return classes.select(F.col("row").alias(key), F.coalesce("component", "node").alias("class"))

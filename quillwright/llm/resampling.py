"""Operator 11 — importance resampling towards a target distribution, with a dictionary of distinct features.

Features are all runs of 1 to 3 words. First pass: each task numbers the words of what it reads, counts the distinct runs of three words
(of fewer at a text's end) as numbers, 21 bits a word, and only then puts each one's string together, once a block of some million words. Blocks
send (strings, counts), compressed and in order, to a shard of the dictionary, dealt by a hash of the first two words; a run's count in a block is
one number, so that no n-gram is hot. A shard merges them to global counts of distinct strings, and as a run's count is part of those of its first two words
and its first word, they give the counts of all n-grams: those of two and three words are whole in a shard, single words are put together
by one more aggregate. Each distinct string is hashed once (CRC-32, modulo ``buckets``), and the counts are summed by bucket. The buckets'
totals give the gains, a table of ``buckets`` rows.

Second pass: gains are joined to the per-document feature counts by bucket. A document's n-grams find theirs without their strings: CRC-32 is
linear, so an n-gram's checksum comes from its words' checksums, each of which is computed once a batch (``shifts``). Joining by
the string itself would send every block's strings back to it (see the README for the figures).

The draw: scores are put in order by range partitions, and a row's place is its rank; nothing but partition sizes reaches the driver.

Memory: a task holds a block (``block_words`` words) or a batch of about 4 MB of text, or one longer text; a shard's size is a parameter.
Fixed size, sent to all tasks: the gains.

Defined results: null text — no words, no features, weight 0, but a score; a text of one word has one feature; an empty target gives every
feature the same law (t = T = 0); repeated rows are rows of their own (with one doc_id they share the noise), ties go to the smaller
doc_id, a null id comes last and counts as empty text in the noise's hash; empty table — an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, placed, release

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
BLOCK_WORDS, SHARD_BYTES, BATCH_BYTES = 4_000_000, 4 << 20, 4 << 20
BITS, PIECE = 21, 1 << 19
#: A-Z to lower case, ASCII letters and digits and all bytes beyond ASCII stay, the rest parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text) for parts of about BATCH_BYTES of text."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(sizes // BATCH_BYTES, prepend=0)) + 1
    bounds = np.unique([0, *cuts, len(texts)]).tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        yield lo, [words_of(t) for t in texts[lo:hi].to_pylist()]


# ---------------------------------------------------------------- first pass: the dictionary


class _Block:
    """Numbers of words and of distinct n-grams, until it is full."""

    def __init__(self, shards: int) -> None:
        self.shards, self.known, self.runs, self.own, self.size = shards, {}, [], [], 0

    def add(self, lists: list[list[bytes]], lent: int = 0) -> None:
        """Word numbers of the texts, a 0 after each: no n-gram crosses it. N-grams that begin in the last ``lent`` words aren't counted."""
        flat = [w for words in lists for w in [*words, b""]]
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        known = self.known
        ids = np.fromiter((known.setdefault(w, len(known) + 1) if w else 0 for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        self.runs.append(ids[coded.indices.to_numpy()])
        self.own.append(np.arange(len(flat)) < len(flat) - 1 - lent if lent else np.ones(len(flat), bool))
        self.size += len(flat)

    def distinct(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three words (of fewer at a text's end, then 0) as 21 bits each, in order, and their counts."""
        ids = np.concatenate([rank[np.concatenate(self.runs)], [0, 0]])
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        code = first << 2 * BITS | second << BITS | np.where(second > 0, third, 0)
        found, times = np.unique(code[(first > 0) & np.concatenate(self.own)], return_counts=True)
        return found, times.astype(np.uint32)

    def rows(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(shard, n, strings, counts): lengths and bytes of the shard's distinct runs, in order; runs with the same first two words share a shard."""
        vocab = pa.array(list(self.known), pa.binary())
        order = pc.sort_indices(vocab).to_numpy()
        rank = np.zeros(len(order) + 1, np.int64)
        rank[order + 1] = np.arange(1, len(order) + 1)
        vocab = pa.concat_arrays([pa.array([None], pa.binary()), vocab.take(pa.array(order))])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w or b"") for w in vocab.to_pylist()), np.uint64, len(vocab))
        codes, counts = self.distinct(rank)
        low = (1 << BITS) - 1
        mixed = (hashes[codes >> 2 * BITS] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes >> BITS & low]) * np.uint64(0xC2B2AE3D27D4EB4F)
        shard = (((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(self.shards)).astype(np.uint32)
        order = np.argsort(shard.astype(np.uint16) if self.shards <= 1 << 16 else shard, kind="stable")
        edges = [*np.flatnonzero(np.diff(shard[order].astype(np.int64), prepend=-1)).tolist(), len(order)]
        pack = zstandard.ZstdCompressor(level=1)
        for lo, hi in zip(edges, edges[1:], strict=False):
            code = codes[order[lo:hi]]
            parts = [vocab.take(pa.array(code >> BITS * (2 - k) & low)) for k in range(3)]
            text = pc.binary_join_element_wise(*parts, b" ", null_handling="skip")
            at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            yield int(shard[order[lo]]), hi - lo, pack.compress(np.diff(at).tobytes() + text.buffers()[2][at[0] : at[-1]].to_pybytes()), pack.compress(counts[order[lo:hi]].tobytes())


PART = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("strings", pa.binary()), ("counts", pa.binary())])


def _dictionary_parts(column: str, shards: int, block_words: int):
    """mapInArrow: texts -> PART rows."""

    def flush(block: _Block) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in block.rows() if block.known else ():
            held.append(row)
            size += len(row[2])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([dict(zip(PART.names, r, strict=True)) for r in held], PART)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(PART.names, r, strict=True)) for r in held], PART)

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[bytes]], int]]:
        """Texts with little over 2 * PIECE words, or a part of a longer one with the two words after it, which are lent."""
        for batch in batches:
            for _, lists in _batches(batch, column):
                held, size = [], 0
                for words in lists:
                    while len(words) > PIECE + 2:
                        yield [words[: PIECE + 2]], 2
                        words = words[PIECE:]
                    held.append(words)
                    size += len(held[-1])
                    if size > PIECE:
                        yield held, 0
                        held, size = [], 0
                yield held, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(shards)
        for lists, lent in portions(batches):
            block.add(lists, lent)
            if block.size >= block_words or len(block.known) > (1 << BITS) - 2 * PIECE - 8:  # the next portion's words must fit
                yield from flush(block)
                block = _Block(shards)
        yield from flush(block)

    return run


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _strings(n: list[int], blobs: list[bytes]) -> pa.Array:
    """The strings of several blocks."""
    raw = [np.frombuffer(zstandard.decompress(b), np.uint8) for b in blobs]
    lengths = np.concatenate([x[: 4 * k].view(np.int32) for x, k in zip(raw, n, strict=True)])
    return _binary(np.concatenate(([0], np.cumsum(lengths))), np.concatenate([x[4 * k :] for x, k in zip(raw, n, strict=True)]))


def _summed(strings: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings and their counts."""
    coded = strings.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), weights=counts, minlength=len(coded.dictionary)).astype(np.int64)


def _prefixes(strings: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """How many words each string has (1 to 3), and the first words and the first two words of those that have them."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8)
    spaces = np.append(np.flatnonzero(data[: offsets[-1]] == 32), len(data))
    at = np.searchsorted(spaces, offsets[:-1])
    words = 1 + np.searchsorted(spaces, offsets[1:]) - at
    out = []
    for n in (1, 2):
        some = words >= n
        begin, end = offsets[:-1][some], np.where(words > n, spaces[np.minimum(at + n - 1, len(spaces) - 1)], offsets[1:])[some]
        length = end - begin
        where = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        out.append(_binary(np.concatenate(([0], np.cumsum(length))), data[where]))
    return words, out


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Occurrences of n-grams in all of ``docs`` for each bucket, through the dictionary of distinct n-grams."""
    parts = docs.select(text).mapInArrow(_dictionary_parts(text, pieces(docs, shard_bytes), block_words), "shard bigint, n bigint, strings binary, counts binary")

    def merge(table: pa.Table) -> pa.Table:
        """A shard's n-grams of two and three words are whole here: hashed once each, summed by bucket. Of single words it has a part, given as it is."""
        n, strings, counts = (table.column(c).to_pylist() for c in ("n", "strings", "counts"))
        found, times = _summed(_strings(n, strings), np.concatenate([np.frombuffer(zstandard.decompress(c), np.uint32) for c in counts]))
        words, (one, two) = _prefixes(found)
        sums = np.zeros(buckets, np.int64)
        for grams, t in ((found.filter(pa.array(words == 3)), times[words == 3]), _summed(two, times[words >= 2])):
            for lo in range(0, len(grams), 100_000):
                part = grams[lo : lo + 100_000].to_pylist()
                bucket = np.fromiter(map(zlib.crc32, part), np.uint32, len(part)) % buckets
                sums += np.bincount(bucket, weights=t[lo : lo + 100_000], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(sums)
        single, t = _summed(one, times)
        none = pa.nulls(len(single), pa.int64()), pa.nulls(len(some), pa.binary())
        return pa.table({"bucket": pa.concat_arrays([pa.array(some), none[0]]), "word": pa.concat_arrays([none[1], single]), "times": pa.array(np.concatenate((sums[some], t)))})

    sums = parts.groupBy("shard").applyInArrow(merge, "bucket bigint, word binary, times bigint").groupBy("bucket", "word").agg(F.sum("times").alias("times"))
    bucket = F.coalesce("bucket", F.crc32("word") % buckets)  # single words, each once
    out = np.zeros(buckets, np.int64)
    for r in sums.groupBy(bucket.alias("bucket")).agg(F.sum("times").alias("times")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["times"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the target's and the source's bucket laws, each smoothed by one."""
    size, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


# ---------------------------------------------------------------- second pass: weights


@functools.lru_cache(maxsize=4096)
def shifts(length: int) -> np.ndarray:
    """Four tables of 256 that take the CRC-32 of A to that of A and ``length`` zero bytes, but for what the zeros alone give.

    zlib's CRC-32 is affine in its start value over GF(2), so 32 start values give the whole map.
    """
    zeros = bytes(length)
    alone = zlib.crc32(zeros, 0)
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for k in range(4):
        for bit in range(8):
            out[k, values >> bit & 1 == 1] ^= np.uint32(zlib.crc32(zeros, 1 << 8 * k + bit) ^ alone)
    return out


def ngram_checksums(lists: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """CRC-32 of the runs of 1, 2 and 3 words that begin at each position, which of them exist, and where each text begins. After each text comes a position without a word."""
    flat = [w for words in lists for w in [*words, b""]]
    starts = np.cumsum([0, *(len(words) + 1 for words in lists)])[:-1]
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    after = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    lengths, which = np.unique([len(w) + 1 for w in words], return_inverse=True)
    tables = np.stack([shifts(n) for n in lengths.tolist()])
    real = np.array([bool(w) for w in words])[ids]
    sums, there = [crc[ids]], [real]
    for n in (1, 2):
        c, w = sums[-1][:-1], ids[n:]
        t = which[w]
        sums.append(tables[t, 0, c & 255] ^ tables[t, 1, c >> 8 & 255] ^ tables[t, 2, c >> 16 & 255] ^ tables[t, 3, c >> 24] ^ after[w])
        there.append(there[-1][:-1] & real[n:])
    return sums, there, starts


def weigh(docs: DataFrame, gains: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over each document's features."""
    buckets, kind = len(gains), docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, lists in _batches(batch, text):
                sums, there, starts = ngram_checksums(lists)
                each = np.zeros(len(sums[0]), np.int64)
                for c, ok in zip(sums, there, strict=True):
                    each[: len(c)] += np.where(ok, gains[c % np.uint32(buckets)], 0)
                n = np.array([len(words) for words in lists], np.int64)
                columns = [batch.column(batch.schema.get_field_index(id_column))[lo : lo + len(lists)], pa.array(n), pa.array(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)), pa.array(np.add.reduceat(each, starts))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(id_column, text).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all ``docs``; ``rank`` numbers the ``percent`` per cent of long enough ones with the highest scores."""
    gains = gains_of(bucket_totals(docs, text, buckets), bucket_totals(target, text, buckets))
    release(docs.sparkSession)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = weigh(docs, gains, id_column, text).withColumn("score", (F.col("weight") + gumbel).cast("bigint")).withColumn("short", F.col("n_words") < least_words)
    scored = cut(scored, "scored")  # ranges are found by a sample first: texts are read once all the same
    rows = placed(scored, ["short", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"], "resampled")
    drawn = percent * rows.filter("NOT short").count() // 100
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns) for name, columns in (("documents", ["doc_id", "text"]), ("benchmark", ["text"])))
    return resample(docs, target)

"""Operator 2 — language-model scoring with an interpolated, modified Kneser-Ney trigram model.

Passes, all distributed and all over whole texts:

1. unigrams of the training texts are counted into sorted hash arrays (``ShardedCounts``); the rank of a word's hash is
   the word's dense id, exact and half as wide as the hash;
2. trigrams (u, v, w) of ids are counted and dealt out by their middle word v, so that one shard has both all words w that
   follow (u, v) and all words u that stand before (v, w). It stores the sorted arrays of its contexts and trigrams, and the
   continuation counts of its bigrams (v, w): of how many u there are. Middle words heavier than a quarter of a shard are dealt out
   by (u, v) instead; their bigrams' partial continuation counts meet once more, by the bigram;
3. partial statistics of contexts v (sum, N1, N2, N3+) and continuation counts of words are summed into dense arrays,
   indexed by word id;
4. workers map these files and score texts: each batch's contexts and bigrams are looked up once, its trigrams inside their contexts.

A text's first token has the start symbol before it; bigrams with the start symbol, before which nothing can stand, have plain counts.
The model's files live in the shared folder while texts are scored, and are removed then; a missing file is an error. Nothing that
grows with the corpus is collected or broadcast: the driver gets shard sizes, counts of counts and a bounded list of the heaviest
words.

Defined results: null or empty text — the end token alone is scored; no training text — every probability is 1/(V+1);
null ``doc_id`` — the training rule sees an empty id. Ties and repeated rows have no special role; extra columns of the
input are kept, but for those named like a result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Mapped, ShardedCounts, WordHashes, count_hashes, cut, field, free, id_text, mix, new_folder, ordered, pieces, ranges, release, remove, unique_sum, without, words_of, write_file

END = xxhash.xxh64_intdigest(b" end")  # white space keeps it apart from every word
SCORES = ("n_tokens", "n_known", "base_score", "score")
SCORE_SCHEMA = "n_tokens bigint, n_known bigint, base_score double, score double"
_BLOCK_BITS = 20
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_WIDE = 64  # contexts with more followers have their statistics stored


def _token_hashes():
    memo = WordHashes()

    def extract(texts: list) -> np.ndarray:
        words = []
        for t in texts:
            words += words_of(t)
        return np.concatenate([memo.of(words), np.full(len(texts), END, np.uint64)])

    return extract


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the counts of counts n1..n4; 0.5, 1, 1.5 where a count of counts is missing."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), 0, [0, 1, 2, 3])


class KneserNey:
    """A fitted model: where its arrays are, and its scalars. Small; it is sent to the workers."""

    def __init__(self, vocab: ShardedCounts, folder: str, shards: int, salted: np.ndarray, there: dict[str, set[int]], d: list[np.ndarray], types: int, words: np.ndarray) -> None:
        self.vocab, self.folder, self.shards, self.salted, self.there, self.types = vocab, folder, shards, salted, there, types
        self.d1, self.d2, self.d3 = d
        #: the share of the unigram level's mass that its discounts set free; words: how many have N1+ of 1, 2, 3 or more
        self.lambda1 = float(self.d1[1:] @ words) / types if types else 1.0

    def remove(self) -> None:
        remove(self.vocab.folder)
        remove(self.folder)


def _sequences(texts: list, memo: WordHashes, vocab: ShardedCounts, maps: Mapped) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids and counts of all texts, each ended by the end token, and the texts' numbers of tokens."""
    words, lengths = [], []
    for t in texts:
        w = words_of(t)
        words += w
        lengths.append(len(w) + 1)
    n = np.array(lengths, dtype=np.int64)
    ends = np.cumsum(n) - 1
    hashes = np.full(int(n.sum()), END, np.uint64)
    inside = np.ones(len(hashes), bool)
    inside[ends] = False
    hashes[inside] = memo.of(words)
    distinct, back = ordered(hashes)
    ids, counts = vocab.find(maps, distinct)
    return ids[back], counts[back], n


def _before(ids: np.ndarray, n: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The two ids before each token: at a text's first token none (start + 1) and the start symbol."""
    v, u, first = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint64), np.cumsum(n) - n
    v[1:], u[2:] = ids[:-1], ids[:-2]
    second = first[n > 1] + 1
    v[first], u[first], u[second] = start, start + 1, start
    return u, v


def _shard_of(v: np.ndarray, other: np.ndarray, shards: int, salted: np.ndarray) -> np.ndarray:
    """By the middle word, but for salted ones by the pair with ``other``."""
    return _few(mix(np.where(np.isin(v, salted), (v << _HALF) | other, v)) % np.uint64(shards), shards)


def _few(shard: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers in 16 bits where these do: such numbers are sorted by radix."""
    return shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)


def _distinct(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (64-bit, 32-bit) pairs in order, and the sums of their counts (or their numbers)."""
    found, at = ordered(high)
    keys = (at.astype(np.uint64) << _HALF) | low
    keys, counts = np.unique(keys, return_counts=True) if counts is None else unique_sum(keys, counts)
    return found[(keys >> _HALF).astype(np.int64)], keys & _LOW, counts


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def fit(docs: DataFrame, text: str = "text", *, shard_bytes: int = 8 << 20) -> KneserNey:
    """Fit the model on every text of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"))
    vocab = count_hashes(docs, "text", _token_hashes, "lm-words")
    release(spark)
    v, start = vocab.distinct, vocab.distinct + 1
    if v >= 2**32 - 3:
        raise ValueError("more than 2^32 - 4 distinct words: ids no longer fit 32 bits")
    folder, shards = new_folder(spark, "lm-trigrams"), pieces(docs, shard_bytes)
    salted = np.array(sorted({start} | {i for i, c in vocab.heavy.items() if c > vocab.total / (4 * shards)}), dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = WordHashes(), [], 0

        def emit() -> pa.RecordBatch:
            high, w, counts = _distinct(np.concatenate([h for h, _ in held]), np.concatenate([x for _, x in held]))
            u, v = high & _LOW, high >> _HALF
            shard = _shard_of(v, np.where(v == start, w, u), shards, salted)
            order = np.argsort(shard, kind="stable")
            high, w, counts, shard = high[order], w[order], counts[order], shard[order]
            at = [*_runs(shard).tolist(), len(high)]
            rows = list(zip(at, at[1:], strict=False))
            return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in rows], pa.int32()), pa.array([_pack(high[a:b], w[a:b], counts[a:b]) for a, b in rows], pa.binary())], names=["shard", "rows"])

        with Mapped() as maps:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    ids, _, lengths = _sequences(batch.column(0).cast(pa.binary()).slice(lo, 256).to_pylist(), memo, vocab, maps)
                    u, v = _before(ids, lengths, start)
                    held.append(((v << _HALF) | u, ids.astype(np.uint64)))
                    n += len(ids)
                    if n >= 3_000_000:
                        yield emit()
                        held, n = [], 0
            if n:
                yield emit()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        high, w, counts = _distinct(*(np.concatenate(x) for x in zip(*(_unpack(x) for x in table.column("rows").to_pylist()), strict=True)))
        plain = high == (np.uint64(start) << _HALF | np.uint64(start + 1))
        rows: list[tuple] = []
        if plain.any():
            rows += _parts((high[plain] & ~_LOW) | w[plain], counts[plain], shards)
            high, w, counts = high[~plain], w[~plain], counts[~plain]
        pair, seen = np.unique((high & ~_LOW) | w, return_counts=True)
        heavy = np.isin(pair >> _HALF, salted)
        rows += _parts(pair[heavy], seen[heavy].astype(np.uint64), shards)
        pair, seen = pair[~heavy], seen[~heavy].astype(np.uint64)
        rows += _statistics(pair, seen) + [(-1, 3, _of_counts(counts))]
        _write(f"{folder}/tri-{s:06d}", high, w, counts)
        _write(f"{folder}/bi-{s:06d}", pair >> _HALF, pair & _LOW, seen)
        return _table([*rows, (-1, 5, np.array([s], np.int64).tobytes())])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        parts = [_expand(x) for x in table.column("vals").to_pylist()]
        pair = np.concatenate([(np.cumsum(v, dtype=np.uint32).astype(np.uint64) << _HALF) | w for v, w, _ in parts])
        pair, seen = unique_sum(pair, np.concatenate([n for *_, n in parts]).astype(np.uint64))
        _write(f"{folder}/met-{s:06d}", pair >> _HALF, pair & _LOW, seen)
        return _table([*_statistics(pair, seen), (-1, 6, np.array([s], np.int64).tobytes())])

    schema = "block int, kind int, vals binary"
    parts = cut(docs.mapInArrow(count, "shard int, rows binary").groupBy("shard").applyInArrow(merge, schema), "lm-parts")
    release(spark)
    late = cut(parts.filter("kind = 2").groupBy("block").applyInArrow(meet, schema), "lm-late")
    parts = parts.filter("kind <> 2").unionByName(late)

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        size = 1 << _BLOCK_BITS
        contexts, seen = np.zeros((size, 4), np.int64), np.zeros(size, np.int64)
        for kind, vals in zip(table.column("kind").to_pylist(), table.column("vals").to_pylist(), strict=True):
            at, *x = _expand(vals)
            at = np.cumsum(at, dtype=np.uint32)
            if kind == 0:
                contexts[at] += np.stack(x, axis=1)
            else:
                seen[at] += x[0]
        write_file(f"{folder}/contexts-{b:06d}", contexts.tobytes())
        write_file(f"{folder}/seen-{b:06d}", seen.tobytes())
        return pa.table({"block": pa.array([b], pa.int32()), "n": pa.array([np.array([*((seen == k).sum() for k in (1, 2, 3, 4)), (seen >= 3).sum()], np.int64).tolist()], pa.list_(pa.int64()))})

    n2, n3, there = np.zeros(5, np.int64), np.zeros(5, np.int64), {"tri": set(), "met": set(), "block": set()}
    for r in parts.filter("block = -1").select("kind", "vals").toLocalIterator():
        x = np.frombuffer(r["vals"], np.int64)
        if r["kind"] in (3, 4):
            (n3 if r["kind"] == 3 else n2)[:] += x
        else:
            there["tri" if r["kind"] == 5 else "met"].add(int(x[0]))
    n1 = np.zeros(5, np.int64)
    for r in parts.filter("block >= 0").groupBy("block").applyInArrow(dense, "block int, n array<bigint>").collect():
        n1 += np.array(r["n"])
        there["block"].add(r["block"])
    release(spark)
    there["bi"] = there["tri"]
    return KneserNey(vocab, folder, shards, salted, there, [discounts(n[:4]) for n in (n1, n2, n3)], int(n2[4]), n1[[0, 1, 4]])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "vals": pa.array([r[2] for r in rows], pa.binary())})


def _of_counts(counts: np.ndarray) -> bytes:
    return np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), len(counts)], np.int64).tobytes()


def _parts(pair: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """Bigrams whose counts are in several shards, by the shard where they meet."""
    shard = _few(mix(pair) % np.uint64(shards), shards)
    order = np.argsort(shard, kind="stable")
    at = [*_runs(shard[order]).tolist(), len(pair)]
    rows = [(int(shard[order[a]]), order[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return [(s, 2, _squeeze(np.diff((pair[o] >> _HALF).astype(np.uint32), prepend=np.uint32(0)), pair[o] & _LOW, counts[o])) for s, o in rows]


def _statistics(pair: np.ndarray, seen: np.ndarray) -> list[tuple]:
    """Of bigrams in order: their contexts' sums and N1, N2, N3+, how many there are of each second word, counts of counts."""
    context = (pair >> _HALF).astype(np.int64)
    first = _runs(context)
    stats = np.stack([np.add.reduceat(x, first) for x in _levels(seen)], axis=1) if len(first) else np.empty((0, 4), np.int64)
    word, many = np.unique((pair & _LOW).astype(np.int64), return_counts=True)
    return [*_by_block(context[first], stats, 0), *_by_block(word, many.astype(np.int64)[:, None], 1), (-1, 4, _of_counts(seen))]


def _levels(counts: np.ndarray) -> list[np.ndarray]:
    return [counts.astype(np.int64), (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64)]


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, byte planes apart, compressed."""
    raw = b"".join(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays)
    return np.array([len(arrays), *map(len, arrays)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8).tolist()
    raw, at, out = pa.decompress(blob[8 + 8 * n :], 4 * sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b"", 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, -1).T).view(np.uint32)[:, 0] if size else np.empty(0, np.uint32))
        at += 4 * size
    return out


def _pack(high: np.ndarray, w: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted trigrams: differences of the contexts' ids, followers of each context, words, counts (of 2^32 - 1 at most: one task's)."""
    first = _runs(high)
    ids = [(high[first] >> _HALF).astype(np.uint32), (high[first] & _LOW).astype(np.uint32)]
    return _squeeze(*(np.diff(x, prepend=np.uint32(0)) for x in ids), np.diff(np.append(first, len(high))), w, counts)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, u, n, w, counts = _expand(blob)
    v, u = (np.cumsum(x, dtype=np.uint32).astype(np.uint64) for x in (v, u))
    return np.repeat((v << _HALF) | u, n), w.astype(np.uint64), counts.astype(np.uint64)


#: What a file of contexts holds: contexts, where each one's words start, words, counts (255: see ``over``); places of counts
#: over 254 and the counts; contexts with many words and their statistics.
_FIELDS = (("context", np.uint64), ("first", np.uint32), ("word", np.uint32), ("count", np.uint8), ("over_at", np.uint32), ("over", np.uint64), ("wide", np.uint32), ("wide_stats", np.int64))


def _write(path: str, high: np.ndarray, w: np.ndarray, counts: np.ndarray) -> None:
    """A file of sorted (context, word, count); a context is a 64-bit pair, or one word."""
    if len(high) >= 1 << 32:
        raise ValueError("a shard of 2^32 or more entries: fit with a smaller shard_bytes")
    first = _runs(high)
    ends = np.append(first, len(high))
    over = np.flatnonzero(counts >= 255)
    wide = np.flatnonzero(np.diff(ends) > _WIDE)
    at = ranges(ends[wide], np.diff(ends)[wide])
    cuts = np.cumsum(np.diff(ends)[wide]) - np.diff(ends)[wide]
    stats = np.stack([np.add.reduceat(x, cuts) for x in _levels(counts[at])], axis=1) if len(wide) else np.empty((0, 4), np.int64)
    values = (high[first], ends, w, np.minimum(counts, 255), over, counts[over], wide, stats.ravel())
    arrays = [np.ascontiguousarray(x).astype(kind) for x, (_, kind) in zip(values, _FIELDS, strict=True)]
    write_file(path, np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays))


def _search(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in its own sorted range of ``values``, or -1; all ranges are halved together."""
    out = np.full(len(x), -1, np.int64)
    alive = np.flatnonzero(lo < hi)
    lo, hi, x = lo[alive].astype(np.int64), hi[alive].astype(np.int64), x[alive]
    while len(alive):
        mid = (lo + hi) >> 1
        got = values[mid]
        same, less = got == x, got < x
        out[alive[same]] = mid[same]
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        on = ~same & (lo < hi)
        alive, lo, hi, x = alive[on], lo[on], hi[on], x[on]
    return out


class _Contexts:
    """A file that ``_write`` has made, mapped."""

    def __init__(self, maps: Mapped, path: str) -> None:
        raw = maps.array(path, np.uint8)
        at = 8 * len(_FIELDS)
        for (name, kind), n in zip(_FIELDS, raw[:at].view(np.int64).tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, start, end): of sorted contexts and their words; place -1 and an empty range where there is none."""
        if not len(self.context):
            return np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        found = self.context[at] == context
        start, end = np.where(found, self.first[at], 0).astype(np.int64), np.where(found, self.first[at + 1], 0).astype(np.int64)
        return np.where(found, at, -1), start, end

    def counts(self, at: np.ndarray) -> np.ndarray:
        """Counts at places; 0 at place -1."""
        out = np.where(at >= 0, self.count[np.maximum(at, 0)], 0).astype(np.int64) if len(self.count) else np.zeros(len(at), np.int64)
        more = np.flatnonzero(out == 255)
        if len(more):
            out[more] = self.over[np.searchsorted(self.over_at, at[more].astype(np.uint32))]
        return out

    def statistics(self, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum, N1, N2, N3+ of contexts; zeros where there is none."""
        out, n = np.zeros((len(at), 4), np.int64), end - start
        some = np.flatnonzero((n > 0) & (n <= _WIDE))
        if len(some):
            counts = self.counts(ranges(start[some], n[some]))
            cuts = np.cumsum(n[some]) - n[some]
            out[some] = np.stack([np.add.reduceat(x, cuts) for x in _levels(counts)], axis=1)
        wide = np.flatnonzero(n > _WIDE)
        if len(wide):
            out[wide] = self.wide_stats.reshape(-1, 4)[np.searchsorted(self.wide, at[wide].astype(np.uint32))]
        return out


def _by_block(ids: np.ndarray, values: np.ndarray, kind: int) -> list[tuple]:
    """Rows of (block, kind, places in the block and values); a shard's values fit 32 bits, their sums need not."""
    block = ids >> _BLOCK_BITS
    at = [*_runs(block).tolist(), len(ids)]
    low = (ids & ((1 << _BLOCK_BITS) - 1)).astype(np.uint32)
    return [(int(block[a]), kind, _squeeze(np.diff(low[a:b], prepend=np.uint32(0)), *values[a:b].T)) for a, b in zip(at, at[1:], strict=False)]


class _Arrays:
    """The model's files, read through memory maps."""

    def __init__(self, model: KneserNey, maps: Mapped) -> None:
        self.m, self.maps = model, maps

    def dense(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of a dense array for sorted ids; zeros in blocks without any entry."""
        out = np.zeros((len(ids), width), np.int64)
        block = ids >> _BLOCK_BITS
        at = [*_runs(block).tolist(), len(ids)]
        for a, b in zip(at, at[1:], strict=False):
            if int(block[a]) in self.m.there["block"]:
                x = self.maps.array(f"{self.m.folder}/{name}-{int(block[a]):06d}", np.int64)
                out[a:b] = x.reshape(-1, width)[ids[a:b] - (int(block[a]) << _BLOCK_BITS)]
        return out

    def by_shard(self, name: str, shard: np.ndarray) -> Iterator[tuple[np.ndarray, _Contexts]]:
        """(places, file) of each shard that has one."""
        order = np.argsort(shard, kind="stable")
        at = [*_runs(shard[order]).tolist(), len(shard)]
        for a, b in zip(at, at[1:], strict=False):
            s = int(shard[order[a]])
            if s in self.m.there[name]:
                yield order[a:b], _Contexts(self.maps, f"{self.m.folder}/{name}-{s:06d}")  # views only: what ``maps`` lets go is free

    def continuations(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Continuation counts of bigrams."""
        m, out, none = self.m, np.zeros(len(v), np.int64), np.zeros(len(v), np.uint64)
        heavy = np.isin(v, m.salted)
        meet = _few(mix((v << _HALF) | w) % np.uint64(m.shards), m.shards)
        for name, rows, shard in (("bi", np.flatnonzero(~heavy), _shard_of(v, none, m.shards, none[:0])), ("met", np.flatnonzero(heavy), meet)):
            for at, file in self.by_shard(name, shard[rows]):
                at = rows[at]
                _, start, end = file.find(v[at])
                out[at] = file.counts(_search(file.word, start, end, w[at]))
        return out

    def trigrams(self, context: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Statistics of distinct contexts, and counts of tokens whose contexts are ``context[at]``."""
        m = self.m
        shard = _shard_of(context >> _HALF, context & _LOW, m.shards, m.salted)
        stats, counts, place = np.zeros((len(context), 4), np.int64), np.zeros(len(w), np.int64), np.empty(len(context), np.int64)
        dealt = shard[at]
        tokens = np.argsort(dealt, kind="stable")
        dealt = dealt[tokens]
        for rows, file in self.by_shard("tri", shard):
            found, start, end = file.find(context[rows])
            stats[rows] = file.statistics(found, start, end)
            place[rows] = np.arange(len(rows))
            mine = tokens[slice(*(np.searchsorted(dealt, shard[rows[0]]), np.searchsorted(dealt, shard[rows[0]], "right")))]
            p = place[at[mine]]
            counts[mine] = file.counts(_search(file.word, start[p], end[p], w[mine]))
        return stats, counts


def score_texts(model: KneserNey, texts: list, memo: WordHashes, maps: Mapped, arrays: _Arrays | None = None) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    vocab, arrays = model.vocab, arrays or _Arrays(model, maps)
    ids, counts, n = _sequences(texts, memo, vocab, maps)
    first = np.cumsum(n) - n
    v, total = vocab.distinct, vocab.total
    base = np.log10((counts + 1.0) / (total + 1.0 * (v + 1)))
    words = np.unique(ids)
    seen = arrays.dense("seen", words, 1)[:, 0]
    # mass that the unigram level's discounts set free, spread over the vocabulary and the unknown word
    p1 = np.maximum(seen - model.d1[np.minimum(seen, 3)], 0) / max(1, model.types) + model.lambda1 / (v + 1)
    two, one = _before(ids, n, v + 1)
    w = ids.astype(np.uint64)
    # bigrams
    pairs, code = ordered((one << _HALF) | w)
    context, word = pairs >> _HALF, pairs & _LOW
    left, left_at = np.unique(context.astype(np.int64), return_inverse=True)
    stats = arrays.dense("contexts", left, 4)[left_at]
    low = p1[np.searchsorted(words, word.astype(np.int64))]
    p2 = np.where(stats[:, 0] > 0, _interpolated(arrays.continuations(context, word), stats, model.d2, low), low)[code]
    # trigrams; a text's first token has no context of two
    contexts, at = ordered((one << _HALF) | two)
    stats, c = arrays.trigrams(contexts, at, w)
    stats = stats[at]
    p = np.where(stats[:, 0] > 0, _interpolated(c, stats, model.d3, p2), p2)
    return {"n_tokens": n, "n_known": np.add.reduceat((counts > 0).astype(np.int64), first), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first)}


def _interpolated(c: np.ndarray, stats: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
    held = np.maximum(stats[:, 0], 1)
    return np.maximum(c - d[np.minimum(c, 3)], 0) / held + (stats[:, 1:] @ d[1:]) / held * low


def score(docs: DataFrame, train: Column, text: str = "text", **options) -> DataFrame:
    """Fit on the rows where ``train`` holds and score all rows; returns ``docs``' columns (without the text) and scores."""
    spark = docs.sparkSession
    model = fit(docs.filter(train), text, **options)
    names, own = without(docs.columns, text, *SCORES, "train_tokens"), free(docs.columns, "bytes")
    given = docs.select(*names, F.col(text).cast("binary").alias(own))
    fields = "".join(f"{field(f)}, " for f in given.schema if f.name != own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        with Mapped() as maps:
            arrays = _Arrays(model, maps)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    got = score_texts(model, part.column(len(names)).to_pylist(), memo, maps, arrays)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *(pa.array(x) for x in got.values())], names=[*names, *got])

    out = given.mapInArrow(run, f"{fields}{SCORE_SCHEMA}").withColumn("train_tokens", F.lit(model.vocab.total).cast("bigint"))
    out = cut(out, "lm-scores")
    model.remove()
    return out


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.crc32(id_text()) % 7 == 2).alias("held_out"))
    return score(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

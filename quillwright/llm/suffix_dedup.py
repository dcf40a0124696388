"""Operator 4 — repeated passages by a sparse suffix array.

A passage is repeated if a window of ``MIN_WORDS`` words of it (A-Z lower-cased, white space aside) occurs in another
document; the result is exact for this definition.

* Suffixes are retained at minimiser positions: of each ``WINDOW`` neighbouring word 8-grams the one with the least hash.
  Every window of MIN_WORDS words holds such a position among its first WINDOW words, so a retained suffix shares at
  least PREFIX = MIN_WORDS - WINDOW + 1 words with its like in any document that has the window.
* A first pass counts the suffixes' PREFIX-word hashes in sorted arrays; only suffixes whose prefix occurs again are kept.
* These are dealt out by their prefix, sorted, and neighbours compared: suffixes that share PREFIX + j words are a run of
  neighbours with no lower common prefix. Then matches are extended to the left: inside a run, suffixes with the same
  l = WINDOW - 1 - j words before them share a window of MIN_WORDS words.
* A prefix that occurs very often (a copied text, a common passage) is dealt over several parts by document. Their
  windows meet once more by a hash of the whole window, of which each part sends one document at most: nothing is capped, and no group, however large, is one task's work.
* Windows that overlap are joined into a document's maximal repeated passages.

Result: one row for each document that has a repeated passage; ``partners`` are ids of documents that share one with it (the
least id of each class, or the second for the least itself), enough to connect all documents with a common passage.

Defined results: null, empty or short texts — no row; equal texts of MIN_WORDS words or more — repeated as a whole;
repetition inside one document alone — none; repeated rows — documents of their own; null ``doc_id`` — takes part, is
no partner; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Mapped, ShardedCounts, WordHashes, count_hashes, cut, mix, ranges, remove, words_of

MIN_WORDS, WINDOW, GRAM = 50, 8, 8
PREFIX = MIN_WORDS - WINDOW + 1
PART = 2048  # rows of one prefix in a part, about
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashed words of several texts, one after another; texts under MIN_WORDS words are left out."""

    def __init__(self, texts: list, memo: WordHashes) -> None:
        words, kept, n = [], [], []
        for i, t in enumerate(texts):
            w = words_of(t)
            if len(w) >= MIN_WORDS:
                words += w
                kept.append(i)
                n.append(len(w))
        self.kept, self.n = np.array(kept, np.int64), np.array(n, np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.h = memo.of(words)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.h * _powers(_BASE, len(self.h)))))
        self.back = _powers(_INVERSE, len(self.h) + 1)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of ``size`` words from each position."""
        return mix((self.sums[at + size] - self.sums[at]) * self.back[at])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Minimiser positions that have PREFIX words from them on, and each one's text."""
        if not len(self.n):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        grams = self.windows(np.arange(max(0, len(self.h) - GRAM + 1)), GRAM)
        last = len(grams) - WINDOW + 1
        best, at = grams[:last].copy(), np.arange(last)
        for j in range(1, WINDOW):
            other = grams[j : j + last]
            less = other < best
            best[less] = other[less]
            at[less] = np.flatnonzero(less) + j
        # windows inside one text
        starts = ranges(self.first, self.n - (WINDOW + GRAM - 2))
        at = np.unique(at[starts])
        own = np.searchsorted(self.first, at, side="right") - 1
        whole = at + PREFIX <= (self.first + self.n)[own]
        return at[whole], own[whole]


def _prefixes() -> Callable[[list], np.ndarray]:
    memo = WordHashes()

    def extract(texts: list) -> np.ndarray:
        words = Words(texts, memo)
        return words.windows(words.anchors()[0], PREFIX)

    return extract


_EXTRA = WINDOW - 1  # words after the prefix and before the suffix that may belong to a window
_ROW = "prefix bigint, part int, around binary, doc bigint, doc_id bigint, pos int, n_words int"


def _suffixes(repeated: ShardedCounts, part_rows: int) -> Callable:
    """mapInArrow: (doc, doc_id, text) -> a row for each retained suffix whose prefix occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        with Mapped() as maps:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    words = Words(part.column(2).cast(pa.binary()).to_pylist(), memo)
                    at, own = words.anchors()
                    prefix = words.windows(at, PREFIX)
                    distinct, back = np.unique(prefix, return_inverse=True)
                    counts = repeated.find(maps, distinct)[1][back]
                    hit = counts > 0
                    at, own, prefix, counts = at[hit], own[hit], prefix[hit], counts[hit]
                    if not len(at):
                        continue
                    short = np.concatenate((words.h, np.zeros(MIN_WORDS, np.uint64))).astype(np.uint32)
                    around = np.stack([short[at + PREFIX + j] for j in range(_EXTRA)] + [short[at - 1 - j] for j in range(_EXTRA)], axis=1)
                    doc = part.column(0).to_numpy()[words.kept[own]]
                    parts = 1 + counts // part_rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(prefix.view(np.int64)),
                            pa.array((mix(doc.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32) + np.where(parts > 1, 1, 0).astype(np.int32)),
                            _fixed(around),
                            pa.array(doc),
                            part.column(1).take(pa.array(words.kept[own])),
                            pa.array((at - words.first[own]).astype(np.int32)),
                            pa.array(words.n[own].astype(np.int32)),
                        ],
                        names=["prefix", "part", "around", "doc", "doc_id", "pos", "n_words"],
                    )

    return run


def _fixed(rows: np.ndarray) -> pa.Array:
    """binary column of equally long rows."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, about ``least`` rows at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        cols = [rows.column(c).to_numpy() for c in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if len(new):
            last = int(new[-1]) + 1
            yield rows.slice(0, last)
            held, n = rows.slice(last).to_batches(), rows.num_rows - last
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(*cols: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it."""
    return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))


def _classes(label: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: whether another document has its label, a partner's id (of the least such document with an id), whether it is its label's first."""
    order = np.lexsort((doc, ids == NONE, label))
    first = np.flatnonzero(_starts(label[order]))
    sizes = np.diff(np.append(first, len(order)))
    low, high = order[first], order[first + sizes - 1]
    shared, partner = np.empty(len(order), bool), np.empty(len(order), ids.dtype)
    shared[order] = np.repeat(doc[low] != doc[high], sizes)
    lead = np.repeat(low, sizes)
    partner[order] = np.where(doc[order] == doc[lead], ids[np.repeat(high, sizes)], ids[lead])
    leads = np.zeros(len(order), bool)
    leads[low] = True
    return shared, partner, leads


NONE = np.iinfo(np.int64).min  # stands for a null id in arrays
_MATCH = "doc bigint, doc_id bigint, start int, stop int, n_words int, partner bigint, window bigint, lone boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted neighbours' common prefixes, then extension to the left; also one document of each window of a divided prefix."""
    for rows in whole_groups(batches, ["prefix", "part"]):
        prefix, part, doc, pos, n = (rows.column(c).to_numpy() for c in ("prefix", "part", "doc", "pos", "n_words"))
        ids = rows.column("doc_id").combine_chunks().fill_null(int(NONE)).to_numpy()
        around = np.frombuffer(b"".join(rows.column("around").to_pylist()), np.uint32).reshape(len(doc), 2 * _EXTRA)
        order = np.lexsort((*(around[:, j] for j in range(_EXTRA - 1, -1, -1)), part, prefix))
        prefix, part, doc, pos, n, ids, around = (x[order] for x in (prefix, part, doc, pos, n, ids, around))
        common = np.zeros(len(doc), np.int64)  # words that a suffix shares with its neighbour beyond the prefix
        alike = ~_starts(prefix, part)
        common[~alike] = -1
        for j in range(_EXTRA):
            alike[1:] &= around[1:, j] == around[:-1, j]
            common[alike] = j + 1
        low, high = np.full(len(doc), np.iinfo(np.int32).max), np.full(len(doc), -1)
        partners, latest = np.full(len(doc), NONE), np.full(len(doc), NONE)
        left = np.zeros(len(doc), np.uint64)
        for l in range(WINDOW):  # l words of the window stand before the suffix
            if l:
                left = mix(left * _BASE + around[:, _EXTRA + l - 1].astype(np.uint64) + np.uint64(l))
            run = np.cumsum(common < _EXTRA - l).astype(np.uint64)
            fits = np.flatnonzero((pos >= l) & (pos - l + MIN_WORDS <= n))
            if not len(fits):
                continue
            shared, partner, leads = _classes(mix(run[fits] * _BASE ^ left[fits]), doc[fits], ids[fits])
            hit = fits[shared]
            low[hit] = np.minimum(low[hit], pos[hit] - l)
            high[hit] = np.maximum(high[hit], pos[hit] - l + MIN_WORDS)
            found = partner[shared]
            partners[hit] = np.where(partners[hit] == NONE, found, partners[hit])
            more = (found != NONE) & (latest[hit] != NONE) & (latest[hit] != found)  # another class of the row: a match of its own
            latest[hit] = np.where(found == NONE, latest[hit], found)
            if more.any():
                at = hit[more]
                yield _matches(doc[at], ids[at], pos[at] - l, pos[at] - l + MIN_WORDS, n[at], found[more], np.zeros(len(at), np.uint64), False)
            lone = fits[(leads | ~shared) & (part[fits] > 0)]
            if len(lone):
                right = np.zeros(len(lone), np.uint64)
                for j in range(_EXTRA - l):
                    right = mix(right * _BASE + around[lone, j].astype(np.uint64) + np.uint64(j))
                window = mix(prefix[lone].view(np.uint64) ^ mix(right + _BASE) ^ (left[lone] * _BASE + np.uint64(l)))
                yield _matches(doc[lone], ids[lone], pos[lone] - l, pos[lone] - l + MIN_WORDS, n[lone], np.full(len(lone), NONE), window, True)
        hit = high > 0
        if hit.any():
            yield _matches(doc[hit], ids[hit], low[hit], high[hit], n[hit], partners[hit], np.zeros(int(hit.sum()), np.uint64), False)


def _matches(doc, ids, start, stop, n, partner, window, lone: bool) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(ids, mask=ids == NONE), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(partner, mask=partner == NONE), pa.array(window.view(np.int64)), pa.array(np.full(len(doc), lone))],
        names=["doc", "doc_id", "start", "stop", "n_words", "partner", "window", "lone"],
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of divided prefixes, sorted by hash: those that another document has too."""
    for rows in whole_groups(batches, ["window"]):
        doc, start, stop, n, window = (rows.column(c).to_numpy() for c in ("doc", "start", "stop", "n_words", "window"))
        ids = rows.column("doc_id").combine_chunks().fill_null(int(NONE)).to_numpy()
        shared, partner, _ = _classes(window.view(np.uint64), doc, ids)
        if shared.any():
            yield _matches(doc[shared], ids[shared], start[shared], stop[shared], n[shared], partner[shared], window[shared].view(np.uint64), False)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by document and start -> one row for each document."""
    for rows in whole_groups(batches, ["doc"], 50_000):
        doc, start, stop, n = (rows.column(c).to_numpy() for c in ("doc", "start", "stop", "n_words"))
        first = np.flatnonzero(_starts(doc))
        last = np.append(first[1:], len(doc))
        ids, partner = rows.column("doc_id").take(pa.array(first)), rows.column("partner").to_pylist()
        covered, spans, partners = [], [], []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            reach = np.maximum.accumulate(stop[a:b])
            new = np.concatenate(([True], start[a + 1 : b] > reach[:-1]))
            begin, end = start[a:b][new], reach[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)]
            covered.append(int((end - begin).sum()))
            spans.append([{"start": x, "stop": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
            partners.append(sorted(set(partner[a:b]) - {None}))
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([ids.combine_chunks(), pa.array(n[first]), pa.array(covered, pa.int32()), pa.array(spans, span), pa.array(partners, pa.list_(pa.int64()))], names=["doc_id", "n_words", "repeated_words", "spans", "partners"])


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", part_rows: int = PART) -> DataFrame:
    """doc_id, n_words, repeated_words, spans (array of word ranges) and partners of each document with a repeated passage."""
    given = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    repeated = count_hashes(given, "text", _prefixes, "suffix-prefixes", least=2)
    rows = given.mapInArrow(_suffixes(repeated, part_rows), _ROW)
    found = cut(rows.repartition("prefix", "part").sortWithinPartitions("prefix", "part").mapInArrow(_compare, _MATCH), "suffix-matches")
    remove(repeated.folder)
    late = found.filter("lone").repartition("window").sortWithinPartitions("window").mapInArrow(_meet, _MATCH)
    every = found.filter("NOT lone").unionByName(late)
    return every.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(_join, "doc_id bigint, n_words int, repeated_words int, spans array<struct<start:int,stop:int>>, partners array<bigint>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "repeated_words", F.size("spans").alias("n_spans"), spans.alias("spans"), "partners")

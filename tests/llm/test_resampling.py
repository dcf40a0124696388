"""Importance resampling: checksums of n-grams, blocks and pieces of long texts, gains."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from quillwright.llm import resampling
from quillwright.llm.resampling import _dictionary_parts, _prefixes, _strings, bucket_totals, gains_of, ngram_checksums, words_of


def ngrams(words):
    return [b" ".join(words[a : a + n]) for n in (1, 2, 3) for a in range(len(words) - n + 1)]


def test_checksums():
    rng = random.Random(1)
    lists = [[bytes(rng.choice(b"abcxyz019\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 9, 40]))) for _ in range(k)] for k in (0, 1, 2, 3, 30, 0)] + [[b"x" * 70_000, b"y", b"z" * 5_000]]
    sums, there, starts = ngram_checksums(lists)
    for words, lo in zip(lists, starts.tolist(), strict=True):
        for n in (1, 2, 3):
            got = [int(c) for c, ok in zip(sums[n - 1][lo : lo + len(words)], there[n - 1][lo : lo + len(words)], strict=False) if ok]
            assert got == [zlib.crc32(b" ".join(words[a : a + n])) for a in range(len(words) - n + 1)]


def test_blocks_and_pieces(monkeypatch):
    """Small blocks and pieces: every n-gram is counted once, also across the pieces of a long text."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd é F-g 12".split()) for _ in range(rng.choice([0, 1, 3, 50]))) for _ in range(40)] + [None]
    want = collections.Counter(g for t in texts for g in ngrams(words_of((t or "").encode())))
    for piece, block in ((4, 10), (7, 1000), (1000, 1)):
        monkeypatch.setattr(resampling, "PIECE", piece)
        got = collections.Counter()
        for batch in _dictionary_parts("text", 5, block)(iter([pa.record_batch({"text": texts}), pa.record_batch({"text": texts[:3]})])):
            for shard, n, strings, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                assert 0 <= shard < 5
                runs = _strings([n], [strings])
                words, (one, two) = _prefixes(runs)
                times = np.frombuffer(zstandard.decompress(counts), np.uint32)
                for grams, t in ((one, times), (two, times[words >= 2]), (runs.filter(pa.array(words == 3)), times[words == 3])):
                    for g, c in zip(grams.to_pylist(), t.tolist(), strict=True):
                        got[g] += c
        assert got == want + collections.Counter(g for t in texts[:3] for g in ngrams(words_of((t or "").encode())))


def test_totals(spark):
    rows = [(f"w{k % 7} w{k % 5} w{k % 3} the",) for k in range(500)] + [("the " * 3000,)]
    want = collections.Counter(zlib.crc32(g) % 100 for t, in rows for g in ngrams(t.encode().split()))
    got = bucket_totals(spark.createDataFrame(rows, "text string").repartition(4), buckets=100)
    assert {b: int(n) for b, n in enumerate(got) if n} == dict(want)
    gains = gains_of(got, np.zeros(100, np.int64))  # an empty target: rare buckets gain
    assert gains[int(got.argmax())] == gains.min() and len(gains) == 100

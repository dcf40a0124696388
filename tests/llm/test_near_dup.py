"""The pipeline's near-duplicate stage against brute-force similarity."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillwright.llm import near_dup
from quillwright.llm.common import mix, words_of


def shingles(text):
    words = words_of((text or "").encode())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {frozenset(i for i in range(len(sets)) if root[i] == r) for r in root}


def test_edited_copies_are_one_class(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    texts = [None, "", "...", "one two", "One  two", "one two three"]
    for n in (30, 60, 100, 300):
        for edits in (1, 1, 1, 2, 3, 5, 8, 12):
            words = [rng.choice(pool) for _ in range(n)]
            texts.append(" ".join(words))
            for at in rng.sample(range(n), edits):
                words[at] = "changed"
            texts.append(" ".join(words))
    chain = [rng.choice(pool) for _ in range(120)]
    for i in range(40):  # a chain of edits: its ends are not similar, and it fills more than one tile
        chain[3 * i] = f"link{i}"
        texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute(texts)
    assert len(want) < len(texts) - 50
    for tile in (256, 8):
        got = near_dup.near_duplicates(docs, key="doc_id", tile=tile).groupBy("class").agg(F.collect_list("doc_id").alias("ids")).collect()
        assert {frozenset(r.ids) for r in got} == want
    full = docs.select("doc_id", "text", *(F.lit("x").alias(c) for c in ("lang", "source")), F.lit(1).cast("bigint").alias("n_chars"))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, full.select(*corpus_pipeline.COLUMNS), "").collect()}
    assert kept == {min(c) for c in want}


def test_fingerprints_are_simhash():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 2, 5, 254, 255, 256, 700, 5000)]
    got = near_dup.fingerprints(sets)
    for fp, s in zip(got, sets, strict=True):
        for word, salt in zip(fp.tolist(), near_dup._SALTS, strict=True):
            hashes = mix(s ^ salt).tolist()
            assert word == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    alike = [(s, np.concatenate((s[90:], rng.integers(0, 1 << 64, 90, np.uint64)))) for s in (rng.integers(0, 1 << 64, 810, np.uint64) for _ in range(50))]  # similarity 0.8
    a, b = (near_dup.fingerprints(list(x)) for x in zip(*alike, strict=True))
    assert 0.14 < np.bitwise_count(a ^ b).sum() / (50 * near_dup.BITS) < 0.165


def test_wide_comparison():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 64, (150, near_dup._WORDS), np.uint64)
    for i in range(0, 148, 3):  # neighbours at every distance about the radius
        fps[i + 1] = fps[i]
        for b in rng.permutation(near_dup.COMPARED)[: 30 + i % 20].tolist():
            fps[i + 1, b // 64] ^= np.uint64(1 << b % 64)
    want = np.bitwise_count(fps[:, None, : near_dup._SEEN] ^ fps[None, :, : near_dup._SEEN]).sum(axis=2) <= near_dup.RADIUS
    got = np.zeros((150, 150), bool)
    for part, hits in near_dup.neighbours(fps[:, : near_dup._SEEN], np.arange(150), None):
        got[part] = hits
    assert (got == (want & ~np.eye(150, dtype=bool))).all() and got.any()
    left, right = np.arange(0, 150, 2), np.arange(1, 150, 2)
    for part, hits in near_dup.neighbours(fps[:, : near_dup._SEEN], left, right):
        assert (hits == want[part][:, right]).all()
    whole = want & (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= near_dup.WHOLE)
    fps[3, 2:] = ~fps[4, 2:]  # near on the first bits only
    whole[3, 4] = whole[4, 3] = False
    for part, hits in near_dup.neighbours(fps, left, right):
        assert (hits == whole[part][:, right]).all()


def test_tables_find_pairs():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 64, (4000, near_dup._WORDS), np.uint64)
    changed = np.packbits(rng.random((4000, near_dup.BITS)) < near_dup.DIFFERENT, axis=1).view(np.uint64)
    for count in (1, 100_000, 10_000_000):
        tables = near_dup.tables_for(count)
        assert count <= 2048 << tables.shape[1] and all(len(set(t)) == len(t) for t in tables.tolist())
        met = (near_dup.keys_of(fps, tables) == near_dup.keys_of(fps ^ changed, tables)).any(axis=1)
        assert met.sum() >= 3996


def test_similar_texts_meet_in_tables(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(150):
        words = [rng.choice(pool) for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(words))
        for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute(texts)
    assert len(want) < len(texts)
    for tile in (4096, 4):  # keys of five bits
        got = near_dup.near_duplicates(docs, key="doc_id", tile=tile, bucket=10).groupBy("class").agg(F.collect_list("doc_id").alias("ids")).collect()
        assert {frozenset(r.ids) for r in got} == want

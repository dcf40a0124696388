"""Prefix trie: slices, merges and blocks of positions change nothing."""

import random

from quillwright.llm import prefix_trie
from quillwright.llm.prefix_trie import prefix_trie as trie


def test_slices_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, i, (x := rng.randint(0, 1)), -x, 1 + x) for c in range(300) for i in range(rng.randint(0, 9))]
    rows += [(c, None, None, None, None) for c in range(300) if c not in {r[0] for r in rows}]
    given = spark.createDataFrame(rows, "conv bigint, i bigint, a1 bigint, a2 bigint, chars bigint")
    whole = sorted(map(tuple, trie(given).collect()))
    monkeypatch.setattr(prefix_trie, "FAN_IN", 3)
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    assert sorted(map(tuple, trie(given, slice_size=7).collect())) == whole
    root = next(r for r in whole if r[1] == 0)
    assert root[0] == 0 and root[2] is None and root[3] == 300 and root[5] == sum(r[4] == 0 for r in whole)


def test_growing_snapshots(spark):
    """Each conversation goes on where the one before ended: the depth of nested runs, in no more jobs."""
    rows = [(c, i, i, i, 2) for c in range(120) for i in range(c + 1)]
    got = trie(spark.createDataFrame(rows, "conv bigint, i bigint, a1 bigint, a2 bigint, chars bigint")).orderBy("depth").collect()
    assert [(r.conv_id, r.n_convs, r.n_children, r.n_leaves) for r in got] == [(max(0, d - 1), 120 - max(0, d - 1), int(d < 120), 1) for d in range(121)]
    assert [r.saved_tokens for r in got] == [sum((120 - max(0, e - 1) - 1) * 2 for e in range(max(1, d), 121)) for d in range(121)]

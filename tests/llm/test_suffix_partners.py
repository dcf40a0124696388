"""Partners connect exactly the documents that share windows of 50 words."""

import random

import pytest

from quillwright.llm import suffix_dedup


def classes(ids, links):
    root = {i: i for i in ids}
    for a, b in links:
        x, y = root[a], root[b]
        root = {i: x if r == y else r for i, r in root.items()}
    return {frozenset(i for i in ids if root[i] == r) for r in root.values()}


@pytest.mark.parametrize("part_rows", [2048, 2])
def test_partners_connect_families(spark, part_rows):
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(40):  # two families of copies that share a short passage alone; a null id is first in every third
        passage = new(50 + k % 7)
        one = [new(20) + passage + new(30) for _ in range(2)]
        if k % 3 == 0:
            rows.append((None, " ".join(new(5) + passage + new(5))))
        for j, words in enumerate((one[0], one[1], one[1], one[0])):
            rows.append((10 * k + j, " ".join(new(3) + words + new(3))))
    windows = {}
    for i, text in rows:
        words = text.split()
        for a in range(len(words) - 49) if i is not None else ():
            windows.setdefault(tuple(words[a : a + 50]), []).append(i)
    ids = [i for i, _ in rows if i is not None]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = suffix_dedup.repeated_passages(table, part_rows=part_rows).collect()
    links = [(r.doc_id, p) for r in got if r.doc_id is not None for p in r.partners]
    assert classes(ids, links) == classes(ids, [(v[0], x) for v in windows.values() for x in v[1:]])

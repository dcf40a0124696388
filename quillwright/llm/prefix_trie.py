"""Operator 12 — prefix trie of conversations, from mergeable partial tries.

A turn counts by its role and text, of which a 128-bit hash is kept. The node of a sequence of turns is the exclusive or of its
turns' hashes, each salted with its position: a prefix's node comes from a running ``bit_xor``, and a node's parent by taking the last turn
out again. Running sums go in two levels (blocks of positions, then blocks), so that a conversation of millions of turns is not
one task's work.

Conversations in order of their ids are cut into slices. Each slice's partial trie is a table of (node, slice) with what is
summed: members, least member, roll-up values; Spark combines it where rows are read, before the shuffle. Partial tries are merged
by rounds, ``FAN_IN`` slices into one, keyed by node and group of slices, until one slice is left: a node that all conversations
share (the root) never meets in more than ``FAN_IN`` rows. What a node knows in the end goes back by way of (node, slice), again without
a hot key. End lists stay in pieces of a slice each, ordered, and are hashed as a sorted stream, so that a list that holds a third of all
conversations is never held whole (SHA-256 itself has to read it in one task).

Roll-up: a node belongs to its least member, so a conversation owns one downward run of nodes, the end of its path. Bottom-up sums
inside such a run, and the whole run's sum for all nodes above it, give each node its subtree's values: a node's subtree is the
lower part of its least member's run, and the whole runs of its other members. The whole runs are summed by the same merges, so
the number of jobs follows log(conversations) and not the depth.

Defined results: turns are ordered by ``turn``, null first, ties by role and text hash; null role or text counts as empty; rows
without a conv_id name no conversation and are left out; a conversation without a turn is a member of the root and ends there;
empty table — an empty result; extra columns are ignored. ``c - c % 100`` is taken with the sign of ``c`` (Spark's %).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, placed

SLICE, FAN_IN, BLOCK = 4096, 16, 4096
NODE = ["k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, i, a1, a2, chars): the turns' hashes and code points, numbered from 0 in each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv"), "turn", F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit(1), role, text).alias("a2"), F.length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("row"))
    rows = placed(given, ["conv", F.col("turn").asc_nulls_first(), "a1", "a2", "row"], "trie-turns")
    first = rows.groupBy("conv").agg(F.min("place").alias("first"))
    return cut(rows.join(first, "conv").select("conv", (F.col("place") - F.col("first")).alias("i"), "a1", "a2", "chars"), "trie-numbered")


def shared_prefixes(turns: DataFrame) -> DataFrame:
    """(conv, i, a1, a2, chars) of the rebuilt conversations; one without a turn has a row of nulls.

    A conversation c begins with the first h turns of conversation c - c % 100 (h: CRC-32 of c's decimals, modulo 6); its own from h on follow.
    """
    base, h = F.col("conv") - F.col("conv") % 100, F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), h.alias("h"))
    starts = turns.filter("i < 5 AND conv % 100 = 0").select(F.col("conv").alias("base"), "i", "a1", "a2", "chars")
    lent = convs.join(starts, "base").filter(F.col("i") < F.col("h")).select("conv", "i", "a1", "a2", "chars")
    length = starts.groupBy("base").agg(F.count("*").alias("n"))
    shift = convs.join(length, "base", "left").select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("lent"))
    own = turns.join(shift, "conv").filter(F.col("i") >= F.col("h")).select("conv", (F.col("i") - F.col("h") + F.col("lent")).alias("i"), "a1", "a2", "chars")
    return convs.select("conv").join(lent.union(own), "conv", "left")


def _merge(partial: DataFrame, slices: int, sums: list[Column], key: list[str] = NODE) -> DataFrame:
    """Tree merges of (key, slice, ...) until each key has one row; ``sums`` are aggregates that keep their names."""
    while slices > 1:
        partial = partial.groupBy(*key, F.floor(F.col("slice") / FAN_IN).alias("slice")).agg(*sums)
        slices = -(-slices // FAN_IN)
    return partial.drop("slice")


def _named(f, *names: str) -> list[Column]:
    return [f(n).alias(n) for n in names]


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, slice, piece), sorted -> a hash for each node; one piece is held at a time."""
    node, state, out = None, None, []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], (pa.int64(), pa.int64(), pa.string())[k]) for k in range(3)], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for k1, k2, piece in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if node != (k1, k2):
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if len(out) >= 10_000:
            yield emit()
            out = []
    if node:
        out.append((*node, state.hexdigest()))
    if out:
        yield emit()


def prefix_trie(rebuilt: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """The trie of sequences (conv, i, a1, a2, chars), i from 0 without gaps, one row of nulls for an empty one.

    One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rebuilt = cut(rebuilt, "trie-rebuilt")
    convs = placed(rebuilt.groupBy("conv").agg(F.count("i").alias("length")), ["conv"], "trie-convs")
    slices = max(1, -(-convs.count() // slice_size))
    convs = convs.select("conv", "length", F.floor(F.col("place") / slice_size).alias("slice"))
    # a prefix's node: running exclusive or inside a block of positions, then over the blocks before it
    turns = rebuilt.filter("i IS NOT NULL").withColumn("block", F.floor(F.col("i") / BLOCK)).withColumns({f"h{n}": F.xxhash64(F.lit(n), "i", f"a{n}") for n in (1, 2)})
    inside = Window.partitionBy("conv", "block").orderBy("i")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv", "block").agg(*_named(F.bit_xor, "h1", "h2"))
    carried = blocks.select("conv", "block", *(F.coalesce(F.bit_xor(f"h{n}").over(before), F.lit(0)).alias(f"c{n}") for n in (1, 2))).filter("block > 0")
    run = turns.select("conv", "block", "i", "h1", "h2", "chars", *(F.bit_xor(f"h{n}").over(inside).alias(f"p{n}") for n in (1, 2))).join(carried, ["conv", "block"], "left")
    node = [F.col(f"p{n}").bitwiseXOR(F.coalesce(f"c{n}", F.lit(0))) for n in (1, 2)]
    steps = run.select("conv", (F.col("i") + 1).alias("depth"), node[0].alias("k1"), node[1].alias("k2"), node[0].bitwiseXOR(F.col("h1")).alias("up1"), node[1].bitwiseXOR(F.col("h2")).alias("up2"), "chars")
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    paths = steps.join(convs, "conv").union(convs.select("conv", zero, zero, zero, none, none, zero, "length", "slice"))
    paths = cut(paths, "trie-paths")

    # first merges: members and least member of each node
    plain = [*_named(F.min, "conv", "depth", "up1", "up2", "chars"), F.sum("n").alias("n")]
    partial = cut(paths.withColumn("n", F.lit(1)).groupBy(*NODE, "slice").agg(*plain), "trie-partial")
    nodes = _merge(partial, slices, plain)
    children = nodes.filter("depth > 0").select(F.col("up1").alias("k1"), F.col("up2").alias("k2"), "conv").withColumn("children", F.lit(1))
    # a node's children are counted by slices of their least member first: the root can have very many
    by_slice = children.join(convs.select("conv", "slice"), "conv").groupBy(*NODE, "slice").agg(F.sum("children").alias("children"))
    n_children = _merge(by_slice, slices, [F.sum("children").alias("children")])
    nodes = cut(nodes.join(n_children, NODE, "left").withColumn("children", F.coalesce("children", zero)), "trie-nodes")

    # roll-up: each conversation's own run bottom-up, then whole runs summed over members by the same merges
    worth = (F.col("n") - 1) * F.col("chars")
    upward = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = nodes.filter("n > 1").select(*NODE, F.sum(worth).over(upward).alias("below"))
    runs = nodes.groupBy("conv").agg(F.sum(worth).alias("run"), F.sum((F.col("children") == 0).cast("bigint")).alias("leaves"))
    sums = _named(F.sum, "run", "leaves")
    rolled = _merge(paths.select("conv", *NODE, "slice").join(runs, "conv").groupBy(*NODE, "slice").agg(*sums), slices, sums)
    own = runs.select("conv", F.col("run").alias("own"))

    pieces = paths.filter("depth = length").groupBy(*NODE, "slice").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("piece"))
    ends = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "slice").mapInArrow(_ends_hash, "k1 bigint, k2 bigint, ends_sha256 string")

    # a node's parent holds the node's least member, too: it is asked for by (parent, slice of that member)
    at_slice = partial.select(*NODE, "slice").join(nodes.select(*NODE, F.col("conv").alias("parent_conv_id")), NODE)
    up = at_slice.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), "slice", "parent_conv_id")
    whole = nodes.join(convs.select("conv", "slice"), "conv").join(up, ["up1", "up2", "slice"], "left").join(own, "conv").join(below, NODE, "left").join(rolled, NODE).join(ends, NODE, "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("run") - F.col("own") + F.coalesce("below", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_prefixes(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CRC-32 is worked out from its polynomial (fixed value 0xEDB88320), bit by bit, over the decimals' bytes.
ORACLE_SQL = r"""
WITH given AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, c - c % 100 AS base, CAST(c AS VARCHAR) AS s FROM given),
hashed AS (
  SELECT c, base, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(s[k]) AS BIGINT)), lambda crc, byte:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)), 4294967295), 4294967295) % 6 AS h
  FROM convs),
shifted AS (SELECT h.c, h.base, h.h, least(h.h, (SELECT count(*) FROM given g WHERE g.c = h.base)) AS lent FROM hashed h),
rebuilt AS (
  SELECT s.c, g.i, g.role, g.text FROM shifted s JOIN given g ON g.c = s.base AND g.i < s.h
  UNION ALL SELECT s.c, g.i - s.h + s.lent, g.role, g.text FROM shifted s JOIN given g ON g.c = s.c AND g.i >= s.h),
steps AS (
  SELECT c, i + 1 AS d, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY i) AS path, length(text) AS chars, count(*) OVER (PARTITION BY c) AS len FROM rebuilt
  UNION ALL SELECT s.c, 0, [], 0, (SELECT count(*) FROM rebuilt r WHERE r.c = s.c) FROM shifted s),
paths AS (SELECT c, d, md5(CAST(to_json(path) AS VARCHAR)) AS k, chars, len, lag(md5(CAST(to_json(path) AS VARCHAR))) OVER (PARTITION BY c ORDER BY d) AS up FROM steps),
nodes AS (SELECT k, min(c) AS c, min(d) AS d, min(up) AS up, min(chars) AS chars, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = len), '') AS ends FROM paths GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
above AS (SELECT p.k, sum((u.n - 1) * u.chars) AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves FROM nodes u JOIN paths p ON p.c = u.c AND p.d <= u.d LEFT JOIN kids ON kids.k = u.k GROUP BY p.k)
SELECT v.c AS conv_id, v.d AS depth, p.c AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v JOIN above a ON a.k = v.k LEFT JOIN kids ON kids.k = v.k LEFT JOIN nodes p ON p.k = v.up
"""

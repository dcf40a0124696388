"""De-duplication (D01-D06, T02's batch form)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_hash
from ..registry import query
from .ranking import placed


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``; an aggregate, so that a large group combines early."""
    named = rows.withColumns({f"__k{i}": k if isinstance(k, Column) else F.col(k) for i, k in enumerate(keys)})
    first = named.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("x"))
    return first.select("x.*")


def kept_places(times: np.ndarray, window: float) -> np.ndarray:
    """Greedy fold over sorted times: a row is kept if it is more than ``window`` after the last kept row."""
    keep = np.zeros(len(times), bool)
    i = 0
    while i < len(times):
        keep[i] = True
        i = int(np.searchsorted(times, times[i] + window, side="right"))
    return keep


def exits(times: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """What a chunk of one key's sorted times does to the last kept instant that enters it, as a step function.

    An entering instant a goes on at the first time over a + window. ``breaks`` and ``leaves``: the first break over a tells what
    leaves; beyond the last break a itself does. Without an entering instant the first step holds.
    """
    after = np.searchsorted(times, times + window, side="right")
    last = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            last[i] = last[after[i]]
    n = min(len(times), int(after[0]) + 1)  # an entering instant isn't after the first time
    end = np.append(last[1:n] != last[: n - 1], True)  # of the starts that leave the same, the last
    return (times[:n] - window)[end].tolist(), last[:n][end].tolist()


def folded(rows: DataFrame, keys: list[str], ts: str = "ts", order: str = "id", seconds: int = 5, chunk: int = 50_000) -> DataFrame:
    """``rows`` with ``kept`` and ``anchor``, the instant (microseconds) of the kept row that a row is or falls to, of D03's fold.

    A fold looks sequential, but a stretch of a key's rows only maps the last kept instant that enters it to one that leaves it. All rows
    are put in order of key, time and ``order`` and cut into chunks of equal size, wherever keys begin. Each chunk gives its map (``exits``); a
    stream over the maps, one small row for ``chunk`` rows, tells what enters each chunk; then the chunks fold on their own. So a key that holds all rows
    is as many tasks' work as any other.
    """
    window = seconds * 1_000_000
    given = rows.withColumn("key_", F.to_json(F.struct(*keys))).withColumn("us_", F.unix_micros(ts))
    given = placed(given, ["key_", "us_", order], given.columns).withColumn("chunk_", F.floor((F.col("place") - 1) / chunk))

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        key, us = part["key_"].to_numpy(), part["us_"].to_numpy()
        out = [(key[0], *(exits(us, window) if key[0] == key[-1] else ([], [])), False)]
        if key[0] != key[-1]:  # the last key begins here: what leaves doesn't depend on what enters
            out.append((key[-1], [], exits(us[key == key[-1]], window)[1][:1], True))
        return pd.DataFrame(out, columns=["key_", "breaks", "leaves", "fresh"]).assign(chunk_=part["chunk_"].iloc[0])

    maps = given.select("chunk_", "key_", "us_", "place").groupBy("chunk_").applyInPandas(summary, "key_ string, breaks array<bigint>, leaves array<bigint>, fresh boolean, chunk_ bigint")

    def entering(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for part in parts:
            out = []
            for k, breaks, leaves, fresh, c in part[["key_", "breaks", "leaves", "fresh", "chunk_"]].itertuples(index=False, name=None):
                key, last = k, last if k == key else None
                if not fresh and last is not None:
                    out.append((c, last))
                if len(leaves):
                    at = 0 if last is None else int(np.searchsorted(breaks, last, side="right"))
                    last = int(leaves[at]) if at < len(leaves) else last
            yield pd.DataFrame(out, columns=["chunk_", "last_"])

    entered = maps.repartition("key_").sortWithinPartitions("key_", "chunk_").mapInPandas(entering, "chunk_ bigint, last_ bigint")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place").reset_index(drop=True)
        key, us = part["key_"].to_numpy(), part["us_"].to_numpy()
        last = part["last_"].iloc[0]
        new = np.append(True, (key[1:] != key[:-1]) | (us[1:] - us[:-1] > window))  # such a row is kept, whatever was before
        starts = np.flatnonzero(new)
        kept = new.copy()
        for lo, hi in zip(starts, np.append(starts[1:], len(us)), strict=True):
            if lo == 0 and not pd.isna(last):
                begin = int(np.searchsorted(us[:hi], int(last) + window, side="right"))
                kept[:hi] = False
                kept[begin:hi] = kept_places(us[begin:hi], window)
            elif hi - lo > 1:
                kept[lo:hi] = kept_places(us[lo:hi], window)
        part["kept"] = kept
        at = np.maximum.accumulate(np.where(kept, np.arange(len(us)), -1))
        part["anchor"] = np.where(at < 0, -1 if pd.isna(last) else int(last), us[at])
        return part.drop(columns=["key_", "us_", "place", "chunk_", "last_"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "kept boolean", "anchor bigint"])
    return given.join(entered, "chunk_", "left").groupBy("chunk_").applyInPandas(fold, schema)


def near_dedup(rows: DataFrame, keys: list[str], ts: str = "ts", order: str = "id", seconds: int = 5, chunk: int = 50_000) -> DataFrame:
    """``rows`` with ``kept``: false if a kept row of the same keys is at most ``seconds`` before (compared with kept rows only)."""
    return folded(rows, keys, ts, order, seconds, chunk).drop("anchor")


def longest_of_clusters(rows: DataFrame, keys: list[str], ts: str = "ts", body: str = "body", order: str = "id", seconds: int = 5, chunk: int = 50_000) -> DataFrame:
    """Clusters of rows within ``seconds`` of the cluster's first row; the longest body of each stays."""
    marked = folded(rows, keys, ts, order, seconds, chunk)  # two kept rows of a key have different instants
    return marked.groupBy(*keys, "anchor").agg(F.max_by(F.struct(*rows.columns), F.struct(F.length(body), -F.col(order))).alias("x")).select("x.*")


def outcome(blank: Column, newsletter: Column, related: Column, personal: Column, duplicate: Column, company_missing: Column) -> tuple[Column, Column]:
    """(outcome, reason) by the first condition that holds."""
    reason = F.when(blank, "blank_body").when(newsletter & ~related, "newsletter_headers").when(personal, "personal_domain").when(duplicate, "duplicate_hash").when(company_missing, "missing_company")
    return F.when(reason.isNull(), "inserted").otherwise("ignored"), reason


def reingest(old: DataFrame, new: DataFrame, key: str, values: list[str], overwrite_reviewed: bool = False) -> DataFrame:
    """The union of two snapshots by key; new values win but for reviewed rows (unless asked)."""
    o = old.select(key, F.struct("reviewed", *values).alias("o"))
    n = new.select(key, F.struct(*values).alias("n"))
    stay = F.col("n").isNull() | (F.coalesce(F.col("o.reviewed"), F.lit(False)) & F.lit(not overwrite_reviewed))
    joined = o.join(n, key, "full_outer")
    return joined.select(key, *(F.when(stay, F.col(f"o.{v}")).otherwise(F.col(f"n.{v}")).alias(v) for v in values), F.coalesce("o.reviewed", F.lit(False)).alias("reviewed"))


@query("d01_f47_content_hash_dedup", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))")
def _(t):
    return keep_first(t.documents.select("doc_id", "text"), [body_hash("text")], ["doc_id"]).select("doc_id")


@query("d02_exact_dedup", "SELECT min(id) AS id FROM messages GROUP BY subject, sender, date_trunc('hour', ts)")
def _(t):
    return keep_first(t.messages.select("id", "subject", "sender", "ts"), ["subject", "sender", F.date_trunc("hour", "ts")], ["id"]).select("id")


@query("d03_t02_near_dedup_greedy", "WITH RECURSIVE o AS (SELECT id, sender, ml_label, ts, row_number() OVER (PARTITION BY sender, ml_label ORDER BY ts, id) AS rn FROM messages WHERE ml_label IS NOT NULL), f AS (SELECT id, sender, ml_label, ts AS anchor, rn, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.sender, o.ml_label, CASE WHEN epoch_us(o.ts) - epoch_us(f.anchor) > 600000000 THEN o.ts ELSE f.anchor END, o.rn, epoch_us(o.ts) - epoch_us(f.anchor) > 600000000 FROM f JOIN o ON o.sender = f.sender AND o.ml_label = f.ml_label AND o.rn = f.rn + 1) SELECT id, kept FROM f")
def _(t):
    return near_dedup(t.messages.filter("ml_label IS NOT NULL").select("id", "sender", "ml_label", "ts"), ["sender", "ml_label"], seconds=600).select("id", "kept")


@query("d04_w13_cluster_longest", "WITH RECURSIVE o AS (SELECT id, sender, ml_label, ts, body, row_number() OVER (PARTITION BY sender, ml_label ORDER BY ts, id) AS rn FROM messages WHERE ml_label IS NOT NULL), f AS (SELECT id, sender, ml_label, body, ts, ts AS anchor, rn, 1 AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.sender, o.ml_label, o.body, o.ts, CASE WHEN epoch_us(o.ts) - epoch_us(f.anchor) > 600000000 THEN o.ts ELSE f.anchor END, o.rn, CAST(epoch_us(o.ts) - epoch_us(f.anchor) > 600000000 AS INT) FROM f JOIN o ON o.sender = f.sender AND o.ml_label = f.ml_label AND o.rn = f.rn + 1), c AS (SELECT *, sum(kept) OVER (PARTITION BY sender, ml_label ORDER BY rn) AS c FROM f) SELECT max_by(id, (length(body), -id)) AS id FROM c GROUP BY sender, ml_label, c")
def _(t):
    return longest_of_clusters(t.messages.filter("ml_label IS NOT NULL").select("id", "sender", "ml_label", "ts", "body"), ["sender", "ml_label"], seconds=600).select("id")


@query("d05_k03_reingest_upsert", "WITH n AS (SELECT id, 'other' AS ml_label, 0.5 AS confidence FROM messages WHERE id % 4 = 0 UNION ALL SELECT -1, 'new', 0.25) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR coalesce(o.reviewed, false) THEN o.ml_label ELSE n.ml_label END AS ml_label, CAST(CASE WHEN n.id IS NULL OR coalesce(o.reviewed, false) THEN o.confidence ELSE n.confidence END AS DOUBLE) AS confidence, coalesce(o.reviewed, false) AS reviewed FROM messages o FULL JOIN n ON n.id = o.id")
def _(t):
    new = t.messages.filter("id % 4 = 0").select("id", F.lit("other").alias("ml_label"), F.lit(0.5).alias("confidence"))
    new = new.union(t.spark.createDataFrame([(-1, "new", 0.25)], new.schema))
    return reingest(t.messages, new, "id", ["ml_label", "confidence"])


@query("d06_ignore_outcomes", "WITH h AS (SELECT min(id) AS first, body, subject FROM messages GROUP BY body, subject) SELECT CASE WHEN reason IS NULL THEN 'inserted' ELSE 'ignored' END AS outcome, reason, count(*) AS n FROM (SELECT CASE WHEN m.id % 50 = 0 THEN 'blank_body' WHEN m.id % 9 = 0 AND NOT contains(m.body, 'signup') THEN 'newsletter_headers' WHEN m.company_id % 20 = 8 THEN 'personal_domain' WHEN h.first < m.id THEN 'duplicate_hash' WHEN m.company_source IS NULL THEN 'missing_company' END AS reason FROM messages m JOIN h ON h.body = m.body AND h.subject = m.subject) GROUP BY 1, 2")
def _(t):
    first = t.messages.groupBy("body", "subject").agg(F.min("id").alias("first"))
    m = t.messages.join(first, ["body", "subject"])
    what, why = outcome(F.col("id") % 50 == 0, F.col("id") % 9 == 0, F.col("body").contains("signup"), F.col("company_id") % 20 == 8, F.col("first") < F.col("id"), F.col("company_source").isNull())
    return m.groupBy(what.alias("outcome"), why.alias("reason")).agg(F.count("*").alias("n"))


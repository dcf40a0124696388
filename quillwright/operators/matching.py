"""Dictionaries of names against texts (J18, E10), without a loop over the names, by equi-joins.

Whole words: a text's runs of as many words as names have, with what stands between them, are joined with the names as strings. Only names
that begin or end with another character than a word's meet by hashes of their words and are tested by a pattern. Substrings: the first
``PREFIX`` characters, which many names can share, tell where in a text names may begin and how long they may be; the substrings
there are joined with the names. So a text meets the names that it holds, and not all those that begin alike. The dictionary is a DataFrame
of any size; it is written once, and Spark broadcasts it if it is small. A text's names are summed up by one aggregate.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Characters of a name that find candidates for a substring.
PREFIX = 8


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def _lengths(names: DataFrame, of: Column) -> list[int]:
    """The distinct lengths that a dictionary's keys have: a few numbers."""
    return sorted(r[0] for r in names.select(of).distinct().collect() if r[0])


def _grams(size: Column, lengths: list[int], part) -> Column:
    """Hashes of all parts (start from 1, length) of so many items."""

    def of(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(part(i, n)))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(*(of(n) for n in lengths)))


def _whole_words(texts: DataFrame, key: str, dims: DataFrame) -> list[DataFrame]:
    """(key, k_), to be joined with the names' ``k_``: lower-case runs of words; and the odd names' finds, if there are such names."""
    runs = lambda odd: dims.filter(F.lower("name").rlike(r"(?U)^\w(.*\w)?$") != odd)
    sizes, out = F.size(_words(F.col("name"))), []
    if lengths := _lengths(runs(False), sizes):
        pieces = texts.select(key, F.regexp_extract_all(F.lower("t_"), F.lit(r"(?U)\w+|\W+"), F.lit(0)).alias("p_"))
        first = F.when(F.get("p_", F.lit(0)).rlike(r"(?U)^\w"), 1).otherwise(2)

        def of(n: int) -> Column:
            last = F.size("p_") - 2 * (n - 1)
            return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(2)), lambda i: F.array_join(F.slice("p_", i, 2 * n - 1), ""))).otherwise(F.array().cast("array<string>"))

        grams = pieces.select(key, F.explode(F.array_distinct(F.concat(*map(of, lengths)))).alias("k_"))
        out.append(grams.join(runs(False).withColumn("k_", F.lower("name")), "k_").drop("k_"))
    if lengths := _lengths(runs(True), sizes):
        grams = _grams(F.size("i_"), lengths, lambda i, n: F.array_join(F.slice("i_", i, n), " "))
        near = texts.select(key, _words(F.col("t_")).alias("i_")).select(key, F.explode(grams).alias("k_"))
        quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
        met = near.join(runs(True).withColumn("k_", F.xxhash64(F.array_join(_words(F.col("name")), " "))), "k_").drop("k_")
        out.append(met.join(texts, key).filter(F.rlike(F.col("t_"), quoted)).drop("t_"))
    return out


def _parts(texts: DataFrame, key: str, dims: DataFrame) -> list[DataFrame]:
    """(key, name, ...): names at substrings of the texts."""
    low = F.lower(F.col("name"))
    size = F.least(F.length(low), F.lit(PREFIX))
    lengths = _lengths(dims, size)
    if not lengths:
        return []
    begins = written(dims.groupBy(F.xxhash64(F.substring(low, F.lit(1), size)).alias("b_")).agg(F.collect_set(F.length(low)).alias("w_")), "beginnings")
    lower = texts.select(key, F.lower("t_").alias("i_"))
    starts = lower.select(key, F.explode(_grams(F.length("i_"), lengths, lambda i, n: F.substring("i_", i, F.lit(n)))).alias("b_"))
    met = starts.join(begins, "b_").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b_", "w_"))).alias("m_"))

    def at(n: int) -> Column:
        places = F.when(F.length("i_") >= n, F.sequence(F.lit(1), F.length("i_") - (n - 1))).otherwise(F.array().cast("array<int>"))
        known = F.transform(places, lambda i: F.struct(i.alias("i"), F.try_element_at("m_", F.xxhash64(F.substring("i_", i, F.lit(n)))).alias("w")))
        inside = F.filter(known, lambda x: x["w"].isNotNull())
        return F.flatten(F.transform(inside, lambda x: F.transform(F.filter(x["w"], lambda w: x["i"] + w <= F.length("i_") + 1), lambda w: F.substring("i_", x["i"], w))))

    parts = lower.join(met, key).select(key, F.explode(F.array_distinct(F.concat(*map(at, lengths)))).alias("k_"))
    return [parts.join(dims.withColumn("k_", low), "k_").drop("k_")]


def held_names(rows: DataFrame, key: str, text: str, names: DataFrame, whole_words: bool = True, longest: bool = True) -> DataFrame:
    """(key, name, ...): for each row of ``rows`` whose text holds names, whatever the case, the longest of them, or else the first.

    ``names``: name, ord and more columns, which go with the name. Of equally long names the first by ``ord`` wins. ``key`` is unique in ``rows``.
    Blank names, for whole words also names without a letter or digit, are never held; null texts hold nothing.
    """
    extra = [c for c in names.columns if c not in ("name", "ord")]
    given = names.filter(F.trim("name") != "")
    dims = written(given.filter(F.size(_words(F.col("name"))) > 0) if whole_words else given, "names")
    texts = rows.select(F.col(key), F.col(text).alias("t_")).filter("t_ IS NOT NULL")
    found = (_whole_words if whole_words else _parts)(texts, key, dims)
    if not found:
        return rows.select(key).limit(0).join(names.select("name", *extra).limit(0), F.lit(True), "left")
    met = functools.reduce(DataFrame.unionByName, found)
    rank = F.struct(F.length("name"), -F.col("ord")) if longest else F.struct(-F.col("ord"))
    return met.groupBy(key).agg(F.max_by(F.struct("name", *extra), rank).alias("m_")).select(key, "m_.*")


def first_by_order(dims: DataFrame, key: Column, values: list[str]) -> DataFrame:
    """(k, values): of entries with the same key the first by ``ord``."""
    return dims.filter(key.isNotNull()).groupBy(key.alias("k")).agg(F.min_by(F.struct(*values), F.struct("ord", *values)).alias("v")).select("k", "v.*")

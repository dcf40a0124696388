"""Operator 1 — secret scans with a randomness test battery. DataFrame functions only, no Python on the executors.

Base spans come from three patterns (``assign``, ``access``, ``hex``): leftmost and non-overlapping for each kind; a span
is the whole match, in code points. Positions come from splitting at the pattern: the lengths of the pieces between
matches and of the matches add up to them. Running sums and maxima over an array are taken in pieces (``scan``), so that a
text with very many matches isn't copied again for each of them.

The battery adds ``random`` spans. Candidates are runs of 20 or more characters of the base64 and base64url alphabets; each
gets the encoding inferred from its characters, the narrowest that has them all: lower or upper hex, base32 (A-Z and 2-7), lower or
upper base36 (each with letters and digits), base62, base64 or base64url (each with both cases and digits). Tests of the null hypothesis "uniform over the encoding's alphabet":

* chi-squared over the alphabet's symbols, and over its classes (upper, lower, digits, marks), which has power where a
  short string leaves few occurrences for each symbol (Wilson-Hilferty approximation);
* runs above and below the middle of the alphabet (Wald-Wolfowitz, two-sided);
* serial correlation of neighbouring symbols' values (lag 1, two-sided).

The combined p-value is four times the least one. A true secret has a uniform p-value, text a very small one. False
discoveries are controlled in strata of encoding and length (powers of two), because a short string's tests have less
power: with m candidates in a stratum, (1 + #{p > 1/2}) / (m / 2) estimates the share of random ones (Storey), so the
expected share of others among those with p >= t is known for each t, and the least t is taken that keeps it under
``FDR``; never one under ``LEAST_P``. The test takes strings as independent, so a stratum's histogram counts each distinct
string once (by a 64-bit hash), however often it is copied; the threshold holds for all its occurrences. In a stratum with few
distinct strings the estimate is at its upper end, all random, and ``LEAST_P`` alone decides: every t counts there, not only
those at which a string stands. The table of thresholds has a fixed size bound (encodings x lengths) and is broadcast.

Documents are scanned once; what was found is cut to the shared folder, without texts, before the thresholds are known.

Defined results: null or empty text — no span; repeated rows — equal results; a random span inside a base span isn't
repeated; very long texts are scanned whole; an empty table gives an empty result; other columns are kept by
``find_secrets`` unless they clash with its own, which replace them.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, without

KINDS = ("assign", "access", "hex", "random")
# the contract's patterns; the minimum lengths of access and hex are inside, as their runs are maximal either way
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FDR, LEAST_P, BINS = 0.05, 0.01, 100
_CODES = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "b32": string.ascii_uppercase + "234567",
    "b36": string.ascii_lowercase + string.digits,
    "B36": string.ascii_uppercase + string.digits,
    "b62": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "b64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}


_PIECE = 128


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def scan(values: Column, add: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running results of ``add`` (associative) over an array: in pieces of a fixed size, then over the pieces' last results."""

    def running(xs: Column) -> Column:
        grow = lambda acc, x: F.concat(acc, F.array(add(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x)))
        return F.aggregate(xs, F.array().cast("array<int>"), grow)

    def whole(pieces: Column) -> Column:
        before = F.concat(F.array(zero), running(F.transform(pieces, lambda p: F.element_at(p, -1))))
        return let(before, lambda low: F.flatten(F.transform(pieces, lambda p, k: F.transform(p, lambda x: add(F.get(low, k), x)))))

    def cut_up(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _PIECE).cast("int"))
        pieces = F.transform(at, lambda k: running(F.slice(xs, k * _PIECE + 1, F.lit(_PIECE))))
        return F.when(F.size(xs) > _PIECE, let(pieces, whole)).otherwise(running(xs))

    return let(values, cut_up)


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches, leftmost and non-overlapping."""

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = scan(F.zip_with(found, gaps, lambda m, g: F.length(m) + F.length(g)), lambda a, b: a + b, F.lit(0))
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), m.alias("value")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast(_SPANS))


def inside(spans: Column, base: Column) -> Column:
    """array<boolean> for ``spans`` in order of their starts: whether a span of ``base`` holds one whole."""
    shape = lambda xs, own: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end")))

    def held(every: Column) -> Column:
        reach = scan(F.transform(every, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), F.greatest, F.lit(0))
        both = F.zip_with(every, reach, lambda x, r: F.struct(x["own"].alias("own"), (r >= x["end"]).alias("held")))
        return F.transform(F.filter(both, lambda x: x["own"] == 1), lambda x: x["held"])

    return let(F.array_sort(F.concat(shape(base, 0), shape(spans, 1))), held)


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (Page's logistic approximation, error under 2e-4)."""
    z = f"greatest(-30D, least(30D, {z}))"
    return f"(1D / (1D + exp(1.5976D * {z} + 0.07056D * {z} * {z} * {z})))"


def _chi(x: str, df: str) -> str:
    """Upper tail of chi-squared, Wilson and Hilferty's approximation."""
    return _tail(f"((power({x} / {df}, 1D / 3) - (1 - 2D / (9 * {df}))) / sqrt(2D / (9 * {df})))")


def battery(given: DataFrame) -> DataFrame:
    """``c``: array<struct<start, end, value, inside>> of candidates -> array<struct<start, end, inside, hash, stratum, bin>>."""
    order = ["start", "end", "inside"]

    def step(rows: DataFrame, /, **fields: str) -> DataFrame:
        named = ", ".join([*(f"'{k}', x.{k}" for k in order), *(f"'{k}', {e}" for k, e in fields.items())])
        order.extend(fields)
        return rows.withColumn("c", F.expr(f"transform(c, x -> named_struct({named}))"))

    both = "x.v rlike '[0-9]' AND x.v rlike '[a-zA-Z]'"
    three = "x.v rlike '[0-9]' AND x.v rlike '[a-z]' AND x.v rlike '[A-Z]'"
    code = f"""CASE WHEN NOT ({both}) THEN NULL WHEN x.v rlike '^[0-9a-f]+$' THEN 'hex' WHEN x.v rlike '^[0-9A-F]+$' THEN 'HEX' WHEN x.v rlike '^[A-Z2-7]+$' THEN 'b32'
        WHEN x.v rlike '^[a-z0-9]+$' THEN 'b36' WHEN x.v rlike '^[A-Z0-9]+$' THEN 'B36' WHEN NOT ({three}) THEN NULL WHEN x.v rlike '^[A-Za-z0-9]+$' THEN 'b62' WHEN x.v rlike '^[A-Za-z0-9+/]+$' THEN 'b64' WHEN x.v rlike '^[A-Za-z0-9_-]+$' THEN 'url' END"""
    alphabet = "CASE x.code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " END"
    only = lambda cls: f"(x.n - length(regexp_replace(x.v, '[{cls}]', '')))"
    df = given.withColumn("c", F.expr("transform(c, x -> named_struct('start', x.start, 'end', x.end, 'inside', x.inside, 'v', rtrim('=', x.value)))"))
    order.append("v")
    df = step(df, code=code).withColumn("c", F.expr("filter(c, x -> x.code IS NOT NULL)"))
    df = step(df, n="cast(length(x.v) AS double)", a=alphabet)
    df = step(df, k="cast(length(x.a) AS double)", i="transform(split(x.v, ''), s -> cast(locate(s, x.a) - 1 AS double))")
    df = step(df, squares="aggregate(transform(split(x.a, ''), s -> power(x.n - length(replace(x.v, s, '')), 2)), 0D, (p, q) -> p + q)", mean="aggregate(x.i, 0D, (p, q) -> p + q) / x.n", upper=only("A-Z"), lower=only("a-z"), digit=only("0-9"))
    df = step(
        df,
        high="cast(size(filter(x.i, s -> s >= x.k / 2)) AS double)",
        turns="aggregate(zip_with(slice(x.i, 1, size(x.i) - 1), slice(x.i, 2, size(x.i) - 1), (p, q) -> if((p >= x.k / 2) = (q >= x.k / 2), 0D, 1D)), 1D, (p, q) -> p + q)",
        cross="aggregate(zip_with(slice(x.i, 1, size(x.i) - 1), slice(x.i, 2, size(x.i) - 1), (p, q) -> (p - x.mean) * (q - x.mean)), 0D, (p, q) -> p + q)",
        spread="aggregate(x.i, 0D, (p, q) -> p + (q - x.mean) * (q - x.mean))",
        classes="""CASE x.code WHEN 'b32' THEN power(x.upper, 2) / (x.n * 26 / 32) + power(x.digit, 2) / (x.n * 6 / 32) - x.n
            WHEN 'b36' THEN power(x.lower, 2) / (x.n * 26 / 36) + power(x.digit, 2) / (x.n * 10 / 36) - x.n
            WHEN 'B36' THEN power(x.upper, 2) / (x.n * 26 / 36) + power(x.digit, 2) / (x.n * 10 / 36) - x.n
            WHEN 'b62' THEN power(x.upper, 2) / (x.n * 26 / 62) + power(x.lower, 2) / (x.n * 26 / 62) + power(x.digit, 2) / (x.n * 10 / 62) - x.n
            WHEN 'b64' THEN power(x.upper, 2) / (x.n * 26 / 64) + power(x.lower, 2) / (x.n * 26 / 64) + power(x.n - x.upper - x.lower, 2) / (x.n * 12 / 64) - x.n
            WHEN 'url' THEN power(x.upper, 2) / (x.n * 26 / 64) + power(x.lower, 2) / (x.n * 26 / 64) + power(x.n - x.upper - x.lower, 2) / (x.n * 12 / 64) - x.n
            ELSE power(x.digit, 2) / (x.n * 10 / 16) + power(x.n - x.digit, 2) / (x.n * 6 / 16) - x.n END""",
    )
    df = step(df, mu="2 * x.high * (x.n - x.high) / x.n + 1", df="if(x.code IN ('b62', 'b64', 'url'), 2D, 1D)")
    df = step(df, var="(x.mu - 1) * (x.mu - 2) / (x.n - 1)")
    p = [
        _chi("greatest(0D, x.squares * x.k / x.n - x.n)", "(x.k - 1)"),
        _chi("greatest(0D, x.classes)", "x.df"),
        f"if(x.var <= 0, 0D, 2 * {_tail('(abs(x.turns - x.mu) / sqrt(greatest(x.var, 1e-9D)))')})",
        f"if(x.spread <= 0, 0D, 2 * {_tail('(abs(x.cross / greatest(x.spread, 1e-9D) + 1 / x.n) * sqrt(x.n))')})",
    ]
    df = step(df, p=f"least(1D, 4 * least({', '.join(p)}))")
    return df.withColumn("c", F.expr(f"transform(c, x -> named_struct('start', x.start, 'end', x.end, 'inside', x.inside, 'hash', xxhash64(x.v), 'stratum', concat(x.code, ':', cast(floor(log2(x.n)) AS string)), 'bin', cast(least({BINS - 1}, floor(x.p * {BINS})) AS int)))"))


def thresholds(marked: DataFrame) -> dict[str, int]:
    """stratum -> least bin whose candidates are taken; a table of bounded size."""
    strings = marked.select(F.explode("c").alias("x")).select("x.stratum", "x.bin", "x.hash").distinct()
    strata: dict[str, list[int]] = {}
    for r in strings.groupBy("stratum", "bin").count().collect():  # encodings x lengths x bins
        strata.setdefault(r["stratum"], [0] * BINS)[r["bin"]] = r["count"]
    least = {}
    for stratum, counts in strata.items():
        true = min(sum(counts), (1 + sum(counts[BINS // 2 :])) / 0.5)
        for t in range(int(LEAST_P * BINS), BINS):
            above = sum(counts[t:])
            if above and 1 - true * (1 - t / BINS) / above <= FDR:
                least[stratum] = t
                break
    return least


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: array<struct<start, kind, end>>, kind an index of ``KINDS``, sorted."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = without(docs.columns, "base", "spans", *([] if keep_text else [text]))
    own = {c: free(docs.columns, f"_{i}") for i, c in enumerate(kept)}  # the battery's own columns may have any name of theirs
    strong = F.filter(matches(t, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 6)
    base = F.concat(strong, matches(t, ACCESS, "access"), matches(t, HEX, "hex"))
    base = F.array_sort(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    marked = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), base.alias("base"), matches(t, CANDIDATE, "random").alias("c"))
    flags = F.when(F.size("c") > 0, inside(F.col("c"), F.col("base"))).otherwise(F.array().cast("array<boolean>"))
    marked = marked.withColumn("c", F.zip_with("c", flags, lambda x, held: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), held.alias("inside"))))
    found = cut(battery(marked), "secrets")
    least = thresholds(found)
    limit = F.create_map(*(F.lit(x) for kv in least.items() for x in kv)) if least else F.lit(None).cast("map<string,int>")
    new = F.filter("c", lambda x: (x["bin"] >= limit[x["stratum"]]) & ~x["inside"])
    new = F.transform(new, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return found.select(*(F.col(n).alias(c) for c, n in own.items()), "base", F.array_sort(F.concat("base", new)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; a null text stays null."""
    found = find_secrets(docs, text)
    size = F.length(text)
    # spans may overlap: a gap starts where the spans before end, and lasts up to the next start
    ends = scan(F.transform("spans", lambda s: s["end"]), F.greatest, F.lit(0))
    starts, lows = F.concat(F.transform("spans", lambda s: s["start"]), F.array(size)), F.concat(F.array(F.lit(0)), ends)
    gaps = F.filter(F.zip_with(lows, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["b"] >= g["a"])
    few = F.array_join(F.transform(gaps, lambda g: F.substring(F.col(text), g["a"] + 1, g["b"] - g["a"])), mark)
    # a substring is looked for from the text's start: of a text with many gaps the characters are split once instead
    many = let(F.split(text, ""), lambda cs: F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(cs, g["a"] + 1, g["b"] - g["a"]), "")), mark))
    clean = F.when(F.size("spans") == 0, F.col(text)).when(F.size("spans") <= _PIECE, few).otherwise(many)
    return found.withColumn(text, clean).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))

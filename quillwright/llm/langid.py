"""Operator 3 — language identification by prediction by partial matching (PPM).

For each language a context tree over UTF-8 bytes, of order ``ORDER``, is counted on a sample of its labelled texts and
then frozen. A byte's probability in a context is PPM's, escape method C with exclusion: seen bytes share n / (n + d),
an escape with d / (n + d) leads to the next shorter context, without the bytes already seen; the last resort is uniform
over 256 bytes. A text's code length in a language is the exact sum over all its bytes.

The trees are compiled for array code: the contexts of a group of ``GROUP`` languages are one tree with a child table,
walked for all positions of many texts at once (a byte's cost depends on the ``ORDER`` bytes before it alone), and each node
has a row of costs (byte class x language). A language that lacks a node uses its own longest suffix of it, which is what PPM
does; a byte that no sample of the group has costs the same as any other such byte.

The sample is bounded: ``SAMPLE_BYTES`` bytes of texts a language, in the order of a hash of the text; equal texts are taken
once, so a group of copies doesn't fill it. Texts are taken whole, but for the first one, of which the first ``SAMPLE_BYTES``
bytes count; it is always in the sample, so no language is lost, however long its texts are. Each group of languages is fitted
in an executor's task and written to the shared folder, where the workers map it: neither the driver nor a broadcast holds it,
and its size is bounded by the samples' bytes (a context is kept from ``LEAST`` occurrences).

``score`` is the posterior of the predicted language given even priors and code lengths at ``1 / TEMPER`` of their weight
a byte. Defined results: null text, or no letter in it — ``und``, 0; no labelled text — ``und``, 0 for all; ties — the
language that sorts first; a null or empty ``lang`` isn't learned from; very long texts are scored whole, in pieces that overlap by
``ORDER`` bytes; repeated rows — equal results; extra columns are kept, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Mapped, field, free, id_text, new_folder, without, write_file

ORDER, LEAST, SAMPLE_BYTES, TEMPER, GROUP = 4, 6, 400_000, 32.0, 4


class ByteContextTrees:
    """Frozen context trees of a group of languages, compiled to arrays."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST) -> None:
        self.langs, self.order = sorted(samples), order
        texts = {l: [np.frombuffer(t, np.uint8) for t in samples[l] if t] for l in self.langs}
        used = np.unique(np.concatenate([np.empty(0, np.uint8), *(x for v in texts.values() for x in v)]))
        # bytes seen in no sample cost the same everywhere: one class stands for each of them
        self.classes = np.zeros(256, np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width, self.unseen = len(used) + 1, 256 - len(used)
        grams = {l: self._grams(texts[l]) for l in self.langs}
        self._compile(grams, least)

    def _grams(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For k = 0..order: distinct (context of k classes, next class) as mixed-radix numbers, and counts.

        The nearest context byte is the lowest digit but one, so that a context's suffix is its number modulo width^j.
        """
        w, out = self.width, []
        coded = [self.classes[t].astype(np.int64) for t in texts]
        for k in range(self.order + 1):
            parts = [sum(t[k - j : len(t) - j] * w**j for j in range(k + 1)) for t in coded if len(t) > k]
            out.append(np.unique(np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True))
        return out

    def _compile(self, grams: dict, least: int) -> None:
        w, n_lang = self.width, len(self.langs)
        size = np.ones(w)
        size[0] = self.unseen
        levels = []  # for each order: language -> context number -> its range among the language's grams
        for k in range(1, self.order + 1):
            per = []
            for l in self.langs:
                keys, counts = grams[l][k]
                ctx = keys // w
                starts = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.empty(0, np.int64)
                ends = np.append(starts[1:], len(ctx)) if len(starts) else starts
                total = np.add.reduceat(counts, starts) if len(starts) else np.empty(0, np.int64)
                per.append({int(ctx[a]): (a, b) for a, b, t in zip(starts, ends, total, strict=True) if t >= least})
            levels.append(per)
        nodes = 1 + sum(len(set().union(*per)) for per in levels)
        self.children = np.zeros((nodes, w), np.int32)
        p = np.empty((nodes, w, n_lang), np.float32)  # probabilities of one byte of each class, then costs
        for i, l in enumerate(self.langs):
            p[0, :, i] = self._node(grams[l][0], 0, np.full(w, 1 / 256), size)
        level, node = {0: 0}, 1  # context number -> node; a context's suffix has at least as many occurrences, so it has a node
        for k, per in enumerate(levels, 1):
            after = {}
            for c in sorted(set().union(*per)):
                parent = level[c % w ** (k - 1)]
                p[node] = p[parent]
                for i, l in enumerate(self.langs):
                    if c in per[i]:
                        a, b = per[i][c]
                        p[node, :, i] = self._node((grams[l][k][0][a:b], grams[l][k][1][a:b]), c, p[parent, :, i].astype(np.float64), size)
                self.children[parent, c // w ** (k - 1)] = node
                after[c] = node
                node += 1
            level = after
        np.negative(np.log2(p, out=p), out=p)
        self.costs = p.reshape(-1, n_lang)

    @classmethod
    def mapped(cls, maps: Mapped, path: str, langs: list[str], order: int) -> ByteContextTrees:
        """Trees that ``write`` has stored."""
        self = cls.__new__(cls)
        self.langs, self.order = langs, order
        self.classes = maps.array(f"{path}.classes", np.uint16)
        self.width = int(self.classes.max()) + 1
        self.children = maps.array(f"{path}.children", np.int32).reshape(-1, self.width)
        self.costs = maps.array(f"{path}.costs", np.float32).reshape(-1, len(langs))
        return self

    def write(self, path: str) -> None:
        write_file(f"{path}.classes", self.classes.tobytes())
        write_file(f"{path}.children", memoryview(self.children).cast("B"))
        write_file(f"{path}.costs", memoryview(np.ascontiguousarray(self.costs)).cast("B"))

    def _node(self, gram: tuple[np.ndarray, np.ndarray], ctx: int, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Method C with exclusion: probabilities of one byte of each class, given those of the shorter context."""
        symbols, counts = gram[0] - ctx * self.width, gram[1]
        if not len(symbols):
            return low
        n, d = counts.sum(), len(symbols)
        seen = np.zeros(self.width, bool)
        seen[symbols] = True
        rest = float((low * size)[~seen].sum())
        p = np.where(seen, 0.0, low / rest * (d / (n + d))) if rest > 0 else np.zeros(self.width)
        p[symbols] = counts / (n + d if rest > 0 else n)
        return np.maximum(p, 1e-12)

    def code_lengths(self, texts: list) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        piece = 1 << 20
        batch, owner, size = [], [], 0

        def flush() -> None:
            if not batch:
                return
            data = np.concatenate(batch)
            lead = np.concatenate([np.arange(len(b)) for b in batch])
            node = np.zeros(len(data), np.int32)
            alive = np.ones(len(data), bool)
            for j in range(1, self.order + 1):
                back = np.concatenate((np.zeros(min(j, len(data)), data.dtype), data[:-j]))
                step = self.children[node, back]
                alive &= (lead >= j) & (step > 0)
                node = np.where(alive, step, node)
            cost = self.costs[node.astype(np.int64) * self.width + data]
            ends = np.cumsum([len(b) for b in batch])
            for i, (o, skip) in enumerate(owner):
                out[o] += cost[ends[i] - len(batch[i]) + skip : ends[i]].sum(axis=0, dtype=np.float64)
            batch.clear()
            owner.clear()

        for k, t in enumerate(texts):
            x = self.classes[np.frombuffer(t or b"", np.uint8)]
            for lo in range(0, len(x), piece):
                skip = min(lo, self.order)
                batch.append(x[lo - skip : lo + piece])
                owner.append((k, skip))
                size += len(batch[-1])
                if size >= piece:
                    flush()
                    size = 0
        flush()
        return out


class Languages:
    """A fitted model: groups of languages in order, and the folder that holds their trees."""

    def __init__(self, folder: str, groups: dict[int, list[str]], order: int) -> None:
        self.folder, self.groups, self.order = folder, groups, order
        self.langs = [l for g in sorted(groups) for l in groups[g]]

    def trees(self, maps: Mapped) -> list[ByteContextTrees]:
        return [ByteContextTrees.mapped(maps, f"{self.folder}/{g:06d}", self.groups[g], self.order) for g in sorted(self.groups)]


def predict(trees: list[ByteContextTrees], texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and bits a byte in the language of choice."""
    langs = [l for t in trees for l in t.langs]
    bits = np.concatenate([t.code_lengths(texts) for t in trees], axis=1)
    n = np.maximum(1, np.array([len(t or b"") for t in texts]))
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(texts)), best]
    odds = np.exp2(np.maximum(-1000, (least[:, None] - bits) / TEMPER)).sum(axis=1)
    return [langs[i] for i in best], 1 / odds, least / n


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, order: int = ORDER, least: int = LEAST, group: int = GROUP) -> Languages | None:
    """Fit on texts of each language, up to ``sample_bytes``; None where there is nothing to learn from."""
    named = labelled.filter(F.col(lang).isNotNull() & (F.col(lang) != "") & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    named = named.withColumn("h", F.xxhash64("text"))
    found = sorted((r["lang"], r["b"], r["h"]) for r in named.groupBy("lang").agg(F.sum(F.octet_length("text").cast("double")).alias("b"), F.min("h").alias("h")).collect())
    if not found:
        return None
    per = lambda values: F.create_map(*(F.lit(x) for (l, *_), v in zip(found, values, strict=True) for x in (l, v)))[F.col("lang")]
    # a hash range that holds about twice the bytes needed, and the text with the least hash
    share = per(min(1.0, 2 * sample_bytes / b) for _, b, _ in found)
    near = named.filter(((F.col("h").cast("double") / 2.0**63 + 1) / 2 <= share) | (F.col("h") == per(h for *_, h in found)))
    near = near.withColumn("text", F.expr(f"substring(text, 1, {sample_bytes})")).dropDuplicates(["lang", "h"])
    folder = new_folder(labelled.sparkSession, "languages")

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        samples: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}
        for r in table.sort_by([("lang", "ascending"), ("h", "ascending")]).to_pylist():
            if held.get(r["lang"], 0) < sample_bytes:
                samples.setdefault(r["lang"], []).append(r["text"])
                held[r["lang"]] = held.get(r["lang"], 0) + len(r["text"])
        trees = ByteContextTrees(samples, order, least)
        trees.write(f"{folder}/{key[0].as_py():06d}")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "langs": pa.array([trees.langs], pa.list_(pa.string()))})

    parts = near.withColumn("part", per(i // group for i in range(len(found))).cast("int")).groupBy("part").applyInArrow(learn, "part int, langs array<string>")
    return Languages(folder, {r["part"]: r["langs"] for r in parts.collect()}, order)


def identify(docs: DataFrame, model: Languages | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (columns of these names are replaced)."""
    added = ["lang_pred", "score", "bits_per_byte"]
    kept, own = without(docs.columns, *added), free(docs.columns, "bytes")
    given = docs.select(*kept, F.when(F.col(text).rlike("\\p{L}"), F.col(text)).cast("binary").alias(own))
    if model is None:
        return given.drop(own).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    schema = ", ".join([*(field(f) for f in given.schema if f.name != own), "lang_pred string, score double, bits_per_byte double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Mapped() as maps:
            trees = model.trees(maps)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    texts = part.column(part.num_columns - 1).to_pylist()
                    null = np.array([t is None for t in texts])
                    langs, score, bits = predict(trees, texts)
                    cols = [pa.array(["und" if z else l for l, z in zip(langs, null, strict=True)]), pa.array(np.where(null, 0.0, score)), pa.array(bits, mask=null)]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *cols], names=[*kept, *added])

    return given.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(id_text()) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")

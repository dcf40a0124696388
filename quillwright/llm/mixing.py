"""Operator 7 — mixing sources to target weights by soft membership.

1. Domains come from the table of labels: ``toxic`` (toxic = 1), ``high`` and ``low`` (quality 1 and 0, not toxic). A
   multinomial logistic model is fitted on a bounded sample of labelled documents (``SAMPLE`` rows, in the order of a hash
   of the id) over hashed words and a few figures of the text's form, and predicts every document's domain posteriors. It is
   fitted in one executor's task, which gets the sample's hashed words and not its texts, and lies in the shared folder.
2. Document rates r >= 0 are fitted so that expected domain token totals, sum over d of r_d n_d q_dk, match the targets:
   least squares with weight 1 / (present total)^2 a domain (of ``LEAST_SHARE`` of all tokens at least), and ``RIDGE`` times the mean over tokens of (r - 1)^2, which
   makes the optimum unique (without it, targets out of reach put all tokens on a few extreme documents).
   The method is projected gradient with lazy projection: the accumulated gradient is one number for each domain, ``pull``, and
   a document's rate is the projection max(0, 1 - q . pull), so no per-document state is stored or replayed. A step's
   direction is the residual, scaled by the Gram matrix of the documents whose rate is positive; its length is the best of
   ``LENGTHS``, which are tried in one pass, by the (convex) function whose gradient is followed. A pass is one aggregate over a narrow
   table (tokens, posteriors); only sums reach the driver. Steps end when the optimality conditions (KKT) hold to ``TOLERANCE`` of
   all tokens, or when no length makes progress any more (rounding); what was reached is returned.

Defined results: null or empty text — no token, posteriors of an empty text, a rate that counts for nothing; no labels — even
posteriors; no token at all — rate 1; null label values or ids — not learned from; several labels of one document — the first in
the order (toxic, low, high); repeated rows — equal rates; extra columns are kept, but for those named like a result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Mapped, WordHashes, cut, field, free, new_folder, without, words_of, write_file

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.65, "low": 0.35, "toxic": 0.0}
SAMPLE, BITS, RIDGE, TOLERANCE, LEAST_SHARE = 12_000, 18, 1e-2, 1e-7, 0.01
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.005)
_FORM = 10
_MARKS = string.punctuation.encode()


def form(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Figures of a text's form: shares of upper case, digits and marks, repetition, length."""
    n, k = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()))
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    lines = raw.split(b"\n")
    distinct = len(set(words)) / k
    return np.array([1.0, 5 * seen[65:91].sum() / letters, 5 * seen[48:58].sum() / n, 5 * marks / n, distinct, max(0.0, 0.3 - distinct) * 5, len(set(lines)) / len(lines), np.log(k + 1) / 5, min(2.0, n / k / 8), float(k < 20)])


def features(texts: list, memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot) pairs of distinct hashed words, the texts' form figures and token counts."""
    words = [words_of(t) for t in texts]
    n = np.array(list(map(len, words)), np.int64)
    flat = [w.strip(_MARKS) for ws in words for w in ws]
    slot = memo.of(flat) >> np.uint64(64 - BITS)
    pairs = np.unique((np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(BITS)) | slot)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), np.array([form(t or b"", w) for t, w in zip(texts, words, strict=True)]).reshape(-1, _FORM), n


class SoftClassifier:
    """Multinomial logistic model; weights of hashed words (float32) and of the form figures."""

    def __init__(self, domains: tuple[str, ...] = DOMAINS) -> None:
        self.domains = domains
        self.words, self.shape = np.zeros((1 << BITS, len(domains)), np.float32), np.zeros((_FORM, len(domains)))

    def logits(self, row: np.ndarray, slot: np.ndarray, figures: np.ndarray) -> np.ndarray:
        out = figures @ self.shape
        w = self.words[slot]
        for k in range(len(self.domains)):
            out[:, k] += np.bincount(row, w[:, k], minlength=len(figures))
        return out

    @staticmethod
    def posteriors(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, row: np.ndarray, slot: np.ndarray, figures: np.ndarray, labels: np.ndarray, epochs: int = 150, rate: float = 0.3, decay: float = 1.0, strength: float = 40.0) -> SoftClassifier:
        """Learn from (text, slot) pairs, the texts' form figures and their domains."""
        if not len(labels):
            return self
        k = len(self.domains)
        # words whose presence depends on the domain (chi-squared, one domain against the rest); others would be noise
        have = np.stack([np.bincount(slot, labels[row] == j, minlength=1 << BITS) for j in range(k)], axis=1)
        df, size = have.sum(axis=1, keepdims=True), np.bincount(labels, minlength=k)[None, :]
        expected = df * size / len(labels)
        chi = (have - expected) ** 2 / np.maximum(1e-9, expected * (1 - size / len(labels)) * (1 - df / len(labels)))
        telling = (df[:, 0] >= 6) & (chi.max(axis=1) >= strength)
        row, slot = row[telling[slot]], slot[telling[slot]]
        used, at = np.unique(slot, return_inverse=True)
        share = np.bincount(labels, minlength=k)
        weight_of = (len(labels) / (max(1, (share > 0).sum()) * np.maximum(1, share))) ** 0.5  # rare domains count more
        want, weight = np.eye(k)[labels], weight_of[labels][:, None]
        w, s = np.zeros((len(used), k)), np.zeros((_FORM, k))
        gw, gs = np.full(w.shape, 1e-8), np.full(s.shape, 1e-8)
        for _ in range(epochs):  # AdaGrad on the whole sample
            z = figures @ s + np.stack([np.bincount(row, w[at, j], minlength=len(labels)) for j in range(k)], axis=1)
            error = (self.posteriors(z) - want) * weight / len(labels)
            d = np.stack([np.bincount(at, error[row, j], minlength=len(used)) for j in range(k)], axis=1) + decay * w / len(labels)
            f = figures.T @ error + decay * s / len(labels)
            gw += d * d
            gs += f * f
            w -= rate * d / np.sqrt(gw)
            s -= rate * f / np.sqrt(gs)
        s[0] -= np.log(weight_of)  # figures[0] is 1: posteriors of the sample's own shares, not of the weighted ones
        self.words[used], self.shape = w, s
        return self


    def write(self, path: str) -> None:
        write_file(f"{path}.words", self.words.tobytes())
        write_file(f"{path}.shape", self.shape.tobytes())

    @classmethod
    def mapped(cls, maps: Mapped, path: str, domains: tuple[str, ...] = DOMAINS) -> SoftClassifier:
        self = cls.__new__(cls)
        self.domains, k = domains, len(domains)
        self.words, self.shape = maps.array(f"{path}.words", np.float32).reshape(-1, k), maps.array(f"{path}.shape", np.float64).reshape(-1, k)
        return self


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, text: str = "text", key: str = "doc_id") -> str:
    """Fit on at most ``rows`` labelled ids' texts, in the order of a hash of the id; returns where the model lies."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    known = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).select(F.col(key).alias("id"), domain.alias("domain")).dropna()
    # the smallest hashes: at most ``rows`` pairs of numbers, so broadcasting them is safe at any size
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))
    path = f"{new_folder(docs.sparkSession, 'mixing-model')}/model"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, slot, figures, _ = features(part.column(1).cast(pa.binary()).to_pylist(), memo)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                slots = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2).cast(pa.int32()), pa.array(slots, pa.binary()), pa.array([f.tobytes() for f in figures], pa.binary())], names=["id", "domain", "slots", "figures"])

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        slots = [np.frombuffer(x, np.int32) for x in table.column("slots").to_pylist()]
        row = np.repeat(np.arange(len(slots), dtype=np.int32), [len(x) for x in slots])
        figures = np.frombuffer(b"".join(table.column("figures").to_pylist()), np.float64).reshape(-1, _FORM)
        SoftClassifier().fit(row, np.concatenate(slots), figures, table.column("domain").to_numpy()).write(path)
        return pa.table({"n": pa.array([len(slots)], pa.int64())})

    sample = found.mapInArrow(extract, "id bigint, domain int, slots binary, figures binary")
    if not sample.groupBy().applyInArrow(learn, "n bigint").collect():
        SoftClassifier().write(path)
    return path


def with_posteriors(docs: DataFrame, model: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens and q_<domain> (columns of these names are replaced); ``model`` is a place of ``fit_classifier``."""
    added = ["n_tokens", *(f"q_{d}" for d in DOMAINS)]
    kept, own = without(docs.columns, *added, *([] if keep_text else [text])), free(docs.columns, "bytes")
    given = docs.select(*kept, F.col(text).alias(own))
    schema = ", ".join([*(field(f) for f in given.schema if f.name != own), "n_tokens bigint", *(f"q_{d} double" for d in DOMAINS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        with Mapped() as maps:
            m = SoftClassifier.mapped(maps, model)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    row, slot, figures, n = features(part.column(part.num_columns - 1).cast(pa.binary()).to_pylist(), memo)
                    q = m.posteriors(m.logits(row, slot, figures))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(n), *(pa.array(q[:, k]) for k in range(q.shape[1]))], names=[*kept, *added])

    return given.mapInArrow(run, schema)


def rate_column(pull: np.ndarray, domains: tuple[str, ...] = DOMAINS) -> Column:
    """A document's rate: 1 less the accumulated gradient along its posteriors, projected on r >= 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"q_{d}") * float(p) for d, p in zip(domains, pull, strict=True)), F.lit(0.0)))


def fit_rates(table: DataFrame, targets: dict[str, float], domains: tuple[str, ...] = DOMAINS, relative: bool = False, ridge: float = RIDGE) -> tuple[np.ndarray, dict]:
    """The fitted pull over ``table`` (n_tokens, q_*), and what it reaches.

    Targets are shares of the present token total or, if ``relative``, multiples of each domain's own present total.
    """
    n, q, k = F.col("n_tokens").cast("double"), [F.col(f"q_{d}") for d in domains], len(domains)

    def look(pulls: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Of each pull: reached totals, Gram matrix of the documents with a positive rate, sum of n r^2 / 2. One pass."""
        rows = table.select(n.alias("n"), *q, F.array(*(rate_column(p, domains) for p in pulls)).alias("r"))
        cols = []
        for c in range(len(pulls)):
            r = F.col("r")[c]
            live = F.when(r > 0, F.col("n")).otherwise(0.0)
            cols += [F.sum(F.col("n") * r * q[i]) for i in range(k)] + [F.sum(live * q[i] * q[j]) for i in range(k) for j in range(k)] + [F.sum(F.col("n") * r * r / 2)]
        got = np.array([x or 0.0 for x in rows.agg(*cols).first()]).reshape(len(pulls), -1)
        return [(g[:k], g[k:-1].reshape(k, k), float(g[-1])) for g in got]

    pull = np.zeros(k)
    (reached, gram, energy), = look([pull])
    now, total = reached, reached.sum()
    want = np.array([targets[d] for d in domains]) * (now if relative else total)
    if total <= 0:
        return pull, {"totals": now, "targets": want, "present": 0.0, "kkt": 0.0, "steps": 0}
    slack = ridge / total * np.maximum(now, LEAST_SHARE * total) ** 2  # ridge / (total weight), a domain
    value = lambda p, e: e + p @ want + p @ (slack * p) / 2  # noqa: E731  convex; its gradient is followed downwards
    steps = 0
    while np.abs(gradient := want - reached + slack * pull).max() > TOLERANCE * total:
        direction = np.linalg.solve(gram + np.diag(slack), gradient)
        tried = [pull - s * direction for s in LENGTHS]
        seen = look(tried)
        best = min(range(len(tried)), key=lambda i: value(tried[i], seen[i][2]))
        if value(tried[best], seen[best][2]) >= value(pull, energy):
            break
        pull, (reached, gram, energy) = tried[best], seen[best]
        steps += 1
    return pull, {"totals": reached, "targets": want, "present": float(total), "kkt": float(np.abs(want - reached + slack * pull).max() / total), "steps": steps}


def totals_without(table: DataFrame, gone: str, domains: tuple[str, ...] = DOMAINS) -> dict[str, float]:
    """Targets relative to the present totals: what the documents hold whose likeliest domain is not ``gone``."""
    q = {d: F.col(f"q_{d}") for d in domains}
    stay = q[gone] < F.greatest(*q.values()) if len(q) > 1 else F.lit(False)
    cols = [F.sum(F.col("n_tokens") * q[d]) for d in domains] + [F.sum(F.when(stay, F.col("n_tokens") * q[d])) for d in domains]
    got = [x or 0.0 for x in table.agg(*cols).first()]
    return {d: got[len(domains) + i] / got[i] if got[i] else 1.0 for i, d in enumerate(domains)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", keep_text: bool = True, relative: bool = False, gone: str | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with n_tokens, q_<domain>, rate, and what the rates reach: reached_<domain> (share of the present total) and kkt.

    ``gone``: a domain whose documents are to go; the targets are then ``totals_without`` it.
    """
    table = cut(with_posteriors(docs, fit_classifier(docs, labels, text=text, key=key), text, keep_text), "mixing")
    if gone:
        targets, relative = totals_without(table, gone), True
    pull, found = fit_rates(table, targets, relative=relative)
    shares = {f"reached_{d}": F.lit(float(x / max(1.0, found["present"]))) for d, x in zip(DOMAINS, found["totals"], strict=True)}
    return table.withColumns({"rate": rate_column(pull), **shares, "kkt": F.lit(found["kkt"])})


def draw(rated: DataFrame, seed: int = 7, keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Each row floor(rate) times, and once more with the rate's rest for probability, by a seeded hash of ``keys``.

    Expected token totals are those of the rates. ``rate`` is dropped.
    """
    copy, chance = free(rated.columns, "copy"), F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / float(1 << 53)
    copies = F.floor("rate").cast("int") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    return rated.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).drop(copy, "rate")


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False).select("doc_id", "n_tokens", *(f"q_{d}" for d in DOMAINS), "rate", *(f"reached_{d}" for d in DOMAINS), "kkt")

"""Operator 9 — SentencePiece models on the tokenizers library.

``SentencePieceModel`` parses the model's protobuf itself (wire format, no generated classes) and rebuilds the pipeline
from it: normaliser (the precompiled character map, if any; removal of extra white space; the dummy prefix; white space
escaped to the metaspace marker), pieces with their unigram scores, or for a BPE model the merges that those scores imply,
and byte fallback. Texts are encoded in batches on several threads.

A piece with a marker after another character does not exist in most vocabularies (this is verified when a model is
loaded); no merge or piece then crosses the start of a run of markers, texts are split there into chunks. If such a piece exists, texts are encoded unsplit.

A task encodes each distinct chunk that it meets once, in batches, and a text's ids are those of its chunks, in order. Every whole
text is encoded with the sentencepiece library too; where the ids differ, the text is encoded once more, unsplit. ``parity`` tells
whether the two libraries agree on the whole text. ``decoded`` comes from the text's ids alone: pieces with the marker as a space,
byte pieces as bytes, without the dummy prefix; ``roundtrip`` tells whether it is the normalised text.

Defined results: null — null ids, zero tokens, ``roundtrip`` null; empty text — no token; unknown characters — bytes, or
the unknown piece in a model without byte fallback (``roundtrip`` is then false); repeated rows — equal results; extra
columns are kept.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, free, ranges, without

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers for varints, bytes for everything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class SentencePieceModel:
    """What an encoder needs of a ModelProto."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id, self.unk_surface, self.suffix = UNIGRAM, False, 0, " ⁇ ", False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for k, v in fields(value):
                    if k == 3:
                        self.kind = v
                    elif k == 24:
                        self.suffix = bool(v)
                    elif k == 35:
                        self.byte_fallback = bool(v)
                    elif k == 40:
                        self.unk_id = v
                    elif k == 44:
                        self.unk_surface = v.decode()
            elif number == 3:
                for k, v in fields(value):
                    if k == 2:
                        self.charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), self.unk_id)
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def merges(self) -> list[tuple[str, str]]:
        """A BPE model's merges: each way to split a piece into two pieces, best score first."""
        rank = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece, r in rank.items():
            parts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
            found += [(r, rank[a], rank[b], (a, b)) for a, b in parts]
        return [x[3] for x in sorted(found)]

    def tokenizer(self):
        """The equal pipeline of the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=1_000)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram (1) nor BPE (2)")
        if self.suffix:
            raise ValueError("white space as a suffix is not supported")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t = Tokenizer(model)
        t.normalizer = normalizers.Sequence(steps)
        if self.splits:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        last = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        t.decoder = decoders.Sequence(last + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return t

    def normalise(self, text: str) -> str:
        """The text that decoding has to give back, for models without a character map."""
        return re.sub(" {2,}", " ", text.strip(" ")) if self.squeeze else text

    def surfaces(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                out.append(self.unk_surface.encode() if kind == UNKNOWN else b"")
            else:
                out.append(piece.replace(MARK, " ").encode() if self.escape else piece.encode())
        return out


def load(path: str = MODEL) -> SentencePieceModel:
    with open(path, "rb") as f:
        return SentencePieceModel(f.read())


class Codec:
    """Encodes and decodes texts and verifies both, in a task of a Python worker."""

    def __init__(self, data: bytes, threads: int, bound: int = 100_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model, self.threads, self.bound = SentencePieceModel(data), threads, bound
        self.own = self.model.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        self.by_chunk = m.splits and m.dummy_prefix and m.escape and not (m.charsmap or m.squeeze)
        self.starts = np.array([p[0].startswith(MARK) for p in m.pieces])
        self.mark = [i for i, p in enumerate(m.pieces) if p[0] == MARK]
        shown = m.surfaces()
        self.shown, self.size = np.frombuffer(b"".join(shown), np.uint8), np.array(list(map(len, shown)), np.int64)
        self.shown_at = np.cumsum(self.size) - self.size
        self.clear()

    def clear(self) -> None:
        """Forget all chunks. A chunk's index gives its ids."""
        self.index: dict[str, int] = {}
        self.flat, self.first, self.n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, chunks: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.index.update(zip(chunks, range(len(self.n), len(self.n) + len(chunks)), strict=True))
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(n) - n))
        self.flat, self.n = np.concatenate((self.flat, ids)), np.concatenate((self.n, n))

    def encode(self, texts: list[str]) -> list[list[int]]:
        got = [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        # the dummy prefix alone is no token of a text that is empty once normalised
        return [x if self.model.normalise(t) else [] for t, x in zip(texts, got, strict=True)]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Texts of ids that stand one after another, ``n`` for each text."""
        data = self.shown[ranges(self.shown_at[ids], self.size[ids])].tobytes()
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))[np.concatenate(([0], np.cumsum(n)))].tolist()
        prefix = b" " if self.model.dummy_prefix else b""
        return [data[a:b].removeprefix(prefix) for a, b in zip(ends, ends[1:], strict=False)]

    def _learn(self, texts: list[str]) -> None:
        """Encode chunks that haven't been met yet.

        Chunks go to the library many at a time, joined by spaces: a chunk's first piece is the only one that starts
        with the marker. Where that isn't so, the chunks are encoded one by one.
        """
        plain, alone = [t for t in texts if t and t[0] != " "], [t for t in texts if not t or t[0] == " "]
        groups = [plain[k : k + 512] for k in range(0, len(plain), 512)]
        good, parts, sizes = [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for group, a in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            a = np.array(a, np.int32)
            first = np.flatnonzero(self.starts[a])
            if len(first) == len(group):
                good += group
                parts.append(a)
                sizes.append(np.diff(np.append(first, len(a))))
            else:
                alone += group
        self.add(good, np.concatenate(parts), np.concatenate(sizes))
        if alone:
            ids = self.encode(alone)
            self.add(alone, np.array(list(itertools.chain.from_iterable(ids)), np.int32), np.array(list(map(len, ids)), np.int64))

    def _by_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.bound:
            self.clear()
        # a chunk is a run of spaces and what follows it, without its first space; the dummy prefix is the first chunk's
        chunks = [[x[1:] for x in _CHUNK.findall(" " + t)] if "  " in t or t[:1] == " " or t[-1:] == " " else t.split(" ") if t else [] for t in texts]
        if "" not in self.index:
            self.add([""], np.array(self.mark, np.int32), np.array([len(self.mark)]))  # inside a text
        self._learn(list({c for cs in chunks for c in cs}.difference(self.index)))
        many = np.array(list(map(len, chunks)), np.int64)
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, count=int(many.sum()))
        n = np.bincount(np.repeat(np.arange(len(texts)), many), self.n[at], minlength=len(texts)).astype(np.int64)
        return self.flat[ranges(self.first[at], self.n[at])], n

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """All texts' ids one after another and their numbers, and of each text its decoded form, roundtrip and parity."""
        plain = [t.replace(MARK, " ") for t in texts]  # the model reads a marker in a text as a space
        want = self.other.encode(texts, num_threads=self.threads, return_type="numpy")
        want_n, want_ids = np.array(list(map(len, want)), np.int64), np.concatenate([np.empty(0, np.int32), *want])
        if self.by_chunk:
            ids, n = self._by_chunks(plain)
        else:
            got = self.encode(plain)
            n = np.array(list(map(len, got)), np.int64)
            ids = np.fromiter(itertools.chain.from_iterable(got), np.int32, count=int(n.sum()))
        parity = _equal(ids, n, want_ids, want_n)
        if self.by_chunk and not parity.all():
            ends, odd = np.cumsum(n), np.flatnonzero(~parity).tolist()
            each = [ids[e - k : e] for e, k in zip(ends, n, strict=True)]
            for i, x in zip(odd, self.encode([plain[i] for i in odd]), strict=True):
                each[i] = np.array(x, np.int32)
            ids, n = np.concatenate(each), np.array(list(map(len, each)), np.int64)
            parity = _equal(ids, n, want_ids, want_n)
        back = self.decode(ids, n)
        return ids, n, back, np.array([b == self.model.normalise(t).encode() for t, b in zip(plain, back, strict=True)], bool), parity


def _equal(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Of each text, whether its ids are the same in both."""
    same = a_n == b_n
    a, b = a[np.repeat(same, a_n)], b[np.repeat(same, b_n)]
    owner = np.repeat(np.flatnonzero(same), a_n[same])
    same[owner[a != b]] = False
    return same


_CHUNK = re.compile(" +[^ ]*")


def encode_decode(docs: DataFrame, text: str = "text", model: bytes | None = None, threads: int = 2) -> DataFrame:
    """``docs`` with ids, n_tokens, n_byte_tokens, decoded, roundtrip and parity (columns of these names are replaced)."""
    data = load_bytes() if model is None else model
    added = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int32(), "n_byte_tokens": pa.int32(), "decoded": pa.string(), "roundtrip": pa.bool_(), "parity": pa.bool_()}
    kept, hidden = without(docs.columns, *added), free(docs.columns, "bytes")
    given = docs.select(*kept, F.col(text).alias(hidden))
    schema = ", ".join([*(field(f) for f in given.schema if f.name != hidden), "ids array<int>, n_tokens int, n_byte_tokens int, decoded string, roundtrip boolean, parity boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, threads)
        is_byte = np.array([kind == BYTE for _, _, kind in codec.model.pieces])
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = part.column(part.num_columns - 1).to_pylist()
                null = np.array([t is None for t in texts])
                flat, n, back, same, parity = codec.run([t or "" for t in texts])
                ends = np.concatenate(([0], np.cumsum(n)))
                n_bytes = np.diff(np.concatenate(([0], np.cumsum(is_byte[flat])))[ends])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null))
                cols = [ids, pa.array(n, pa.int32()), pa.array(n_bytes, pa.int32()), pa.array([None if z else b.decode(errors="replace") for b, z in zip(back, null, strict=True)], pa.string()), pa.array(same, pa.bool_(), mask=null), pa.array(parity, pa.bool_(), mask=null)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *cols], names=[*kept, *added])

    return given.mapInArrow(run, schema)


def load_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs).select(
        "doc_id", "n_tokens", "n_byte_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "roundtrip", "parity"
    )

"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; from it come the normaliser, the metaspace marker, the merges of a BPE model or the scores of a
unigram model, and byte fallback. Batches are encoded by the library's own threads. Where no piece of the vocabulary reaches over
the start of a run of markers, a text is the sum of its marked words, and a worker encodes each distinct word once, holding
it against the sentencepiece library the first time.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, need_columns, ship, text_or_empty
from .tokens import WordCache, packed, public_tokenizer

MARK = "\u2581"
# fixed values: kinds of pieces and of models in the protobuf
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_marker: bool = False

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value, a number for varints and bytes for the rest."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value = data[at : at + n]
            at += n
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """A model from the bytes of its file. Fields that are not set have the defaults of the public schema."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.byte_fallback, m.suffix_marker = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models have merges or scores to rebuild")
    if m.suffix_marker or not m.escape or any(p[2] == UNUSED for p in m.pieces):
        raise ValueError("markers after words, unescaped white space and unused pieces are not supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, those of better score first, as the library ranks merges."""
    known = {p: (s, i) for i, (p, s, k) in enumerate(m.pieces) if k in (NORMAL, USER_DEFINED)}
    pairs = [(-s, i, cut, p[:cut], p[cut:]) for p, (s, i) in known.items() for cut in range(1, len(p)) if p[:cut] in known and p[cut:] in known]
    return [(a, b) for *_, a, b in sorted(pairs)]


def separable(m: Model) -> bool:
    """Whether a text is the sum of its marked words: no piece has a marker after another character, or several before one."""
    return not any(MARK in p.lstrip(MARK) or re.match(f"{MARK}{{2,}}[^{MARK}]", p) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED)) and not any(k == USER_DEFINED for _, _, k in m.pieces)


def build(m: Model, normalise: bool = True):
    """A tokenizers.Tokenizer equal to the model; without normalise it takes texts that are normalised already."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        t = Tokenizer(models.BPE(vocab, merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        # control and byte pieces never come from a text: a score this low keeps the search off them
        t = Tokenizer(models.Unigram([(p, s if k in (NORMAL, USER_DEFINED) else -1e6) for p, s, k in m.pieces], m.unk, m.byte_fallback))
    if own := [p for p, _, k in m.pieces if k == USER_DEFINED]:
        t.add_tokens([AddedToken(p, normalized=False) for p in own])
    if normalise:
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        steps += [normalizers.Prepend(MARK)] * m.dummy_prefix + [normalizers.Replace(" ", MARK)]
        t.normalizer = normalizers.Sequence(steps)
    if m.kind == BPE and separable(m):  # words part as they would anyway; long runs of markers fill the longest piece first
        longest = max([1, *(len(p) for p, _, _ in m.pieces if set(p) == {MARK})])
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}{{{longest}}}(?={MARK})|(?<=[^{MARK}])(?={MARK})"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * m.dummy_prefix])
    return t


class Codec:
    """encode and decode whole texts, held against the sentencepiece library; bad has the words whose ids it has otherwise."""

    def __init__(self, path: str, verify: bool = True, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))  # of the task, beside the other tasks of the executor
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = m = parse(data)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.whole = build(m)
        self.words = build(m, normalise=False)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        self.bad: set[str] = set()
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.simple = not m.charsmap and not m.remove_extra
        # words can be held against the peer one by one if it does to a word alone what it does to it in a text
        self.by_word = separable(m) and m.dummy_prefix and self.simple
        self.cache = WordCache(self._split, self._encode) if separable(m) else WordCache(lambda text: [text] if text else [], self._encode_whole)

    def normalised(self, text: str) -> str:
        if not self.simple:
            return self.whole.normalizer.normalize_str(text) if text else ""
        return (MARK * self.model.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def _split(self, text: str) -> list[str]:
        return self.unit.findall(self.normalised(text))

    def _encode(self, words: list[str]) -> Iterable[bytes]:
        found = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        if self.peer is not None:
            # the peer puts a marker before what it gets, so each word goes without its first one; words without one follow a word that ends in another character
            own = [w for w in words if w.startswith(MARK)]
            theirs = dict(zip(own, self.peer.encode([w[1:].replace(MARK, " ") for w in own], num_threads=1), strict=True)) if self.by_word else {}
            self.bad.update(w for w, ids in zip(words, found, strict=True) if w in theirs and len(w) > 1 and theirs[w] != ids)
        return map(packed, found)

    def _encode_whole(self, texts: list[str]) -> Iterable[bytes]:
        return (packed(e.ids) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.cache.ids(texts)]

    def parity(self, texts: list[str], ids: list[np.ndarray]) -> list[bool | None]:
        """For each encoded text whether the peer has the same ids, by its words or as a whole; null if there is no peer."""
        if self.peer is None:
            return [None] * len(texts)
        if self.by_word:
            return [not self.bad or self.bad.isdisjoint(self.cache.split(t)) for t in texts]
        return [theirs == x.tolist() for x, theirs in zip(ids, self.peer.encode(texts, num_threads=1), strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if self.model.dummy_prefix and data.startswith(b" ") else data).decode("utf-8", "replace")


@functools.cache
def codec(path: str, verify: bool = True, threads: int = 2) -> Codec:
    """One for each worker process."""
    return Codec(path, verify, threads)


def encode(df: DataFrame, model: str, text_col: str = "text", threads: int = 2) -> DataFrame:
    """df with token_ids array<int>, parity (the sentencepiece library gives the same ids) and round_trip (decoding gives the normalised text back).

    A null or empty text has no ids and both flags true. Whole texts, whatever their length; repeated rows stay. Of df's columns, those with the new
    names are replaced.
    """
    need_columns(df, text_col)
    ship(df.sparkSession)
    new = ["token_ids", "parity", "round_trip"]
    kept = [c for c in df.columns if c not in new]
    rows = df.select(*kept, text_or_empty(text_col).alias(fresh(df, "_text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, True, threads)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(len(kept)).to_pylist()
                ids = c.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))
                same = [c.decode(x.tolist()) == _plain(c, t) for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(c.parity(texts, ids), pa.bool_()), pa.array(same)], [*kept, *new])

    schema = df.select(*kept).withColumns({"token_ids": F.array().cast("array<int>"), "parity": F.lit(True), "round_trip": F.lit(True)}).schema
    return rows.mapInArrow(work, schema)


def _plain(c: Codec, text: str) -> str:
    n = c.normalised(text)
    return (n[1:] if c.model.dummy_prefix else n).replace(MARK, " ")


def decode(df: DataFrame, model: str, ids_col: str = "token_ids") -> DataFrame:
    """df with text from the ids: null for null ids, empty for none; null ids within are left out; bytes that are not UTF-8 become U+FFFD."""
    need_columns(df, ids_col)
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def work(ids):
        c = codec(model, False)
        return ids.map(lambda x: None if x is None else c.decode(int(i) for i in x if i is not None and i == i))

    return df.withColumn("text", work(F.col(ids_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents; ids as their number and CRC-32 (little-endian unsigned 32-bit numbers)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ship(spark)
    model = public_tokenizer("piece_bpe_32k.model")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat, ends = ids.flatten().to_numpy().astype("<u4"), np.cumsum(ids.value_lengths().to_numpy())
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64()), b.column(2), b.column(3)], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    out = encode(docs, model).select("doc_id", "token_ids", "parity", "round_trip")
    return out.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")

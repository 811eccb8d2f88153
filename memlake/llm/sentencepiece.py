"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, metaspace marker, scores
and byte fallback are rebuilt as a ``tokenizers`` pipeline, whose batches are
encoded multithreaded.  Where no piece crosses the start of a word, each
different word of a batch is encoded once.  ``verify_parity`` compares ids and
decoded texts with the SentencePiece library itself.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from memlake.llm.scratch import bounded_batches

#: The metaspace marker.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text that are encoded at once.
BATCH_BYTES = 1 << 20
#: Longest word whose ids are kept, and the bytes of words that are kept.
SHORT, CACHE_BYTES = 128, 48 << 20
#: Words that are encoded at once: what the library returns of one takes a few kilobytes.
AT_ONCE = 1 << 13

PROBES = ["", " ", "  two  spaces ", "Hello world", "tab\tand\nnew line\r\n", "éèßñ 你好 \U0001f600", "a" * 300, "1234567890 3.14", "<s> </s> <unk> <0x0A>", MARK + "x" + MARK, "\u0000\u0085  ", "Źéro", "ﬁne ½ Ａ", "...!!!???  ###"]


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @property
    def stripped(self) -> bool:
        """A decoded text loses one space at its start, as the one that was put there (the library does so for suffixes too)."""
        return self.add_prefix and self.escape


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 44:
                    m.unk_surface = v.decode()
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs whose union is a piece, best score first; of one piece, the longest left part's id first."""
    ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    out = []
    for piece, k in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                out.append((-pieces[k][1], k, left, right, piece[:cut], piece[cut:]))
    return [(a, b) for *_, a, b in sorted(out)]


def build_tokenizer(m: Model):
    """A ``tokenizers.Tokenizer`` with the model's ids, for texts that are normalised already; user-defined pieces are matched first."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    unk = next(k for k, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN)
    names = [p for p, _, _ in m.pieces]
    if m.kind == BPE:
        vocab = {p: k for k, p in enumerate(names)}
        t = Tokenizer(models.BPE(vocab, merges_of(m.pieces), unk_token=names[unk], fuse_unk=True, byte_fallback=m.byte_fallback))
    elif m.kind == UNIGRAM:
        # Control pieces keep their ids but can never be found in a text.
        floor = min(s for _, s, _ in m.pieces) - 1e6
        t = Tokenizer(models.Unigram([(p, s if kind == NORMAL else floor) for p, s, kind in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback))
    else:
        raise NotImplementedError(f"model type {m.kind}")
    t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER])
    t.decoder = decoders.Sequence([*([decoders.Replace(MARK, " ")] if m.escape else []), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.stripped else [])])
    return t


def build_normalizer(m: Model):
    """The model's rules for characters and runs of spaces; None where it has none."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    return normalizers.Sequence(steps) if steps else None


class Encoder:
    """Texts to ids, as little-endian 32-bit numbers, and back."""

    def __init__(self, data: bytes, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        m = parse_model(data)
        self.words = build_tokenizer(m)
        self.normalizer = build_normalizer(m)
        self.cache: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, cache_bytes
        mark = MARK if m.escape else " "
        names = [p for p, _, kind in m.pieces if kind in (NORMAL, USER)]
        # Where no piece has a marker inside, words never share a piece.  A line feed that is in no
        # piece is a byte of its own.
        self.cut = None
        if m.suffix:
            if not any(mark in p.rstrip(mark) for p in names):
                self.cut = re.compile(f"[^{mark}]*{mark}+|[^{mark}]+")
        elif not any(mark in p.lstrip(mark) for p in names):
            alone = m.byte_fallback and not any("\n" in p for p in names)
            self.cut = re.compile(f"{mark}+[^{mark}\n]*|[^{mark}\n]+|\n" if alone else f"{mark}+[^{mark}]*|[^{mark}]+")
        self.mark, self.stripped = mark, m.stripped
        self.before, self.after = (mark * (m.add_prefix and here) for here in (not m.suffix, m.suffix))
        # The library's decoder turns bytes that are not UTF-8 to marks one by one; texts that were
        # encoded here have none, so their pieces' bytes only need joining.
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else (p.replace(MARK, " ") if m.escape else p).encode() for p, _, kind in m.pieces]
        self.surface = m.unk_surface.encode()
        self.bytes_of[next(k for k, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN)] = self.surface

    def normal(self, text: str) -> str:
        """The text as the model's pieces spell it."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return self.before + text.replace(" ", self.mark) + self.after if text else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        texts = [self.normal(t) for t in texts]
        if self.cut is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.words.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.cut.findall(t) for t in texts]
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        long: dict[str, bytes] = {}
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            for w, e in zip(part, self.words.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = array("I", e.ids).tobytes()
                if len(w) > SHORT:
                    long[w] = ids
                else:
                    cache[w] = ids
                    self.held += 160 + 4 * len(w) + len(ids)
        if long:
            return [b"".join([long[w] if w in long else cache[w] for w in words]) for words in split]
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, encoded: list[bytes]) -> list[str]:
        """The texts of ids, from a table of each piece's bytes; ``verify_parity`` holds it against the SentencePiece library's decoder."""
        get = self.bytes_of.__getitem__
        out = []
        for e in encoded:
            text = b"".join(map(get, np.frombuffer(e, "<u4").tolist()))
            out.append(text[self.stripped and text.startswith(b" ") :].decode("utf-8", "replace"))
        return out

    def decode_by_library(self, encoded: list[bytes]) -> list[str]:
        """The same by the tokenizers library's decoder."""
        return self.words.decode_batch([np.frombuffer(e, "<u4").tolist() for e in encoded], skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> Encoder:
    return Encoder(data)


def verify_parity(data: bytes, texts: list[str]) -> list[int]:
    """Indices of the texts whose ids, or whose ids' decoded texts, differ from the SentencePiece library's."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    theirs = sp.encode(texts, num_threads=1)
    ours = encoder_of(data).encode(texts)
    back = encoder_of(data).decode(ours)
    return [k for k, (a, b, t) in enumerate(zip(theirs, ours, back, strict=True)) if np.array(a, "<u4").tobytes() != b or sp.decode(a) != t]


def model_bytes(spark, path: str) -> bytes:
    """A tokenizer's file: by Spark where ``path`` names a store, else from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return Path(path).read_bytes()


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``round_trip`` and, on demand, ``ids``.

    Whole texts are encoded without special tokens and decoded again;
    ``ids_sha256`` digests the ids as little-endian 32-bit numbers, and
    ``round_trip`` says whether the decoded text is the text.  Null counts as
    empty: no tokens.  Repeated rows are encoded one by one; an empty table gives
    an empty result; other columns are ignored.  The rebuilt tokenizer is held
    against the SentencePiece library on ``PROBES`` before it is used.
    """
    if verify_parity(model, PROBES):
        raise ValueError("the rebuilt tokenizer differs from the SentencePiece library")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder_of(held.value)
        for whole in batches:
            size = np.array(pc.binary_length(whole.column("text")))
            cut = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_BYTES)) + 1
            for a, b in zip([0, *cut], [*cut, whole.num_rows], strict=True):
                part = whole.slice(a, b - a)
                texts = part.column("text").to_pylist()
                encoded = t.encode(texts)
                decoded = t.decode(encoded)
                cols = [
                    part.column("id"),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)

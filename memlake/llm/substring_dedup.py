"""Substring dedup with difference-cover anchors.

The residues {0, 1, 3} modulo 7 are a difference cover: for any two positions
some shift below 7 brings both to covered residues.  So only windows of seven
words at covered positions are hashed as anchors, and any match of 13 words
holds an anchor that both documents have.  Shared anchors are then extended:
the 13-word windows that hold one are compared by two independent 64-bit hashes
of their words' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from memlake.llm.chunks import CHUNK, RUNS_DDL, answered, counts_for, cut_runs, flags_of, ids_and_texts, in_chunks, text_bytes

PERIOD = 7
#: A perfect difference set modulo PERIOD: every difference occurs.
COVER = (0, 1, 3)
WINDOW = 13
ANCHOR = WINDOW - PERIOD + 1

WINDOWS = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("low", "<i8")])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
#: Longest word whose bytes are hashed by table.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which every bit depends on every other."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(half: int) -> np.ndarray:
    """A random 64-bit number for each place in a word and byte there."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, SHORT * 256 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) + _U(0xA0761D6478BD642F * (half + 1) % (1 << 64)))


_TABLES = (_tables(0), _tables(1))


class Words:
    """The words of a chunk's texts: documents, places in the document, and hashes.

    A word of up to ``SHORT`` bytes is hashed by tabulation: the sum of a random
    number for each of its bytes at its place, mixed.  Longer words are hashed by
    XXH3.  Both halves have tables and seeds of their own.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        data = b" ".join(texts)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(data, np.uint8)
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = _SPACE[self.data]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = turn[0::2], turn[1::2]
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(self.count)])
        self.first = first
        self.place = np.arange(len(self.start)) - first[self.doc]
        self.left = self.count[self.doc] - self.place  # words from here to the document's end
        self._halves: dict[int, np.ndarray] = {}

    def hashes(self, half: int, piece: int = 1 << 19) -> np.ndarray:
        """One 64-bit hash a word; computed once."""
        if half not in self._halves:
            out = np.empty(len(self.start), np.uint64)
            size = self.end - self.start
            a = 0
            while a < len(out):
                b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + piece, side="right")))
                at = np.concatenate([[0], np.cumsum(np.minimum(size[a:b], SHORT))])
                place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
                byte = self.data[np.repeat(self.start[a:b], np.diff(at)) + place]
                out[a:b] = np.add.reduceat(_TABLES[half][place * 256 + byte], at[:-1])
                a = b
            with np.errstate(over="ignore"):
                out = mix(out + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
            for k in np.flatnonzero(size > SHORT).tolist():
                out[k] = xxhash.xxh3_64_intdigest(self.data[self.start[k] : self.end[k]].tobytes(), half + 1)
            self._halves[half] = out
        return self._halves[half]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix(a * _U(0xC2B2AE3D27D4EB4F) + ((b << _U(23)) | (b >> _U(41))) + _U(salt))

    def windows(self, n: int, salt: int, half: int = 0) -> np.ndarray:
        """Hashes of the ``n`` words from each place on; only those within the document mean anything."""
        word = self.hashes(half)
        with np.errstate(over="ignore"):
            h, size = self._pair(word, word, salt), 1
            while size < n:
                step = min(size, n - size)
                ahead = np.concatenate([h[step:], np.zeros(min(step, len(h)), np.uint64)])[: len(h)]
                h, size = self._pair(h, ahead, salt + size), size + step
            return h


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and hashes of the anchors at covered places."""
    at = np.flatnonzero(np.isin(w.place % PERIOD, COVER) & (w.left >= ANCHOR) & (w.count[w.doc] >= WINDOW)) if len(w.start) else np.empty(0, np.int64)
    return at, w.windows(ANCHOR, 11)[at]


def shared_windows(w: Words, at: np.ndarray, hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that hold a shared anchor: word indices and both hashes."""
    mark = np.zeros(len(w.start) + 1, np.int64)
    mark[at[shared]] = 1
    upto = np.concatenate([[0], np.cumsum(mark)])
    q = np.flatnonzero(w.left >= WINDOW)
    q = q[upto[np.minimum(q + PERIOD, len(w.start))] > upto[q]]
    if not len(q):
        return q, np.empty(0, np.uint64), np.empty(0, np.uint64)
    return q, w.windows(WINDOW, 101)[q], w.windows(WINDOW, 211, half=1)[q]


def window_run(ids: np.ndarray, w: Words, q: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's sorted run of windows with their smallest ids, and each window's place in it."""
    if not len(q):
        return np.empty(0, WINDOWS), np.empty(0, np.int64)
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(new)
    run = np.empty(len(at), WINDOWS)
    run["h1"], run["h2"] = a[at], b[at]
    run["low"] = np.minimum.reduceat(ids[w.doc[q[order]]], at)
    place = np.empty(len(q), np.int64)
    place[order] = np.cumsum(new) - 1
    return run, place


def anchor_run(w: Words, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, each anchor's place among them, and which ones two documents of the chunk share."""
    keys, place = np.unique(hashes, return_inverse=True)
    if not len(keys):
        return keys, place, np.empty(0, bool)
    low, high = np.full(len(keys), len(w.texts)), np.full(len(keys), -1)
    doc = w.doc[at]
    np.minimum.at(low, place, doc)
    np.maximum.at(high, place, doc)
    return keys, place, low != high


def seen_elsewhere(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each run of distinct hashes: is the hash in another run too?"""
    every = np.sort(np.concatenate(runs))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    return [np.isin(r, twice, assume_unique=True).astype(np.uint8) for r in runs]


def starts_lower(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each run of windows: does another run hold the window with a smaller id?"""
    rows = np.concatenate(runs)
    order = np.lexsort((rows["h2"], rows["h1"]))
    r = rows[order]
    new = np.concatenate([[True], (r["h1"][1:] != r["h1"][:-1]) | (r["h2"][1:] != r["h2"][:-1])])
    low = np.minimum.reduceat(r["low"], np.flatnonzero(new))
    lower = np.empty(len(rows), np.uint8)
    lower[order] = low[np.cumsum(new) - 1] < r["low"]
    return np.split(lower, np.cumsum([len(x) for x in runs])[:-1])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, on demand, ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Each word covered by a window of 13
    consecutive words that also starts in a document with a smaller id is
    removed; kept words are joined by one space.  Windows are judged on the
    input.  Null and empty texts have no words.  A null id is larger than any
    other and equal to itself; rows that repeat an id do not count as smaller.
    An empty table gives an empty result; other columns are ignored.
    """
    n_chunks, n_buckets = counts_for(text_bytes(docs, text_col))
    chunks = in_chunks(docs, id_col, text_col, n_chunks)

    def send_anchors(table: pa.Table) -> pa.Table:
        _, texts = ids_and_texts(table)
        keys = np.unique(anchors(Words(texts))[1])
        return cut_runs(table.column(CHUNK)[0].as_py(), keys, keys, n_buckets)

    def extended(table: pa.Table, said: pa.Table):
        ids, texts = ids_and_texts(table)
        w = Words(texts)
        at, hashes = anchors(w)
        keys, place, here = anchor_run(w, hashes, at)
        shared = (flags_of(keys, said, n_buckets)[:, 0] | here)[place] if len(keys) else np.zeros(0, bool)
        q, h1, h2 = shared_windows(w, at, hashes, shared)
        return ids, w, q, *window_run(ids, w, q, h1, h2)

    def send_windows(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return cut_runs(0, np.empty(0, np.uint64), np.empty(0, WINDOWS), n_buckets)
        run = extended(table, said)[3]
        return cut_runs(table.column(CHUNK)[0].as_py(), run["h1"], run, n_buckets)

    def keep(table: pa.Table, said: pa.Table) -> pa.Table:
        about_anchors = said.filter(pc.equal(said.column("kind"), 0))
        about_windows = said.filter(pc.equal(said.column("kind"), 1))
        ids, w, q, run, place = extended(table, about_anchors)
        covered = np.zeros(len(w.start) + 1, np.int64)
        if len(q):
            lower = flags_of(run["h1"], about_windows, n_buckets)[:, 0]
            hit = q[lower[place] | (ids[w.doc[q]] > run["low"][place])]
            covered[hit] += 1
            covered[hit + WINDOW] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        removed = np.bincount(w.doc[gone], minlength=len(w.texts))
        kept = []
        for d, text in enumerate(w.texts):
            words = text.split()
            if removed[d]:
                words = [x for x, g in zip(words, gone[w.first[d] : w.first[d + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        cols = [table.column("id"), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        return pa.table(cols, names=names)

    shared = answered(chunks.groupBy(CHUNK).applyInArrow(send_anchors, RUNS_DDL), seen_elsewhere, np.dtype("<u8"))
    windows = chunks.groupBy(CHUNK).cogroup(shared.groupBy(CHUNK)).applyInArrow(send_windows, RUNS_DDL)
    lower = answered(windows, starts_lower, WINDOWS)
    said = shared.withColumn("kind", F.lit(0)).unionByName(lower.withColumn("kind", F.lit(1)))
    ddl = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return chunks.groupBy(CHUNK).cogroup(said.groupBy(CHUNK)).applyInArrow(keep, ddl).withColumnRenamed("id", id_col)

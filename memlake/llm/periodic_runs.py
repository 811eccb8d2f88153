"""Periodic run detection by an all-lag vectorised scan.

The words of a text become numbers, and the array of numbers is compared with
itself at every shift up to its length over ``min_exp``; a stretch of equal
places is a run of that period.  Short shifts are compared everywhere.  For a
longer shift ``p``, a stretch that is long enough holds ``min_exp - 1`` multiples
of ``p`` in a row, so every ``p``-th place is compared first, and the rest only
around those where all agree: no run is lost, and all lags of ``n`` words cost
about ``n log n`` comparisons in place of ``n ** 2``.

Short texts are scanned together, a batch at a time.  A long text is sent to
several machines, each of which scans a range of its lags; the ranges' runs come
together by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.scratch import bounded_batches, written
from memlake.llm.substring_dedup import Words

#: Shifts up to this are compared everywhere.
EVERYWHERE = 32
#: Places of a candidate that are looked at before it is extended.
_PROBES = (1, 2, 3, 5, 8, 13, 21)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
ROW, RANGE, RANGES = "__row", "__range", "__ranges"


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word; equal words, and only those, have the same."""
    if not len(w.start):
        return np.empty(0, np.int32)
    letters = w.data[~_SPACE[w.data]]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


class Scan:
    """The runs of documents whose word numbers lie one after the other, longest first, each followed by a number of its own."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray, min_exp: int, min_len: int):
        self.x, self.min_exp, self.min_len = numbers, min_exp, min_len
        self.ends = np.cumsum(sizes + 1)
        self.sizes = sizes
        self.runs: list[tuple[int, int, int]] = []
        self.cover = np.full(len(numbers), -1, np.int32)  # the last run found at each place

    def lags(self, first: int, last: int) -> np.ndarray:
        """``(start, length, period)`` of the runs that the lags ``first`` to ``last`` show, smallest periods only."""
        for p in range(max(1, first), last + 1):
            docs = int(np.searchsorted(-self.sizes, -max(self.min_exp * p, self.min_len), side="right"))
            if not docs:
                break
            x, need = self.x[: self.ends[docs - 1]], max(self.min_exp * p, self.min_len) - p
            if p <= EVERYWHERE:
                self._everywhere(x, p, need)
            else:
                self._sampled(x, p, need)
        if not self.runs:
            return np.empty((0, 3), np.int64)
        found = np.array(self.runs, np.int64)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]

    def _everywhere(self, x: np.ndarray, p: int, need: int) -> None:
        at = np.flatnonzero(x[p:] == x[:-p])
        if len(at) < need:
            return
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        long = last - first + 1 >= need
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            self._add(a, b + 1 + p - a, p)

    def _sampled(self, x: np.ndarray, p: int, need: int) -> None:
        sample = x[::p]
        same = sample[1:] == sample[:-1]
        in_a_row = self.min_exp - 1
        hit = same[: len(same) - in_a_row + 1]
        for k in range(1, in_a_row):
            hit = hit & same[k : len(same) - in_a_row + 1 + k]
        at = np.flatnonzero(hit) * p
        for off in _PROBES:
            if not len(at):
                return
            if off < (in_a_row - 1) * p:
                at = at[x[at + off] == x[at + off + p]]
        done = -1
        for i in at.tolist():
            known = self.cover[i]
            if i < done or known >= 0 and p % self.runs[known][2] == 0 and i + p < sum(self.runs[known][:2]):
                continue  # multiples of a known run's period show the same run
            b = self._reach(i, p)
            if b - i <= (in_a_row - 1) * p:
                continue
            a = self._back(i, p)
            done = b
            if b - a >= need:
                self._add(a, b + p - a, p)

    def _reach(self, i: int, p: int) -> int:
        """The first place from ``i`` on that differs from the one ``p`` later."""
        size = 64
        while i + p < len(self.x):
            ahead = self.x[i + p : i + p + size]
            differ = self.x[i : i + len(ahead)] != ahead
            if differ.any():
                return i + int(differ.argmax())
            i, size = i + len(ahead), 2 * size
        return i

    def _back(self, i: int, p: int) -> int:
        """The first place of the equal ones that end at ``i``."""
        size = 64
        while i:
            a = max(0, i - size)
            differ = (self.x[a:i] != self.x[a + p : i + p])[::-1]
            if differ.any():
                return i - int(differ.argmax())
            i, size = a, 2 * size
        return i

    def _add(self, start: int, length: int, p: int) -> None:
        """Adds a run under its smallest period, a divisor of ``p``."""
        known = self.cover[start]
        if known >= 0 and self.runs[known][:2] == (start, length):
            return
        piece = self.x[start : start + p]
        q = next((q for q in range(1, p // 2 + 1) if p % q == 0 and (piece[q:] == piece[:-q]).all()), p)
        self.cover[start : start + length] = len(self.runs)
        self.runs.append((start, length, q))


def scan_texts(texts: list[bytes], min_exp: int, min_len: int, part: tuple[int, int] = (0, 1)) -> tuple[Words, np.ndarray]:
    """The texts' words and the rows ``(document, start, length, period)`` of their runs, in that order.

    ``part`` names one range of the longest text's lags and the number of ranges.
    """
    w = Words(texts)
    numbers, n = word_numbers(w), len(texts)
    order = np.argsort(-w.count, kind="stable")
    size = w.count[order]
    first = np.concatenate([[0], np.cumsum(size + 1)])
    x = np.empty(len(numbers) + n, np.int32)
    for k, d in enumerate(order.tolist()):
        x[first[k] : first[k + 1] - 1] = numbers[w.first[d] : w.first[d + 1]]
        x[first[k + 1] - 1] = -1 - k
    lags = int(size[0]) // min_exp if n else 0
    found = Scan(x, size, min_exp, min_len).lags(lags * part[0] // part[1] + 1, lags * (part[0] + 1) // part[1])
    doc = np.searchsorted(first, found[:, 0], side="right") - 1
    runs = np.column_stack([order[doc], found[:, 0] - first[doc], found[:, 1:]]) if len(found) else np.empty((0, 4), np.int64)
    return w, runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def best_run(runs: np.ndarray) -> tuple[int, int, int]:
    """The ``(start, length, period)`` of greatest exact exponent; ties go to the smallest start, then period."""
    about = runs[:, 1] / runs[:, 2]
    near = runs[about >= about.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [x for x, gone in zip(words, (np.cumsum(change)[:-1] > 0).tolist(), strict=True) if not gone]


OUT = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
MORE = ", runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _answers(ids: pa.Array, texts: list[bytes], runs: np.ndarray, with_text: bool) -> pa.RecordBatch:
    at = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    n, best, listed, kept, lists = [], [], [], [], []
    for k, text in enumerate(texts):
        own, words = runs[at[k] : at[k + 1], 1:], text.split()
        n.append(len(own))
        if len(own):
            s, size, q = best_run(own)
            best.append((s, size, q, 1000 * size // q))
            words = collapse(words, own)
        else:
            best.append((None,) * 4)
        rows = own.tolist()
        listed.append(hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in rows).encode()).hexdigest())
        kept.append(b" ".join(words))
        lists.append([{"start": s, "length": size, "period": q} for s, size, q in rows] if with_text else None)
    cols = [ids, pa.array(n, pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(4)), pa.array(listed, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if with_text:
        cols += [pa.array(lists, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
        names += ["runs", "collapsed_text"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exp: int = 4, min_len: int = 6, with_text: bool = True, long_bytes: int = 1 << 16) -> DataFrame:
    """One row per input row: id, ``n_runs``, the run of greatest exponent, digests, and on demand ``runs`` and ``collapsed_text``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0.  A run
    is a stretch of words with smallest period ``q``, of at least ``min_len`` and
    ``min_exp * q`` words, that no neighbouring word extends.  ``start``,
    ``length``, ``period`` and ``exponent_milli`` (1000 times length over period,
    cut) describe the run of greatest exponent, ties to the smallest start, then
    period; they are null where there is none.  ``runs_sha256`` is of the lines
    ``start,length,period`` of all runs; ``collapsed_sha256`` is of the words
    that no run contains after its first period, joined by one space.

    Null and empty texts have no words.  Null ids stay null; rows that repeat an
    id or a text are rows of their own.  An empty table gives an empty result;
    other columns are ignored.

    Texts of up to ``long_bytes`` are scanned where they are read.  A longer one
    is cut into ranges of its lags, whose number grows with the root of its size,
    so neither its copies nor the longest task grow with its square.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    ddl = OUT + MORE * with_text

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            yield _answers(batch.column("id"), texts, scan_texts(texts, min_exp, min_len)[1], with_text)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(_texts(batch.column("text"))):
                row, part, parts = (batch.column(c)[k].as_py() for c in (ROW, RANGE, RANGES))
                runs = scan_texts([text], min_exp, min_len, (part, parts))[1]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(runs), pa.int64()), *(pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3))], names=[ROW, "start", "length", "period"])

    def together(texts: pa.Table, found: pa.Table) -> pa.Table:
        runs = np.column_stack([np.zeros(found.num_rows, np.int64)] + [found.column(c).to_numpy() for c in ("start", "length", "period")])
        batch = texts.combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_answers(batch.column("id"), _texts(batch.column("text")), runs[np.lexsort((runs[:, 3], runs[:, 1]))], with_text)])

    longs = written(rows.where(long).withColumn(ROW, F.monotonically_increasing_id()), "long-texts")
    parts = F.ceil(F.sqrt(F.octet_length("text") / F.lit(max(1, long_bytes // 4)))).cast("int")
    cut = longs.select(ROW, "text", parts.alias(RANGES)).withColumn(RANGE, F.explode(F.sequence(F.lit(0), F.col(RANGES) - 1)))
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = cut.repartition(n_parts, ROW, RANGE).mapInArrow(ranged, f"{ROW} long, start long, length long, period long").groupBy(ROW, "start", "length").agg(F.min("period").alias("period"))
    answered = longs.groupBy(ROW).cogroup(found.groupBy(ROW)).applyInArrow(together, ddl)
    return rows.where(~long).mapInArrow(whole, ddl).unionByName(answered).withColumnRenamed("id", id_col)

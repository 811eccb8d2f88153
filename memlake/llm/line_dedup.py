"""Line dedup with levelled sorted runs of line hashes.

A bucket of the hash space keeps its line hashes in sorted runs on levels.  Each
batch (some chunks' runs) is merge-anti-joined with the runs: lines that they
hold are counted where they stand, and its new lines are added as a run of its
own.
Whenever a level holds ``fanout`` runs, they are compacted into one of the next
level.  A line is in one run only, so counts need no second look.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from memlake.llm.chunks import CARRY, CHUNK, RUNS_DDL, answered, counts_for, cut_runs, flags_of, ids_and_texts, in_chunks, text_bytes

#: Two halves of a line's 128-bit hash, the documents that hold it, the largest of their ids.
LINE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("docs", "<u4"), ("top", "<i8")])
#: A line of a run, and the place of its counts.
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("slot", "<i8")])
SPACES = b" \t\n\r\x0b\x0c"


class LevelledRuns:
    """Sorted runs by level, the youngest last; no two runs hold the same line."""

    def __init__(self, fanout: int = 8):
        self.fanout = fanout
        self.levels: list[list[np.ndarray]] = [[]]
        self.size = 0
        self.docs = np.zeros(1024, np.int64)
        self.top = np.zeros(1024, np.int64)

    def slots(self, batch: np.ndarray) -> np.ndarray:
        """Where each line of a sorted batch is counted; -1 for lines that no run holds."""
        out = np.full(len(batch), -1, np.int64)
        for run in (r for level in self.levels for r in level):
            known, at = match(batch, run)
            out[known] = run["slot"][at]
        return out

    def anti_join(self, batch: np.ndarray) -> np.ndarray:
        """The lines of a sorted batch that no run holds."""
        return batch[self.slots(batch) < 0]

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Counts a sorted batch and adds its new lines as a run; returns where its lines are counted."""
        slot = self.slots(batch)
        new = np.flatnonzero(slot < 0)
        slot[new] = np.arange(self.size, self.size + len(new))
        self.size += len(new)
        if self.size > len(self.docs):
            more = np.zeros(max(self.size, 2 * len(self.docs)) - len(self.docs), np.int64)
            self.docs, self.top = np.concatenate([self.docs, more]), np.concatenate([self.top, more])
        self.top[slot[new]] = batch["top"][new]
        self.docs[slot] += batch["docs"]
        self.top[slot] = np.maximum(self.top[slot], batch["top"])
        run = np.empty(len(new), ENTRY)
        run["h1"], run["h2"], run["slot"] = batch["h1"][new], batch["h2"][new], slot[new]
        self._push(run)
        return slot

    def _push(self, run: np.ndarray) -> None:
        if not len(run):
            return
        self.levels[0].append(run)
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged(self.levels[k]))
            self.levels[k] = []

    def compact(self) -> np.ndarray:
        """All lines with their counts, as one sorted run."""
        runs = [r for level in self.levels for r in level]
        rows = merged(runs) if runs else np.empty(0, ENTRY)
        out = np.empty(len(rows), LINE)
        out["h1"], out["h2"], out["docs"], out["top"] = rows["h1"], rows["h2"], self.docs[rows["slot"]], self.top[rows["slot"]]
        return out


def batched(runs: list[np.ndarray], least: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of ``least`` lines or more of consecutive runs, and the place of each of their lines in the batch.

    A batch is sorted and has each line once, with its documents added up and its largest id.
    """
    held, n = [], 0
    for k, run in enumerate(runs, 1):
        held.append(run)
        n += len(run)
        if n < least and k < len(runs):
            continue
        rows = np.concatenate(held)
        order = np.lexsort((rows["h2"], rows["h1"]))
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
        at = np.flatnonzero(new)
        batch = rows[at]
        if len(at):
            batch["docs"], batch["top"] = np.add.reduceat(rows["docs"], at), np.maximum.reduceat(rows["top"], at)
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        yield batch, place
        held, n = [], 0


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of runs that share no line."""
    rows = np.concatenate(runs)
    order = np.argsort(rows["h1"], kind="stable")
    h1 = rows["h1"][order]
    if (h1[1:] == h1[:-1]).any():
        order = np.lexsort((rows["h2"], rows["h1"]))
    return rows[order]


def match(batch: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the batch's lines that the run holds, and where it holds them."""
    lo = np.searchsorted(run["h1"], batch["h1"])
    hi = np.searchsorted(run["h1"], batch["h1"], side="right")
    known, where = [], []
    step = 0
    while (open_ := np.flatnonzero(lo + step < hi)).size:
        same = run["h2"][lo[open_] + step] == batch["h2"][open_]
        known.append(open_[same])
        where.append(lo[open_[same]] + step)
        step += 1
    if not known:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(known), np.concatenate(where)


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """Number and 128-bit hash of each line whose key has ``min_chars`` code points."""
    out = []
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(SPACES).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                out.append((k, xxhash.xxh3_128_digest(key)))
    return out


def chunk_lines(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, line number and hash halves of the long lines of a chunk."""
    doc, number, hashes = [], [], []
    for d, text in enumerate(texts):
        for k, h in line_keys(text, min_chars):
            doc.append(d)
            number.append(k)
            hashes.append(h)
    return np.array(doc, np.int64), np.array(number, np.int64), np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def own_run(ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's sorted run, and each line's place in it.  A document counts once for a line."""
    if not len(doc):
        return np.empty(0, LINE), np.empty(0, np.int64)
    order = np.lexsort((doc, hashes[:, 1], hashes[:, 0]))
    h, d = hashes[order], doc[order]
    new_key = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])
    new_doc = new_key | np.concatenate([[True], d[1:] != d[:-1]])
    at = np.flatnonzero(new_key)
    run = np.empty(len(at), LINE)
    run["h1"], run["h2"] = h[at, 0], h[at, 1]
    run["docs"] = np.add.reduceat(new_doc.astype(np.int64), at)
    run["top"] = np.maximum.reduceat(ids[d], at)
    place = np.empty(len(doc), np.int64)
    place[order] = np.cumsum(new_key) - 1
    return run, place


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, fanout: int = 8, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_dropped``, ``kept_sha256`` and, on demand, ``kept_text``
    (null where the text is null).

    ``carry`` names columns that are returned along, in the struct ``carried``.

    A text is split at ``\\n`` (null and empty: one empty line).  A line's key is
    the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  Keys
    of at least ``min_chars`` code points that ``min_docs`` documents hold lose
    all their lines but those of the largest id that holds them.  A null id is
    larger than any other.  Rows that repeat an id count as documents of their
    own and, being equally large, keep their lines together.  An empty table
    gives an empty result; other columns are ignored.
    """
    n_chunks, n_buckets = counts_for(text_bytes(docs, text_col))
    chunks = in_chunks(docs, id_col, text_col, n_chunks, carry)

    def send(table: pa.Table) -> pa.Table:
        ids, texts = ids_and_texts(table)
        doc, _, hashes = chunk_lines(texts, min_chars)
        run, _ = own_run(ids, doc, hashes)
        return cut_runs(table.column(CHUNK)[0].as_py(), run["h1"], run, n_buckets)

    def answer(runs: list[np.ndarray]) -> list[np.ndarray]:
        store = LevelledRuns(fanout)
        slots = np.concatenate([store.add(batch)[place] for batch, place in batched(runs)])
        said = []
        for run, slot in zip(runs, np.split(slots, np.cumsum([len(r) for r in runs])[:-1]), strict=True):
            common = store.docs[slot] >= min_docs
            said.append(np.stack([common, common & (store.top[slot] == run["top"])], axis=1).astype(np.uint8))
        return said

    answers = answered(chunks.select("id", "text", CHUNK).groupBy(CHUNK).applyInArrow(send, RUNS_DDL), answer, LINE)

    def keep(table: pa.Table, said: pa.Table) -> pa.Table:
        ids, texts = ids_and_texts(table)
        doc, number, hashes = chunk_lines(texts, min_chars)
        run, place = own_run(ids, doc, hashes)
        flags = flags_of(run["h1"], said, n_buckets, 2)
        gone = flags[place, 0] & ~(flags[place, 1] & (ids[doc] == run["top"][place])) if len(doc) else np.zeros(0, bool)
        lost: dict[int, set[int]] = {}
        for d, k in zip(doc[gone].tolist(), number[gone].tolist(), strict=True):
            lost.setdefault(d, set()).add(k)
        n_lines, n_dropped, kept = [], [], []
        for d, text in enumerate(texts):
            n_lines.append(text.count(b"\n") + 1)
            n_dropped.append(len(lost.get(d, ())))
            kept.append(b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in lost[d]) if d in lost else text)
        cols = [table.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["id", "n_lines", "n_dropped", "kept_sha256"]
        if with_text:
            null = table.column("text").is_null().to_pylist()
            cols.append(pa.array([None if n else x for n, x in zip(null, kept, strict=True)], pa.binary()).cast(pa.string()))
            names.append("kept_text")
        if carry:
            cols.append(table.column(CARRY))
            names.append("carried")
        return pa.table(cols, names=names)

    ddl = "id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    if carry:
        ddl += f", carried {chunks.schema[CARRY].dataType.simpleString()}"
    return chunks.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(keep, ddl).withColumnRenamed("id", id_col)

"""URL filters with a bit-parallel wildcard automaton.

Every glob rule is laid out in the bits of a multiword Shift-And mask; one pass
over the bytes of a canonical URL moves all rules at once, and a batch moves all
its URLs at once.  In a rule's host and path ``*`` stands for any run of bytes
without ``/``, also an empty one, and ``**`` in a path for any run of bytes at
all; ``\\*`` is the byte itself.  A rule fits as soon as its last byte is met, so
a wildcard at its end changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: URLs, and mask words of all of them, that are in memory at once.
BATCH, BATCH_WORDS = 4096, 1 << 20
_TOKEN = re.compile(rb"\\\*|\*+|.", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with ``path``; both may hold wildcards."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class ShiftAnd:
    """All rules as one automaton over ``.host/path`` byte strings."""

    def __init__(self, rules: list[Rule]):
        # Each rule is a looping start state, then one state a byte of "." + host + path; a
        # wildcard lets the state before it loop.
        self.rules = rules
        parts = [(_TOKEN.findall(b"." + r.host.encode()), _TOKEN.findall(r.path.encode())) for r in rules]
        n = sum(1 + sum(t[0] != 0x2A for t in host + path) for host, path in parts)
        self.words = max(1, -(-n // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # states that a byte may enter
        self.loop = np.zeros((2, self.words), np.uint64)  # states that any byte but "/", or "/", may stay in
        self.start = np.zeros(self.words, np.uint64)
        self.last = np.zeros(self.words, np.uint64)
        self.last_of: list[tuple[int, np.uint64]] = []
        at = 0
        for host, path in parts:
            self._set(self.start, at)
            self._set(self.loop[0], at)
            for k, token in enumerate(host + path):
                if token[0] == 0x2A:
                    self._set(self.loop[0], at)
                    if len(token) > 1 and k >= len(host):
                        self._set(self.loop[1], at)
                else:
                    at += 1
                    self._set(self.step[token[-1]], at)
            self._set(self.last, at)
            self.last_of.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1
        self.loop |= self.last  # once fitted, a rule stays fitted
        self.batch = max(16, min(BATCH, BATCH_WORDS // self.words))

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Index of the longest rule that fits each URL, else -1."""
        size = np.array([len(u) for u in urls], np.int64)
        data = np.frombuffer(b"".join(urls), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(urls) else size
        state = np.repeat(self.start[None, :], len(urls), 0)
        live, t = np.flatnonzero(size > 0), 0
        while live.size:
            c, s = data[begin[live] + t], state[live]
            shifted = s << np.uint64(1)
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            s = (shifted & self.step[c]) | (s & self.loop[(c == 0x2F).astype(np.int8)])
            state[live] = s
            t += 1
            moving = (s & ~self.last).any(axis=1)  # else no rule can change any more
            live = live[moving & (size[live] > t)]
        best = np.full(len(urls), -1, np.int64)
        for k in sorted(range(len(self.rules)), key=lambda k: (len(self.rules[k].name.encode()), -k)):
            word, bit = self.last_of[k]
            best[(state[:, word] & bit) != 0] = k
        return best


def url_parts(url_col: str):
    """``(host, path)`` columns; both empty for null or where there is no ``://``."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url_col}`, ''), locate('://', coalesce(`{url_col}`, '')) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    # A host that ends at ? or # has no path.
    return host, F.when(path.startswith("/"), path).otherwise(F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict``.

    The longest fitting rule decides (of equally long ones, the first listed);
    where none fits, ``rule`` is null and ``verdict`` is ``default``.  Null urls
    and urls without ``://`` have empty host and path, and so fit no rule.
    Repeated rows are judged one by one; an empty table gives an empty result;
    other columns are ignored.  The masks grow with the rules' bytes and are made
    once; a batch holds fewer URLs the wider they are.
    """
    host, path = url_parts(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    held = pages.sparkSession.sparkContext.broadcast(ShiftAnd(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        names, verdicts = [*(r.name for r in rules), None], [*(r.verdict for r in rules), default]
        for whole in batches:
            for k in range(0, whole.num_rows, automaton.batch):
                b = whole.slice(k, automaton.batch)
                urls = [b"." + h + p for h, p in zip(b.column("host").cast(pa.binary()).to_pylist(), b.column("path").cast(pa.binary()).to_pylist(), strict=True)]
                best = automaton.run(urls)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("host"), b.column("path"), pa.array([names[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())],
                    names=["id", "host", "path", "rule", "verdict"],
                )

    out = rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)

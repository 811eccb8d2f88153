"""Sets of word shingles: their hashes, wide SimHash fingerprints, and true similarities."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.substring_dedup import Words, mix

#: Bytes of text whose words are hashed at once.
SLICE = 4 << 20
#: Words of a wide fingerprint, and the odd numbers that make one hash of a shingle into as many.
WIDE = 8
_SPIN = (np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 3)) | np.uint64(1)


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def shingle_sets(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; fewer words than a shingle make one of the whole sequence."""
    low = [t.lower() if t else b"" for t in texts]
    ends = np.cumsum([len(t) for t in low])
    a = 0
    while a < len(low):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        w = Words(low[a:b])
        whole = w.windows(shingle, shingle)
        short = {n: w.windows(n, n) for n in range(1, shingle) if (w.count == n).any()}
        for k, n in enumerate(w.count.tolist()):
            i = w.first[k]
            yield np.unique(whole[i : i + n - shingle + 1]) if n >= shingle else short[n][i : i + 1] if n else np.empty(0, np.uint64)
        a = b


def wide_fingerprint(s: np.ndarray) -> bytes:
    """``64 * WIDE`` bits, each set where over half of a set's hashes have it; zero for an empty set."""
    ones = np.zeros(64 * WIDE, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 255):
            h = mix(s[k : k + 255, None] * _SPIN)
            ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s)).tobytes()


def similar(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    """The Jaccard similarity of two sorted sets is ``t`` or more; two empty ones are alike."""
    num, den = t.numerator, t.denominator
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def set_table(texts: DataFrame, shingle: int, row: str) -> DataFrame:
    """``(node, set)`` of ``(row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(texts_of(batch), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.select(row, "text").mapInArrow(run, "node long, set binary")


def similar_pairs(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` whose sets' true similarity is ``t`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), t) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").mapInArrow(run, "a long, b long")

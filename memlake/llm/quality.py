"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a Gaussian over transformed statistics of the whole text.  Its
covariance is shrunk towards a multiple of the identity, its Cholesky factor is
computed once on the driver, and a document's score is the logistic of the
difference of the classes' Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.scratch import bounded_batches, discard, written

_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"|", b"#$%&*+=<>^~@_\\/{}[]`", b"\n", b"-:;?'\"()", bytes(range(128, 256)))
_MEMBER = np.array([[float(c in g) for g in _GROUPS] for c in range(256)])
N_FEATURES = len(_GROUPS) + 8


def text_statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of transformed statistics per text; all zero but finite for an empty one."""
    hist = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 8))
    for k, b in enumerate(texts):
        if not b:
            continue
        hist[k] = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        words, lines = b.split(), b.split(b"\n")
        n, kinds = len(words), set(words)
        longest = max(map(len, kinds), default=0)
        capital = sum(w.istitle() for w in kinds) / max(1, len(kinds))
        plain = sum(w.isalpha() and w.islower() for w in kinds) / max(1, len(kinds))
        rest[k] = (np.log1p(n), np.log1p(len(b) / max(1, n)), np.log1p(longest), len(kinds) / max(1, n) ** 0.9, capital, plain, len(set(lines)) / len(lines), np.log1p(n / len(lines)))
    size = np.maximum(1, hist.sum(axis=1, keepdims=True))
    return np.hstack([np.sqrt(hist @ _MEMBER / size), rest])


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, f)``: the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = text_statistics(b.column("text").cast(pa.binary()).to_pylist())
            lists = pa.ListArray.from_arrays(np.arange(0, f.size + 1, N_FEATURES, dtype=np.int32), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "f"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, f array<double>")


@dataclass
class QuadraticModel:
    """Per class: log prior, mean, inverse Cholesky factor and half log-determinant; None if a class is unseen."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray | None
    half_logdet: np.ndarray

    def scores(self, f: np.ndarray) -> np.ndarray:
        if self.whiten is None:
            return np.full(len(f), self.prior[1])
        dens = [np.log(self.prior[c]) - 0.5 * np.square((f - self.mean[c]) @ self.whiten[c].T).sum(axis=1) - self.half_logdet[c] for c in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, shrinkage: float) -> QuadraticModel:
    """Fits on all labelled rows given; the class moments are summed by Spark."""
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    pairs = [(i, j) for i in range(N_FEATURES) for j in range(i, N_FEATURES)]
    x = stats.join(y, "id").select("y", *(F.col("f")[i].alias(f"x{i}") for i in range(N_FEATURES)))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(N_FEATURES)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r["y"]: r for r in x.groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    n = np.array([got[c]["n"] if c in got else 0 for c in (0, 1)], float)
    prior = n / n.sum() if n.sum() else np.array([0.5, 0.5])
    mean, cov = np.zeros((2, N_FEATURES)), np.zeros((2, N_FEATURES, N_FEATURES))
    if n.min() < 2:
        return QuadraticModel(prior, mean, None, n)
    for c in (0, 1):
        mean[c] = [got[c][f"s{i}"] / n[c] for i in range(N_FEATURES)]
        for i, j in pairs:
            cov[c, i, j] = cov[c, j, i] = got[c][f"p{i}_{j}"] / n[c] - mean[c, i] * mean[c, j]
    # Shrinkage in units of the pooled spread, so that no statistic's scale matters.
    spread = np.sqrt(np.maximum(np.einsum("c,cii->i", prior, cov) + prior[0] * prior[1] * np.square(mean[0] - mean[1]), 1e-12))
    whiten, half = [], []
    for c in (0, 1):
        z = cov[c] / spread[:, None] / spread[None, :]
        z = (1 - shrinkage) * z + shrinkage * max(np.trace(z) / N_FEATURES, 1e-3) * np.eye(N_FEATURES)
        factor = np.linalg.cholesky(z)
        whiten.append(np.linalg.solve(factor, np.diag(1 / spread)))
        half.append(np.log(np.diag(factor)).sum())
    return QuadraticModel(prior, mean, np.array(whiten), np.array(half))


def held_out(id_col: str, folds: int = 5):
    """True where crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Documents and labels to learn from: all that are labelled, or, beyond ``most``, about as many of them by a hash of their id.

    At most ``most`` ids are sent to all executors, so texts need not be shuffled for them.
    """
    y = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias(id_col), label_col)
    parts = max(1, -(-y.count() // most))
    y = y.where(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(parts)) == 0)
    return docs.join(F.broadcast(y.select(id_col).distinct()), id_col, "left_semi"), y


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.02, threshold: float = 0.3, most: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that ``classify_quality`` predicts 1 for, with all their columns, row by row.

    Learns from at most about ``most`` labelled documents.  Null and empty texts
    are judged by their score like any other, repeated rows alike; an empty table
    gives an empty result.
    """
    known, y = examples(docs.select(id_col, text_col), labels, id_col, label_col, most)
    stats = written(statistics_table(known, id_col, text_col), "quality-statistics")
    model = fit(stats, y, id_col, label_col, shrinkage)
    discard(stats)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = text_statistics(b.column(at).cast(pa.binary()).to_pylist())
            yield b.filter(pa.array(model.scores(f) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.02, threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``.

    Learns from the labelled rows that are not held out, all of them, and scores
    every whole text.  Labels that are null or not 0 or 1 are left out; an id
    labelled twice counts twice.  Null and empty texts get a finite score; if a
    class has fewer than two examples, every score is the share of label 1
    (0.5 without any label).  Repeated rows get equal scores; an empty table
    gives an empty result; other columns are ignored.
    """
    stats = written(statistics_table(docs, id_col, text_col), "quality-statistics")
    model = fit(stats, labels.where(~held_out(id_col)), id_col, label_col, shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.scores(f))], names=["id", "score"])

    out = stats.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

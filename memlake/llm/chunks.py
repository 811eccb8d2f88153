"""Chunks of documents that ask buckets of hashes, and get one bit an entry back.

Documents are dealt into chunks by a hash of their id and text, each of a bounded
number of bytes.  A chunk sends every bucket of the hash space one sorted run of its
distinct hashes; the bucket sees the runs of all chunks and answers each with
bits in the run's order.  A text that a third of all rows share is one entry of
each chunk's run, so no bucket, task or row grows with a group of copies, and
texts cross the network once.  Nothing depends on a chunk's row order, so a lost
executor's part is made again with the same runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.salting import SALT, salted
from memlake.llm.scratch import bounded_batches

CHUNK = "__chunk"
CARRY = "__carry"
#: An id that is null counts as larger than any other.
NULL_ID = np.iinfo(np.int64).max


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def counts_for(total_bytes: int, chunk_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20) -> tuple[int, int]:
    """Numbers of chunks and of buckets for that many bytes of text.

    Every chunk may send a run to every bucket, so both grow, up to four times,
    where the input is so large that runs would hold a few hashes only.
    """
    larger = min(4, max(1, math.isqrt(total_bytes >> 38)))
    return max(128, -(-total_bytes // (larger * chunk_bytes))), max(64, -(-total_bytes // (larger * bucket_bytes)))


def in_chunks(docs: DataFrame, id_col: str, text_col: str, n_chunks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, __carry, __chunk)``, dealt by chunk; ``carry`` names columns that go along.

    Rows that share an id, null included, are dealt by their number too, so many
    equal ones do not fall into one chunk.  What is found does not depend on the
    dealing, but it must be the same each time the result is read: so must be
    the order of ``docs`` where ids are repeated, as that of files is.
    """
    bounded_batches(docs.sparkSession)
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // 16))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias(CARRY)] if carry else []))
    return salted(rows, ["id"]).withColumn(CHUNK, F.pmod(F.xxhash64("id", "text", SALT, F.lit(4)), F.lit(n_chunks))).drop(SALT).repartition(n_parts, CHUNK)


def ids_and_texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids (null: NULL_ID) and UTF-8 texts (null: empty)."""
    ids = table.column("id").fill_null(int(NULL_ID)).to_numpy()
    return ids, [b or b"" for b in table.column("text").cast(pa.binary()).to_pylist()]


RUNS = pa.schema([("bucket", pa.int64()), (CHUNK, pa.int64()), ("run", pa.binary())])
RUNS_DDL = f"bucket long, {CHUNK} long, run binary"


def cut_runs(chunk: int, first: np.ndarray, entries: np.ndarray, n_buckets: int) -> pa.Table:
    """One run per bucket of ``entries`` (rows in the order of their uint64 ``first`` hashes)."""
    edges = np.searchsorted(first, bucket_edges(n_buckets))
    at = np.concatenate([[0], edges, [len(first)]]).astype(np.int64)
    full = np.flatnonzero(np.diff(at))
    runs = [entries[at[k] : at[k + 1]].tobytes() for k in full]
    return pa.table([pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64()), pa.array(runs, pa.binary())], schema=RUNS)


def bucket_edges(n_buckets: int) -> np.ndarray:
    """The first hash of each bucket but the lowest."""
    return np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], np.uint64)


def answered(runs: DataFrame, answer: Callable[[list[np.ndarray]], list[np.ndarray]], dtype: np.dtype) -> DataFrame:
    """``answer`` gets the runs of a bucket, in chunk order, and gives uint8 rows of equal length for each."""

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        given = [np.frombuffer(b, dtype) for b in table.column("run").to_pylist()]
        said = answer(given)
        keep = pa.array([k for k, a in enumerate(said) if a.any()], pa.int64())
        return pa.table(
            [table.column("bucket").take(keep).combine_chunks(), table.column(CHUNK).take(keep).combine_chunks(), pa.array([np.packbits(said[k]).tobytes() for k in keep.to_pylist()], pa.binary())],
            schema=RUNS,
        )

    return runs.groupBy("bucket").applyInArrow(reduce, RUNS_DDL)


def flags_of(first: np.ndarray, answers: pa.Table, n_buckets: int, width: int = 1) -> np.ndarray:
    """The answered bits of a chunk's entries, ``width`` a row; false where a bucket had none to say."""
    edges = np.searchsorted(first, bucket_edges(n_buckets))
    at = np.concatenate([[0], edges, [len(first)]])
    out = np.zeros((len(first), width), bool)
    for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("run").to_pylist(), strict=True):
        n = at[k + 1] - at[k]
        out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * width).reshape(n, width)
    return out

"""Approximate nearest neighbours with shifted space-filling curves.

Each curve is a Hilbert ordering of the vectors, projected by its own rotation
and shifted against its own grid.  The orderings are range-partitioned into
blocks; a query visits the blocks around its place on every curve, and what the
visits find is merged and ranked again by the exact measure.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from memlake.llm.scratch import discard, written

#: A class of equal vectors (named by their digest), its smallest id, and its exact score.
FOUND = np.dtype([("cls", "S16"), ("low", "<i8"), ("score", "<f8")])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points in a grid of ``2**bits`` cells a side; rows of coordinates."""
    x = cells.T.astype(np.uint64)
    one = np.uint64(1)
    side = np.uint64(1 << (bits - 1))
    q = side
    while q > one:
        low = q - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = side
    while q > one:
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


class Curves:
    """The rotations, shifts and scales of all curves; fitted to the vectors' mean and spread."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.bits = mean, bits
        self.turn = [np.linalg.qr(rng.normal(size=(n, n)))[0][:, : min(dims, n)] for _ in range(curves)]
        self.scale = [np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", r, cov, r), 1e-24)) for r in self.turn]
        self.shift = rng.uniform(-0.5, 0.5, size=(curves, min(dims, n)))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One column of curve places per curve, with hash bits of the vector below them."""
        cells = 1 << self.bits
        tie = np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=2).digest(), "big") for r in x], np.uint64)
        out = np.empty((len(x), len(self.turn)), np.int64)
        for c, turn in enumerate(self.turn):
            at = ((x - self.mean) @ turn) / (self.scale[c] * 4.4) + 0.5
            grid = np.clip(np.floor(at * cells + self.shift[c]), 0, cells - 1).astype(np.uint64)
            out[:, c] = ((hilbert_keys(grid, self.bits) << np.uint64(16)) | tie).view(np.int64)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _ranked(found: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best classes of ``found``, each once, best first, ties by their smallest id."""
    order = np.lexsort((found["cls"], found["low"], -found["score"]))
    found = found[order]
    _, first = np.unique(found["cls"], return_index=True)
    return found[np.sort(first)][:k]


def _best(q: np.ndarray, x: np.ndarray, names: np.ndarray, low: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of ``q`` the ``k`` best of ``x``, whose exact scores sum the components' products in their order.

    Fast products leave what may be among the best, ties included; exact scores decide.
    """
    fast = q @ x.T
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    last = np.partition(fast, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else fast.min(axis=1)
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(~(fast[i] < last[i] - slack[i]))
        found = np.empty(len(at), FOUND)
        found["cls"], found["low"], found["score"] = names[at], low[at], np.cumsum(q[i] * x[at], axis=1)[:, -1]
        out.append(found[np.lexsort((found["cls"], found["low"], -found["score"]))[:k]])
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = 24, dims: int = 6, bits: int = 4, window: float = 0.0375, least: int = 128, rows_per_block: int = 20_000, seed: int = 5) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank``, id, ``score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own.  Nearness is the inner product in double
    precision, ties to the smaller id.  On each of ``curves`` curves a query
    looks at a share ``window`` of all vectors around its place, and at
    ``least`` of them, so all curves together look at ``curves * window`` times
    the vectors, repeats included.  Vectors that are null, zero, of another length than most,
    or hold null or non-finite components take no part, and neither do null ids;
    equal vectors are indexed once, and stand for their ``k + 1`` smallest
    different ids, which no result of ``k`` can exceed.  Repeated rows are
    one row, and other rows of a query's id count as its own.  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    ddl = f"query_id long, rank int, {id_col} long, score double"
    if width is None:
        return spark.createDataFrame([], ddl)
    d = width["d"]
    rows = rows.where(F.size("v") == d)
    # Components that are floats travel as floats.
    kind = "float" if getattr(vectors.schema[vector_col].dataType, "elementType", None) == T.FloatType() else "double"

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([hashlib.md5(r.tobytes()).digest() for r in x], pa.binary()), b.column("v")], names=["id", "cls", "v"])

    rows = written(rows.mapInArrow(named, "id long, cls binary, v array<double>").withColumn("v", F.col("v").cast(f"array<{kind}>")), "vectors")
    # Repeated rows become one; the window's limit is applied before its shuffle too.
    one = rows.groupBy("cls", "id").agg(F.first("v").alias("v"))
    first = one.withColumn("nth", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(f"nth <= {k + 1}")
    classes = written(first.groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "vector-classes")
    queries = written(rows.where(F.col("id") % every == 0).select("id", "cls").distinct(), "vector-queries")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = _vectors(b.column("v"))
            if len(x):
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        flat = np.concatenate([s, p.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n))], names=["at", "s", "n"])

    sums = classes.select("v").mapInArrow(moments, "at long, s double, n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    n, total = sums[0]["n"], np.array([r["s"] for r in sums])
    mean = total[:d] / n
    plan = Curves(mean, total[d:].reshape(d, d) / n - np.outer(mean, mean), curves, dims, bits, seed)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = plan.keys(_vectors(b.column("v")))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, curves, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("low"), b.column("v"), lists], names=["cls", "low", "v", "keys"])

    at = written(classes.select("cls", F.col("ids")[0].alias("low"), "v").mapInArrow(placed, f"cls binary, low long, v array<{kind}>, keys array<long>"), "vector-places")

    # Blocks are equal ranges of each curve; a query visits its own and as many on both sides as its
    # window needs, at an end of the curve more on one side.
    looked = min(n, max(math.ceil(window * n), least))
    blocks = max(1, 3 * n // looked, -(-n // rows_per_block))
    reach = max(1, math.ceil((looked * blocks / n - 1) / 2))
    visits = min(blocks, 2 * reach + 1)
    share = [i / blocks for i in range(1, blocks)]
    cuts = at.agg(*(F.percentile_approx(F.col("keys")[c], share, max(10_000, 10 * blocks)).alias(f"c{c}") for c in range(curves))).first() if blocks > 1 else None
    edges = [np.array(cuts[c] if cuts else [], np.int64) for c in range(curves)]
    asked = at.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", F.lit(True).alias("asks"))
    sent = at.join(asked, "cls", "left")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys").flatten().to_numpy().reshape(-1, curves)
            asks = np.flatnonzero(b.column("asks").fill_null(False).to_numpy(zero_copy_only=False))
            for c in range(curves):
                block = np.searchsorted(edges[c], keys[:, c], side="right")
                first = np.clip(block[asks] - reach, 0, blocks - visits)
                who = np.concatenate([np.arange(len(block)), np.tile(asks, visits)])
                to = np.concatenate([block, *(first + step for step in range(visits))])
                role = np.concatenate([np.zeros(len(block), np.int8), np.ones(len(asks) * visits, np.int8)])
                for a in range(0, len(who), 1 << 14):
                    take = pa.array(who[a : a + (1 << 14)])
                    cols = [pa.array(c * blocks + to[a : a + (1 << 14)], pa.int64()), pa.array(role[a : a + (1 << 14)]), *(b.column(name).take(take) for name in ("cls", "low", "v"))]
                    yield pa.RecordBatch.from_arrays(cols, names=["block", "role", "cls", "low", "v"])

    def visit(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        names, low = np.array(table.column("cls").to_pylist(), "S16"), table.column("low").to_numpy()
        x = _vectors(table.column("v").combine_chunks())
        there, asking = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out = []
        for a in range(0, len(asking) if len(there) else 0, 512):
            q = asking[a : a + 512]
            out += [f.tobytes() for f in _best(x[q], x[there], names[there], low[there], k + 1)]
        asked = [n.ljust(16, b"\0") for n in names[asking[: len(out)]]]
        return pa.table({"cls": pa.array(asked, pa.binary()), "found": pa.array(out, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(f, FOUND) for f in table.column("found").to_pylist()])
        best = _ranked(found, k + 1)
        return pa.table({"cls": pa.array([table.column("cls")[0].as_py()] * len(best), pa.binary()), "hit": pa.array([n.ljust(16, b"\0") for n in best["cls"]], pa.binary())})

    hits = sent.mapInArrow(dealt, f"block long, role byte, cls binary, low long, v array<{kind}>").groupBy("block").applyInArrow(visit, "cls binary, found binary")
    hits = written(hits.groupBy("cls").applyInArrow(merge, "cls binary, hit binary"), "vector-hits")
    discard(at)

    # The exact measure, summed in the order of the components, and the ids that a class stands for.
    mine = classes.select("cls", F.col("v").cast("array<double>").alias("qv"))
    theirs = classes.select(F.col("cls").alias("hit"), "ids", F.col("v").cast("array<double>").alias("cv"))
    score = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = hits.join(theirs, "hit").join(mine, "cls").select("cls", "ids", score.alias("score"))
    by_class = scored.select("cls", "score", F.explode("ids").alias("cand")).groupBy("cls").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("cand").alias("cand"))).alias("all"))
    by_class = written(by_class.select("cls", F.slice(F.sort_array("all"), 1, k + 1).alias("best")), "vector-results")
    picked = queries.join(by_class, "cls").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["cand"] != F.col("id")), 1, k).alias("best"))
    return picked.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.cand").alias(id_col), (-F.col("b.far")).alias("score"))

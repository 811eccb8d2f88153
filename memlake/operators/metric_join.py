"""Exact joins of close vectors: cells around pivots, cut by the triangle inequality.

Angles are a metric.  Each row's home is the cell of its nearest pivot.  A row
also visits the cells that may hold a home row within the threshold: those whose
pivot is no farther than the cell's radius and the threshold together, nor than
its own pivot and twice the threshold.  Rows meet in the cells only, by blocks of a
bounded size, as products of matrices; tiles whose distances from the pivot
differ by more than the threshold are passed over.  How many pivots pay off is
measured on a sample: data without clusters is joined in one cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memlake.functions.vectors import norm, normalized
from memlake.scratch import cut

#: What is added to bounds, so that rounding loses no pair.
SLACK = 1e-6
#: Rows that pivots are chosen among, and those that each number of pivots is tried on.
SAMPLE, TRIED = 4096, 1024
PIVOTS = (1, 8, 32, 128)
#: Bytes of vectors in a block, rows of a side whose products are one matrix, and pairs sent at once.
BLOCK_BYTES, TILE, OUT = 16 << 20, 2048, 1 << 16


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles; the shorter vectors count as followed by zeros."""
    n = min(x.shape[1], pivots.shape[1])
    return np.arccos(np.clip(x[:, :n] @ pivots[:, :n].T, -1, 1))


def _rows(vectors: list) -> np.ndarray:
    """One row a vector, followed by zeros to the longest one's length."""
    size = max((len(v) for v in vectors), default=1)
    if all(len(v) == size for v in vectors):
        return np.array(vectors, np.float64).reshape(len(vectors), size)
    return np.array([np.pad(np.asarray(v, np.float64), (0, size - len(v))) for v in vectors])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if (np.diff(column.offsets.to_numpy()) * len(column) == len(flat)).all() else _rows(column.to_pylist())


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the farthest from those before it."""
    took = [0]
    least = _angles(x, x[[0]])[:, 0]
    while len(took) < min(n, len(x)):
        took.append(int(least.argmax()))
        least = np.minimum(least, _angles(x, x[[took[-1]]])[:, 0])
    return x[took]


def visits(angles: np.ndarray, radius: np.ndarray, theta: float) -> np.ndarray:
    """Which cells each row has to be in, its home among them."""
    near = angles <= np.minimum(radius[None] + theta, angles.min(axis=1, keepdims=True) + 2 * theta) + SLACK
    near[np.arange(len(angles)), angles.argmin(axis=1)] = True
    return near


def chosen_pivots(x: np.ndarray, theta: float) -> np.ndarray:
    """The pivots with the fewest pairs left to compare, judged on a sample."""
    best, least = x[:1], math.inf
    for n in PIVOTS:
        pivots = far_apart(x, n)
        some = x[:TRIED]
        a = _angles(some, pivots)
        home, radius = a.argmin(axis=1), np.zeros(len(pivots))
        np.maximum.at(radius, home, a.min(axis=1))
        held = visits(a, radius, theta)
        cost = (np.bincount(home, minlength=len(pivots)) * held.sum(axis=0)).sum() + 4.0 * held.sum()
        if cost < 0.9 * least:
            best, least = pivots, cost
    return best


def radii(units: DataFrame, pivots: np.ndarray) -> np.ndarray:
    """The largest angle of each pivot's own rows."""

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = _angles(_matrix(b.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(a.argmin(axis=1).astype(np.int32)), pa.array(a.min(axis=1))], names=["home", "d"])

    far = units.select("v").mapInArrow(angles, "home int, d double").groupBy("home").agg(F.max("d").alias("d"))
    out = np.full(len(pivots), -math.inf)
    for r in far.collect():  # one row a pivot
        out[r.home] = r.d
    return out


def placed(units: DataFrame, theta: float, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """``units`` (``v`` and others) once a cell: ``cell``, ``home``, and the angle ``d`` to the cell's pivot."""
    kept = [f.name for f in units.schema if f.name != "v"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = _angles(_matrix(b.column("v")), pivots)
                row, cell = np.nonzero(visits(a, radius, theta))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in (*kept, "v")), pa.array(cell.astype(np.int32)), pa.array(a.argmin(axis=1)[row].astype(np.int32)), pa.array(a[row, cell])], names=[*kept, "v", "cell", "home", "d"])

    schema = units.select(*kept, "v").schema.add("cell", "integer").add("home", "integer").add("d", "double")
    return units.mapInArrow(deal, schema)


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, v, __n, …)`` with unit vectors and a number of the row, as a written table; null and zero vectors, and those of no finite length, are close to none."""
    size = norm(F.col(vector_col))
    v = vectors.where((size > 0) & (size < math.inf) & ~F.isnan(size))
    return cut(v.select(F.col(id_col).alias("id"), normalized(F.col(vector_col)).alias("v"), *keep, F.monotonically_increasing_id().alias("__n")), "units")


def sides(units: DataFrame, blocks: int) -> int:
    """Into how many blocks rows are dealt: so many that their pairs are ``blocks`` cells of a grid, and that none is much over ``BLOCK_BYTES``."""
    size = units.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first().n * 8
    return max(1, math.isqrt(blocks), -(-size // BLOCK_BYTES))


def _pivots(units: DataFrame, theta: float) -> np.ndarray:
    some = units.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).select("v").collect()  # a bounded sample
    return chosen_pivots(_rows([r.v for r in some]), theta) if some else np.ones((1, 1))


def _theta(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold)))


def _block(side: int) -> Column:
    return F.pmod(F.xxhash64("__n"), F.lit(side)).cast("int")


def _numbers(low: Column | int, high: Column | int) -> Column:
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(to(low) <= to(high), F.sequence(to(low), to(high))).otherwise(F.array().cast("array<int>"))


def _held(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    """A group's rows but for their vectors, and these as a matrix: all are of one length."""
    tables, parts = [], []
    for b in batches:
        parts.append(_matrix(b.column("v")))
        tables.append(pa.Table.from_batches([b.drop_columns(["v"])]))
    return pa.concat_tables(tables), np.concatenate(parts)


def _near_products(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, theta: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y``, and products, of pairs with a product over ``least``; by tiles of rows whose distances from the pivot differ by ``theta`` at most."""
    ox, oy = np.argsort(dx, kind="stable"), np.argsort(dy, kind="stable")
    far = dy[oy]
    for i in range(0, len(x), TILE):
        rows = ox[i : i + TILE]
        low, high = np.searchsorted(far, [dx[rows[0]] - theta - SLACK, dx[rows[-1]] + theta + SLACK])
        for j in range(low, high, TILE):
            cols = oy[j : min(j + TILE, high)]
            s = x[rows] @ y[cols].T
            a, b = np.nonzero(s > least)
            if len(a):
                yield rows[a], cols[b], s[a, b]


def close_pairs(vectors: DataFrame, threshold: float, blocks: int, id_col: str = "id", vector_col: str = "vector", keep: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """``(a, b, sim, …)``: pairs ``a < b``, each once, among them all with a cosine of ``threshold`` or more; ``within`` columns are equal.

    The rows of a cell meet by blocks, two and two, whose products are matrices.
    """
    units, theta = unit_rows(vectors, id_col, vector_col, (*keep, *within)), _theta(threshold)
    pivots = _pivots(units, theta)
    side = sides(units, 2 * blocks)
    # Of two homes, the visitor comes from the one of the larger number: each pair meets once.
    rows = placed(units, theta, pivots, radii(units, pivots)).where("cell <= home").withColumn("__p", _block(side)).withColumn("__size", F.size("v"))
    either = F.transform(_numbers(0, side - 1), lambda q: F.struct(F.least("__p", q).alias("__i"), F.greatest("__p", q).alias("__j")))
    dealt = rows.withColumn("__g", F.explode(either)).select("*", "__g.*").drop("__g", "__n")
    kept = [units.schema[c] for c in ("id", *keep)]
    schema = T.StructType([T.StructField(f"{f.name}_{s}", f.dataType) for s in "xy" for f in kept] + [T.StructField("sim", T.DoubleType())] + [units.schema[c] for c in within])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = _held(batches)
        cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "__i", "__j"))
        home, p, d = (table.column(c).to_numpy() for c in ("home", "__p", "d"))
        left, right = np.flatnonzero(p == i), np.flatnonzero(p == j)
        for a, b, s in _near_products(v[left], v[right], d[left], d[right], theta, threshold - SLACK):
            a, b = left[a], right[b]
            own = ((home[a] == cell) | (home[b] == cell)) & ((a < b) if i == j else True)
            a, b, s = a[own], b[own], s[own]
            for k in range(0, len(a), OUT):
                x, y = pa.array(a[k : k + OUT]), pa.array(b[k : k + OUT])
                out = [table.column(f.name).take(t).combine_chunks() for t in (x, y) for f in kept]
                out += [pa.array(s[k : k + OUT])] + [table.column(c).take(x).combine_chunks() for c in within]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    met = dealt.groupBy("cell", "__i", "__j", "__size", *within).applyInArrow(meet, schema).where("id_x <> id_y")
    swap = F.col("id_x") > F.col("id_y")
    first, second = ([F.when(swap, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")) for c in ("id", *keep)] for s, t in ("xy", "yx"))
    kept_a, kept_b = ([e.alias(f"{c}_{s}") for e, c in zip(some[1:], keep, strict=True)] for some, s in ((first, "a"), (second, "b")))
    return met.select(first[0].alias("a"), second[0].alias("b"), "sim", *kept_a, *kept_b, *within)


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of each ``a``'s ``k`` pairs of the highest rounded scores, of equals those of the smallest ``b``, in order of ``a``."""
    order = np.lexsort((b, -np.round(s, 6), a))
    a = a[order]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    return order[np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]


def nearest_between(left: DataFrame, right: DataFrame, k: int, threshold: float, blocks: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``(src, dst, score)``: among them the ``k`` most similar rows of ``right`` of another id for each of ``left``, of a cosine of ``threshold`` or more.

    A block of one side meets a block of the other, and sends on the ``k`` best
    of each row only; of equal ones, by six digits, those of the smallest ids.
    """
    theta, lefts, rights = _theta(threshold), unit_rows(left, id_col, vector_col), unit_rows(right, id_col, vector_col)
    pivots = _pivots(lefts, theta)
    radius = radii(lefts, pivots)
    side = max(sides(lefts, blocks), sides(rights, blocks))
    deal = lambda rows, own, other: rows.withColumn(own, _block(side)).withColumn(other, F.explode(_numbers(0, side - 1)))
    one = deal(placed(lefts, theta, pivots, radius).where("cell = home"), "__i", "__j").withColumn("asks", F.lit(True))
    two = deal(placed(rights, theta, pivots, radius), "__j", "__i").withColumn("asks", F.lit(False))
    dealt = one.unionByName(two).withColumn("__size", F.size("v")).drop("home", "__n")
    schema = T.StructType([T.StructField("src", lefts.schema["id"].dataType), T.StructField("dst", rights.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = _held(batches)
        asks, d = table.column("asks").to_numpy(), table.column("d").to_numpy()
        # Rows by their ids, so that of equal scores the smaller id is the smaller place.
        by_id = pc.sort_indices(table.column("id")).to_numpy()
        ids = pc.rank(table.column("id"), sort_keys="ascending", tiebreaker="dense").to_numpy()
        of, to = by_id[asks[by_id]], by_id[~asks[by_id]]
        if not len(of) or not len(to):
            return
        for x in range(0, len(of), TILE):
            rows = of[x : x + TILE]
            worst = np.full(len(rows), threshold - SLACK)
            a, b, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for y in range(0, len(to), TILE):
                cols = to[y : y + TILE]
                if np.subtract(d[rows].min(), d[cols].max()) > theta + SLACK or np.subtract(d[cols].min(), d[rows].max()) > theta + SLACK:
                    continue
                p = v[rows] @ v[cols].T
                r, c = np.nonzero(p > worst[:, None])
                other = ids[rows[r]] != ids[cols[c]]
                r, c = r[other], c[other]
                a, b, s = np.append(a, r), np.append(b, y + c), np.append(s, p[r, c])
                best = _best(a, b, s, k)
                a, b, s = a[best], b[best], s[best]
                full = np.flatnonzero(np.bincount(a, minlength=len(rows)) == k)
                # Of the last of each full row, what is less by over a rounding cannot be among the best.
                last = np.searchsorted(a, full, side="right") - 1
                worst[full] = np.maximum(worst[full], s[last] - SLACK)
            if len(a):
                yield pa.RecordBatch.from_arrays([table.column("id").take(pa.array(rows[a])).combine_chunks(), table.column("id").take(pa.array(to[b])).combine_chunks(), pa.array(s)], names=schema.names)

    return dealt.groupBy("cell", "__i", "__j", "__size").applyInArrow(meet, schema)

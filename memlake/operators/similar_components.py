"""Components of close vectors, without a list of all their links.

Where many rows are close, links grow with the square of the rows, but a few a
row join them.  Equal rows are joined to one of them first.  Then the rows of
a block meet each other and one block that all share, which joins most rows
to the largest component of their group.  Only the rows outside it go on to meet
all others, so every link between two components is found; of those within one, no
more is computed.  Tasks send on links between the names of components only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from memlake.operators import metric_join as M
from memlake.operators.graph import components
from memlake.operators.vector_store import cells
from memlake.scratch import cut, drop

#: Rows of a block of the first meeting, and of a side whose products are one matrix.
ROWS, TILE = 4096, 1024
#: A component of this share of the rows at hand meets the others as a whole.
LARGE = 8


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, by which each name points to the smallest one it is joined to, after the links ``a`` to ``b``."""
    while True:
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _touched(x: np.ndarray, front: np.ndarray, left: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the rows ``left`` are close to one of ``front``."""
    hit = np.zeros(len(left), bool)
    for i in range(0, len(front), TILE):
        rows = x[front[i : i + TILE]]
        todo = np.flatnonzero(~hit)
        for j in range(0, len(todo), TILE):
            some = todo[j : j + TILE]
            hit[some] = (rows @ x[left[some]].T > threshold).any(axis=0)
    return hit


def joined(x: np.ndarray, name: np.ndarray, threshold: float) -> np.ndarray:
    """For each name, numbered from 0, the smallest one that close rows join it to."""
    root, left = np.arange(name.max() + 1), np.arange(len(x))
    while len(left):
        of = root[name[left]]
        names, sizes = np.unique(of, return_counts=True)
        if len(names) == 1:
            return root
        if sizes.max() * LARGE < len(left):
            break
        # What the largest reaches leaves with it: none of it is close to what stays.
        found = names[[sizes.argmax()]]
        reached = found
        while len(found) and len(left):
            new = np.isin(root[name[left]], found)
            front, left = left[new], left[~new]
            found = np.unique(root[name[left[_touched(x, front, left, threshold)]]])
            reached = np.append(reached, found)
        root = united(root, reached[1:], np.full(len(reached) - 1, reached[0]))
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(i, len(left), TILE):
            b = left[j : j + TILE]
            of_a, of_b = root[name[a]], root[name[b]]
            if of_a.min() == of_a.max() == of_b.min() == of_b.max():
                continue
            p, q = np.nonzero(x[a] @ x[b].T > threshold)
            root = united(root, of_a[p], of_b[q])
    return root


def _links(dealt: DataFrame, threshold: float, *groups: str) -> DataFrame:
    """``(src, dst)``: of each group's rows ``(name, v)`` each name to the smallest that it is joined to."""
    kind = dealt.schema["name"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = M._held(batches)
        names = table.column("name").combine_chunks()
        number = pc.rank(names, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        root = joined(v, number, threshold)
        at = np.zeros(len(root), np.int64)
        at[number] = np.arange(len(number))
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[moved])), names.take(pa.array(at[root[moved]]))], names=["src", "dst"])

    return dealt.groupBy(*groups).applyInArrow(meet, f"src {kind}, dst {kind}")


def _hash(n: Column | int) -> Column:
    return F.pmod(F.xxhash64("__n"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def similar_components(vectors: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", within: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """``(node, component)``: components of vectors above the cosine threshold, named by their smallest id; columns of ``within`` must be equal and not null."""
    blocks = blocks or cells(vectors)
    nodes = vectors.select(F.col(id_col).alias("id")).distinct()
    whole = reduce(lambda df, c: df.where(F.col(c).isNotNull()), (id_col, *within), vectors)
    units = M.unit_rows(whole, id_col, vector_col, within)
    group = [*within, "__size"]
    # Equal rows have equal links, and are close to each other.
    equal = threshold < 1 - M.SLACK
    one = cut(units.groupBy(*within, "v").agg(F.min("id").alias("id"), F.min("__n").alias("__n"), F.count("*").alias("__copies")) if equal else units.withColumn("__copies", F.lit(1)), "rows")
    copies = units.join(one.where("__copies > 1").select(*within, "v", F.col("id").alias("dst")), [*within, "v"]).where("id <> dst").select(F.col("id").alias("src"), "dst")
    rows = one.withColumn("__size", F.size("v")).select("id", "v", "__n", *group)
    most = F.least(F.lit(ROWS), F.greatest(F.lit(1), F.floor(F.lit(M.BLOCK_BYTES) / (8 * F.col("__size")))))
    sizes = cut(rows.groupBy(*group).agg(F.count("*").alias("__rows")).withColumn("__side", F.when(F.col("__rows") <= 2 * most, 1).otherwise(F.ceil(F.col("__rows") / most)).cast("int")), "sizes")
    dealt = rows.join(sizes, group).withColumn("__j", _hash(F.col("__side")))
    dealt = dealt.withColumn("__j", F.explode(F.when(F.col("__j") == 0, F.sequence(F.least(F.lit(1), F.col("__side") - 1), F.col("__side") - 1)).otherwise(F.array("__j"))))
    links = cut(copies.union(_links(dealt.select(F.col("id").alias("name"), "v", *group, "__j"), threshold, *group, "__j")), "links")
    labels = cut(components(nodes, links), "labels")
    drop(units, links)

    # Groups of one block have met whole; of the others, rows outside the largest component have not.
    parts = sizes.where("__side > 1").select(*group)
    named = cut(rows.select("id", "__n", *group).join(parts, group).join(labels.withColumnRenamed("node", "id"), "id"), "named")
    largest = cut(named.groupBy(*group, "component").agg(F.count("*").alias("n")).groupBy(*group).agg(F.max_by("component", "n").alias("largest")), "largest")
    marked = named.join(largest, group).withColumn("rest", F.col("component") != F.col("largest"))
    count = {r.rest: r.b for r in marked.groupBy("rest").agg(F.sum(F.col("__size") * 8).alias("b")).collect()}  # two rows
    if not count.get(True):
        return labels
    full = cut(rows.join(marked.select("__n", "rest", F.col("component").alias("name")), "__n"), "marked")
    of_rest = max(1, math.isqrt(2 * blocks * count[True] // sum(count.values())), -(-count[True] // M.BLOCK_BYTES))
    of_largest = max(-(-blocks // of_rest), -(-count.get(False, 0) // M.BLOCK_BYTES))
    theta, pivots = M._theta(threshold), M._pivots(full, M._theta(threshold))
    met = M.placed(full, theta, pivots, M.radii(full, pivots)).where("cell <= home")
    met = met.withColumn("__p", F.when(F.col("rest"), _hash(of_rest)).otherwise(of_rest + _hash(of_largest)))
    others = F.sequence(F.lit(0), F.when(F.col("rest"), of_rest + of_largest - 1).otherwise(of_rest - 1))
    met = met.withColumn("__q", F.explode(others)).withColumn("__i", F.least("__p", "__q")).withColumn("__j", F.greatest("__p", "__q"))
    more = cut(_links(met.select("name", "v", *group, "cell", "__i", "__j"), threshold, *group, "cell", "__i", "__j"), "more-links")
    drop(full)
    names = components(labels.select(F.col("component").alias("id")).distinct(), more).where("node <> component").toDF("component", "name")
    return labels.join(names, "component", "left").select("node", F.coalesce("name", "component").alias("component"))

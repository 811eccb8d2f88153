"""Walks over links between close vectors, without a list of all links.

Where links grow with the square of the rows, a walk that stops at its answer needs
those of a few rows only.  Each step opens some rows for each question, and these
meet all vectors by packs of a bounded size, whose products are one matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memlake.functions.vectors import norm, normalized
from memlake.operators.chunking import BATCH_BYTES
from memlake.operators.metric_join import OUT, TILE, _matrix
from memlake.operators.vector_store import cells
from memlake.scratch import cut, drop

#: What a link costs at least: no cosine is over one.
LEAST = 1.0


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with vectors ``v`` by up to ``TILE`` to a row, of vectors of one length: each column a list of its values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column("v")).to_numpy()
            for size in np.unique(sizes):
                some = b.filter(pa.array(sizes == size))
                for k in range(0, some.num_rows, TILE):
                    part = some.slice(k, TILE)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns], names=part.schema.names)

    return rows.mapInArrow(pack, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema]))


def _codes(values: pa.Array, known: pa.Array, missing: int) -> np.ndarray:
    """Places of values among those known; ``missing`` for nulls and others."""
    return pc.fill_null(pc.index_in(values, value_set=known), missing).to_numpy(zero_copy_only=False)


def relaxed(front: dict[str, pa.Array], rows: dict[str, pa.Array], threshold: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Questions, ids and costs of the links from one pack to another that cost a question no more than an answer that it has.

    An answer among the rows is known here by one of the question's labels.
    """
    x, y = _matrix(front["v"]), _matrix(rows["v"])
    if x.shape[1] != y.shape[1]:
        return
    sim = np.floor(x @ y.T * 1e6 + 0.5) / 1e6
    of_front, of_rows = (_codes(t["id"], pc.unique(front["id"]), -1) for t in (front, rows))
    m, p = np.nonzero(sim >= threshold)
    other = of_front[m] != of_rows[p]
    m, p = m[other], p[other]
    step = 1 / sim[m, p]

    asks = front["asks"].flatten()
    query, label = asks.field("query_id"), asks.field("label")
    cost = asks.field("cost").to_numpy(zero_copy_only=False)
    names, kinds = pc.unique(query), pc.unique(label).drop_null()
    q, own = _codes(query, names, -1), _codes(rows["id"], names, -1)
    wanted, kind = _codes(label, kinds, -1), _codes(rows["label"], kinds, -2)
    end = np.full(len(names), math.inf)
    np.minimum.at(end, q, asks.field("end").to_numpy(zero_copy_only=False))

    count = pc.list_value_length(front["asks"]).to_numpy()
    first = np.cumsum(count) - count
    n = count[m]
    upto = np.cumsum(n)
    k = 0
    while k < len(m):
        # Links of so many questions at once, those of one link at least.
        to = max(k + 1, int(np.searchsorted(upto, upto[k] - n[k] + OUT, side="right")))
        link = np.repeat(np.arange(k, to), n[k:to])
        ask = first[m[link]] + np.arange(len(link)) - (upto[link] - n[link] - (upto[k] - n[k]))
        k = to
        c, at, of = cost[ask] + step[link], p[link], q[ask]
        answers = (wanted[ask] == kind[at]) & (of != own[at])
        np.minimum.at(end, of[answers], c[answers])
        kept = np.flatnonzero(c <= end[of])
        c, at, of = c[kept], at[kept], of[kept]
        order = np.lexsort((c, at, of))
        c, at, of = c[order], at[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])])) if len(c) else order
        yield names.take(pa.array(of[new])), rows["id"].take(pa.array(at[new])), pa.array(c[new])


def _opened(front: DataFrame, packs: DataFrame, threshold: float) -> DataFrame:
    """``(query_id, id, cost)``: what each question reaches over one link from its rows in ``front``."""
    ask = front.schema["asks"].dataType.elementType.elementType
    schema = T.StructType([ask["query_id"], T.StructField("id", packs.schema["id"].dataType.elementType), ask["cost"]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                side = lambda names: {c: b.column(f"{names}{c}")[i].values for c in (("id", "v", "label") if not names else ("id", "v", "asks"))}  # noqa: B023, E731
                for found in relaxed(side("f_"), side(""), threshold):
                    yield pa.RecordBatch.from_arrays(list(found), names=schema.names)

    conf = packs.sparkSession.conf
    if conf.get(BATCH_BYTES, None) in (None, "-1"):
        conf.set(BATCH_BYTES, str(8 << 20))
    both = packs.crossJoin(front.select(*[F.col(c).alias(f"f_{c}") for c in front.columns]))
    return both.mapInArrow(meet, schema).groupBy("query_id", "id").agg(F.min("cost").alias("cost"))


def walks_to_answers(vectors: DataFrame, seeds: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """``(query_id, id, cost)``: for each question, all rows that are no dearer than its cheapest answer.

    Rows of ``vectors`` ``(id, vector, label)`` are linked where their cosine, by six
    digits, is ``threshold`` or more, at the cost of its inverse; ``seeds`` has
    ``(query_id, id, cost)``.  Answers are the rows with a label that ``wanted``
    ``(query_id, label)`` gives the question, but for the one it is named by.  A
    step opens a question's cheapest row that is not done, and those that are dearer
    by less than a link: none of them can become cheaper, so each is opened once.
    A row that no link leads on from within the answer's cost is not opened.
    """
    rows = vectors.where("id is not null")
    size = norm(F.col("vector"))
    unit = rows.where((size > 0) & (size < math.inf) & ~F.isnan(size))
    to_unit = normalized(F.col("vector")).alias("v")
    packs = cut(_packed(unit.repartition(cells(vectors)).select("id", to_unit, "label")), "packs")
    wanted = wanted.where("label is not null").distinct()
    one = wanted.groupBy("query_id").agg(F.min("label").alias("label"))
    kinds = rows.select("id", "label")

    def flagged(reached: DataFrame, todo: Column) -> DataFrame:
        hit = reached.select("query_id", "id").where("query_id <> id").join(wanted, "query_id").join(kinds, ["id", "label"], "left_semi").select("query_id", "id").distinct().withColumn("answer", F.lit(True))
        return reached.join(hit, ["query_id", "id"], "left").select("query_id", "id", "cost", todo.alias("todo"), F.coalesce("answer", F.lit(False)).alias("answer"))

    have = cut(flagged(seeds.groupBy("query_id", "id").agg(F.min("cost").alias("cost")), F.lit(True)))
    while True:
        ends = have.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("answer"), F.col("cost"))), F.lit(math.inf)).alias("end"))
        live = have.join(ends, "query_id").where("cost <= end")
        open_ = live.where(F.col("todo") & (F.col("cost") + LEAST <= F.col("end")))
        low = open_.groupBy("query_id").agg(F.min("cost").alias("low"))
        front = cut(open_.join(low, "query_id").where(F.col("cost") < F.col("low") + LEAST).select("query_id", "id", "cost", "end"), "front")
        if front.isEmpty():
            drop(packs)
            return live.select("query_id", "id", "cost")
        asks = front.join(one, "query_id", "left").groupBy("id").agg(F.collect_list(F.struct("query_id", "cost", "end", "label")).alias("asks"))
        asked = cut(_packed(unit.join(asks, "id").select("id", to_unit, "asks")), "asked")
        new = cut(_opened(asked, packs, threshold), "reached")
        done = front.select("query_id", "id", "cost", F.lit(False).alias("todo"), F.lit(False).alias("answer"))
        every = live.select("query_id", "id", "cost", "todo", "answer").unionByName(done).unionByName(flagged(new, F.lit(True)))
        # The least cost, and of equal ones that which is done.
        least = every.groupBy("query_id", "id").agg(F.min(F.struct("cost", "todo")).alias("s"), F.max("answer").alias("answer"))
        before, have = have, cut(least.select("query_id", "id", "s.cost", "s.todo", "answer"))
        drop(before, front, asked, new)

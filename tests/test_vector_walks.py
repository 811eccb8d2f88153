"""Walks over links between close vectors, against a heap in plain Python."""

import heapq
import math
import random

import pytest

from memlake.operators import vector_walks as W
from memlake.plans import catalog

catalog.load()


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def cheapest(rows, seeds, labels, query, threshold):
    """Ids may repeat, each with a vector and a label of its own."""
    near = {}
    whole = [(i, v) for i, v, _ in rows if i is not None and v and any(v)]
    for a, x in whole:
        for b, y in whole:
            if a != b and len(x) == len(y) and (w := math.floor(cosine(x, y) * 1e6 + 0.5) / 1e6) >= threshold:
                near.setdefault(a, []).append((b, 1 / w))
    best, heap = {}, [(c, i) for i, c in seeds]
    heapq.heapify(heap)
    while heap:
        c, i = heapq.heappop(heap)
        if i not in best:
            best[i] = c
            for y, s in near.get(i, ()):
                heapq.heappush(heap, (c + s, y))
    answers = {i for i, _, k in rows if k is not None and k in labels and i != query}
    end = min((best[a] for a in answers if a in best), default=math.inf)
    return {i: c for i, c in best.items() if c <= end}


@pytest.mark.parametrize("sizes", [(2048, 1 << 16), (7, 10)])
def test_walks_stop_at_answers(spark, monkeypatch, sizes):
    """Answers near, far, out of reach and of no label; ids that repeat, vectors that are null, zero and of another length."""
    monkeypatch.setattr(W, "TILE", sizes[0])
    monkeypatch.setattr(W, "OUT", sizes[1])
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], r.choice([1, 2, 2, 3, None])) for i in range(90)]
    rows += [(i, [r.gauss(0, 1) for _ in range(6)], r.choice([1, 9])) for i in (0, 5, 5)]
    rows += [(90, None, 1), (91, [0.0] * 6, 2), (92, [1.0, 2.0], 2), (93, [1.0, 2.1], 7), (None, rows[3][1], 3), (94, rows[4][1], None), (95, rows[4][1], 8)]
    asked = {0: {1, 9}, 1: {2}, 2: {77}, 3: {3}, 4: {8}, 5: set(), 90: {1}, 92: {2}, 93: {2}, 95: {8, 3}}
    seeds = [(q, q, 0.0) for q in asked] + [(1, 40, 0.5), (3, 41, 2.0)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(3)
    wanted = spark.createDataFrame([(q, k) for q, ks in asked.items() for k in ks], "query_id long, label int")
    got = {}
    for x in W.walks_to_answers(vectors, spark.createDataFrame(seeds, "query_id long, id long, cost double"), wanted, 0.7).collect():
        assert x.id not in got.setdefault(x.query_id, {})
        got[x.query_id][x.id] = x.cost
    for q, labels in asked.items():
        want = cheapest(rows, [(i, c) for s, i, c in seeds if s == q], labels, q, 0.7)
        assert got[q] == pytest.approx(want)
    assert any(len(x) > 60 for x in got.values()) and any(1 < len(x) < 30 for x in got.values())


def test_walks_write_no_list_of_links(spark, tmp_path, monkeypatch):
    """Of 400 rows that are all close, 79,800 links were written for four questions; now what they reach within their answers' cost."""
    written = []
    for module in ("memlake.operators.vector_walks", "memlake.operators.graph", "memlake.operators.metric_join"):
        m = __import__(module, fromlist=["cut"])
        monkeypatch.setattr(m, "cut", lambda df, name="step", real=m.cut: written.append(real(df, name)) or written[-1])
        monkeypatch.setattr(m, "drop", lambda *tables: None, raising=False)
    r = random.Random(3)
    rows = [(i, [1.0] + [r.gauss(0, 0.05) for _ in range(7)], i % 2) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i,) for i in range(4)], "item_id long").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.QUERIES["answer_walks"](spark, str(tmp_path)).collect()
    assert {x.query_id for x in got} == {0, 1, 2, 3}
    assert max(t.count() for t in written) <= 4 * 400

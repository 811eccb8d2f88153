"""Path lengths by sketches, and walks of many questions with an early stop."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import graph as G


def random_graph(n, m, seed):
    r = random.Random(seed)
    edges = {(i, r.randrange(i)) for i in range(1, n)} | {tuple(r.sample(range(n), 2)) for _ in range(m)}
    return sorted(edges)


def frames(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "id int"), spark.createDataFrame(edges, "src int, dst int")


def exact(n, edges):
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = {}
    for s in range(n):
        seen, front, d = {s}, [s], 0
        while front:
            out[d] = out.get(d, 0) + len(front)
            front = list({y for x in front for y in near[x]} - seen)
            seen |= set(front)
            d += 1
    return out


@pytest.mark.parametrize("n, m", [(300, 60), (1200, 900)])
def test_sketched_paths_are_close(spark, n, m):
    edges = random_graph(n, m, n)
    by = exact(n, edges)
    pairs = sum(k for d, k in by.items() if d)
    mean = sum(d * k for d, k in by.items()) / pairs
    diameter, about = G.path_metrics(*frames(spark, n, edges))
    assert abs(about - mean) < 0.05 * mean and abs(diameter - max(by)) <= 0.1 * max(by)
    got = dict(map(tuple, G.neighbourhood(*frames(spark, n, edges)).collect()))
    for d in range(diameter + 1):
        total = sum(k for e, k in by.items() if e <= d)
        assert abs(got[d] - total) < 0.05 * total


def test_metrics_of_larger_graphs_are_estimated(spark):
    edges = random_graph(150, 40, 7)
    one, two = (G.graph_metrics(*frames(spark, 150, edges), optional=True, exact_paths=k).first() for k in (10, 1000))
    assert abs(one.mean_path - two.mean_path) < 0.02 * two.mean_path and one.diameter == two.diameter


def test_paths_of_nothing(spark):
    assert G.path_metrics(*frames(spark, 0, [])) == (0, 0.0)
    assert G.path_metrics(*frames(spark, 3, [])) == (0, 0.0)
    assert G.path_metrics(*frames(spark, 3, [(1, 1)])) == (0, 0.0)


def cheapest(n, edges, seeds, concepts, answers):
    near = [[] for _ in range(n)]
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            if set(concepts[y]) - set(concepts[x]):
                near[x].append((y, 1 / w))
    best, heap = {}, [(c, i) for i, c in seeds]
    heapq.heapify(heap)
    while heap:
        c, i = heapq.heappop(heap)
        if i in best:
            continue
        best[i] = c
        for y, s in near[i]:
            heapq.heappush(heap, (c + s, y))
    end = min((best[a] for a in answers if a in best), default=float("inf"))
    return {i: c for i, c in best.items() if c <= end}


@pytest.mark.parametrize("delta", [0.5, 3.0, 100.0])
def test_each_question_stops_at_its_answer(spark, delta):
    r = random.Random(5)
    n = 120
    edges = [(a, b, r.choice([0.25, 0.5, 1.0, 2.0])) for a, b in random_graph(n, 200, 9)]
    concepts = [sorted(r.sample("abcdefgh", 3)) for _ in range(n)]
    asked = {q: ([(r.randrange(n), r.choice([0.0, 1.0])) for _ in range(2)], [r.randrange(n) for _ in range(k)]) for q, k in ((1, 1), (2, 3), (3, 0), (4, 1))}
    seeds = spark.createDataFrame([(q, i, c) for q, (s, _) in asked.items() for i, c in s], "query_id int, id int, cost double")
    answers = spark.createDataFrame([(q, a) for q, (_, t) in asked.items() for a in t], "query_id int, id int")
    e = spark.createDataFrame(edges, "src int, dst int, weight double")
    c = spark.createDataFrame(list(enumerate(concepts)), "id int, concepts array<string>")
    got = {}
    for row in G.best_first_batch(e, seeds, c, answers, delta).collect():
        got.setdefault(row.query_id, {})[row.id] = row.cost
    assert got == {q: cheapest(n, edges, s, concepts, t) for q, (s, t) in asked.items()}


def test_path_counts_are_exact(spark):
    """Two hubs of 3,000 and 500 leaves at the ends of a path, a ring and lone nodes: sketches were off by some."""
    edges = [(0, i) for i in range(100, 3100)] + [(3, i) for i in range(4000, 4500)] + [(0, 1), (1, 2), (2, 3), (3, 2), (3, 3), (3, 9999)]
    edges += [(10 + i, 10 + (i + 1) % 5) for i in range(5)]
    ids = [*range(4), *range(10, 15), *range(50, 60), *range(100, 3100), *range(4000, 4500)]
    got = list(map(tuple, G.path_counts(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")).orderBy("dist").collect()))
    leaves, other, ring = 3000, 500, 5
    new = [len(ids), 2 * (leaves + other + 3) + 2 * ring, leaves * (leaves - 1) + other * (other - 1) + 2 * (leaves + other) + 4 + 2 * ring, 2 * (leaves + other) + 2, 2 * (leaves + other), 2 * leaves * other]
    assert got == [(d, sum(new[: d + 1])) for d in range(6)]

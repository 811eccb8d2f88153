"""Joins of close vectors and the vector index, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import metric_join as M
from memlake.operators.vector_index import VectorIndex
from memlake.operators.vector_store import knn_join, similar_pairs, topk


def clustered(spark, n=600, clusters=20, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, 16))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)


def all_pairs(x, t):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    return {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] > t}


@pytest.mark.parametrize("spread, t", [(0.05, 0.9), (0.3, 0.8), (3.0, 0.5), (0.05, -0.2)])
def test_close_pairs_are_all_found_once(spark, spread, t):
    x, df = clustered(spark, spread=spread)
    got = [(r.a, r.b) for r in similar_pairs(df, t).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, t)


def test_few_pairs_meet_where_rows_cluster(spark):
    """With 20 tight clusters the pairs whose products are computed are near a twentieth of all."""
    x, df = clustered(spark, n=2000)
    met = M.close_pairs(df, 0.9, 4).count()
    assert len(all_pairs(x, 0.9)) <= met < 0.1 * 2000 * 1999 / 2


def test_one_cell_where_they_do_not(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 32))
    assert len(M.chosen_pivots(x / np.linalg.norm(x, axis=1)[:, None], M._theta(0.3))) == 1


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "u"), (2, [2.0, 0.0], "u"), (3, [0.0, 0.0], "u"), (4, None, "u"), (5, [1.0, None], "u"), (6, [1.0, 0.0, 0.0], "u"), (7, [1.0, 0.1, 0.0], "u"), (8, [3.0, 0.0], "w"), (9, [float("nan"), 1.0], "u")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, g string")
    assert {(r.a, r.b) for r in similar_pairs(df, 0.9).collect()} == {(1, 2), (1, 8), (2, 8), (6, 7)}
    assert {(r.a, r.b, r.g) for r in similar_pairs(df, 0.9, within=("g",)).collect()} == {(1, 2, "u"), (6, 7, "u")}
    assert {(r.a, r.b, r.g_a, r.g_b) for r in similar_pairs(df.where("id <> 2"), 0.9, keep=("g",)).collect()} == {(1, 8, "u", "w"), (6, 7, "u", "u")}
    assert similar_pairs(df.limit(0), 0.9).count() == 0


def test_knn_join_with_a_threshold(spark):
    x, df = clustered(spark, n=400, spread=0.3)
    y, other = clustered(spark, n=300, spread=0.3, seed=4)
    got = {(r.src, r.dst, r["rank"]) for r in knn_join(df, other, 3, 0.6).collect()}
    u, v = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    s = np.round(u @ v.T, 6)
    want = set()
    for a in range(len(x)):
        near = sorted((b for b in range(len(y)) if b != a and s[a, b] >= 0.6), key=lambda b: (-s[a, b], b))[:3]
        want |= {(a, b, k + 1) for k, b in enumerate(near)}
    assert got == want


def test_a_block_sends_on_the_best_only(spark):
    """Of 400 rows that are all similar to each other each block sends on two a row, equal ones by the smaller id."""
    rng = np.random.default_rng(5)
    x = 1 + 0.01 * rng.normal(size=(400, 8))
    x[::4] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    assert M.nearest_between(df, df, 2, 0.5, 9).count() <= 400 * 2 * 3
    near = {(r.src, r["rank"]): r.dst for r in knn_join(df, df, 2, 0.5).collect()}
    assert [near[0, 1], near[0, 2], near[4, 1], near[4, 2], near[396, 1], near[396, 2]] == [4, 8, 0, 8, 0, 4]


def test_pairs_are_products_of_blocks(spark):
    """No product is an expression a pair: the plan has the group function, and no fold over zipped vectors after it."""
    x, df = clustered(spark, n=50)
    plan = similar_pairs(df, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan


def test_rows_of_one_name_share_no_block(spark):
    """Phrases repeat: rows are dealt by their number, so those of one name do not fill one block."""
    units = M.unit_rows(spark.range(400).select(F.lit("same").alias("id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector")).repartition(4), "id", "vector")
    sizes = [r["count"] for r in units.groupBy(M._block(4)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200


@pytest.fixture
def index(spark, tmp_path):
    def make(vectors, metric="cosine", **how):
        ix = VectorIndex(spark, f"{tmp_path}/{metric}", metric)
        ix.fit(vectors, **how)
        return ix

    return make


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_index_recall_and_work(spark, index, metric):
    """A quarter of the cells and 6 % of the rows reranked find over nine in ten of the nearest; all cells and rows find all."""
    x, df = clustered(spark, n=1000, clusters=40, spread=0.4)
    ix = index(df, metric, cells=16, codes=32)
    ix.add(df.where("id % 2 = 0"))
    ix.add(df.where("id % 2 = 1"))
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    exact = {(r.query_id, r.id): (r["rank"], round(r.score, 5)) for r in topk(df, asked, 10, metric).collect()}
    some = {(r.query_id, r.id) for r in ix.search(asked, 10, probes=4, rerank=60).collect()}
    assert len(some & set(exact)) >= 0.9 * len(exact)
    whole = {(r.query_id, r.id): (r["rank"], round(r.score, 5)) for r in ix.search(asked, 10, probes=16, rerank=1000).collect()}
    assert whole == exact


def test_index_adds_deletes_and_prunes(spark, index):
    x, df = clustered(spark, n=300, clusters=8)
    odd = spark.createDataFrame([(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15)], "id long, vector array<double>")
    ix = index(df, cells=8, codes=16)
    ix.add(df.union(odd).union(df.limit(5)))
    assert ix.rows().count() == 300
    ix.delete(spark.range(50))
    ix.add(df.where("id < 10 or id = 60").withColumn("vector", F.transform("vector", lambda v: -v)))
    assert sorted(r.id for r in ix.rows().collect()) == [*range(10), *range(50, 300)]
    asked = df.where("id = 60").select(F.col("id").alias("query_id"), (F.transform("vector", lambda v: -v)).alias("query_vector"))
    top = ix.search(asked, 1, probes=1, rerank=20).collect()
    assert [(r.id, round(r.score, 6)) for r in top] == [(60, 1.0)]
    plan = ix.candidates(asked, 1, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_index_by_bounds_is_exact(spark, index, metric):
    """Without a number of rows to rerank, coarse codes of vectors without clusters lose none of the nearest."""
    x, df = clustered(spark, n=1000, clusters=1, spread=1.0)
    ix = index(df, metric, cells=4, parts=4, codes=4)
    ix.add(df)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    exact = {(r.query_id, r.id): (r["rank"], round(r.score, 5)) for r in topk(df, asked, 10, metric).collect()}
    assert {(r.query_id, r.id): (r["rank"], round(r.score, 5)) for r in ix.search(asked, 10, probes=4, rerank=None).collect()} == exact

"""Components of close vectors, against all pairs."""

import numpy as np
import pytest

from memlake.operators import graph as G, metric_join as M, similar_components as C
from memlake.plans import graph_queries as Q


def vectors(spark, x, label=None):
    label = [0] * len(x) if label is None else label
    return spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))], "id long, vector array<double>, label int").repartition(3)


def of_pairs(x, t, label):
    """Each row's component by all pairs."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = (u @ u.T > t) & (np.asarray(label)[:, None] == np.asarray(label)[None])
    out = np.arange(len(x))
    while True:
        low = np.array([out[c].min() if c.any() else o for c, o in zip(close, out, strict=True)])
        if (low == out).all():
            return dict(enumerate(out.tolist()))
        out = low


def found(df, t, **more):
    got = [tuple(r) for r in C.similar_components(df, t, **more).select("node", "component").collect()]
    assert len(got) == len(set(got))
    return dict(got)


@pytest.mark.parametrize("clusters, spread, t, apart", [(30, 0.05, 0.99, True), (400, 0.05, 0.7, False), (5, 3.0, 0.75, True), (5, 3.0, 0.97, False)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, clusters, spread, t, apart):
    """Blocks of 16 rows, and sides of 4 kB, so many links are found by the rows left over."""
    monkeypatch.setattr(C, "ROWS", 16)
    monkeypatch.setattr(M, "BLOCK_BYTES", 4096)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters, 8))
    x = centres[rng.integers(0, clusters, 500)] + spread * rng.normal(size=(500, 8))
    label = rng.integers(0, 2, 500)
    want = of_pairs(x, t, label if apart else np.zeros(500))
    assert found(vectors(spark, x, label), t, within=("label",) if apart else ()) == want


@pytest.mark.parametrize("t", [0.2, 0.6, 0.8, 0.95])
def test_joined_in_one_task(monkeypatch, t):
    """Names that rows share from the start, one of them with most rows."""
    monkeypatch.setattr(C, "TILE", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    name = np.unique(np.where(rng.random(200) < 0.4, 17, rng.integers(0, 120, 200)), return_inverse=True)[1]
    root = np.arange(name.max() + 1)
    want = C.united(root.copy(), *(name[k] for k in np.nonzero(x @ x.T > t)))
    assert (C.joined(x, name, t) == want).all()


def test_a_chain_over_all_blocks(spark, monkeypatch):
    """Each row is close to the next only, so the largest component of a block is a few rows."""
    monkeypatch.setattr(C, "ROWS", 16)
    turn = np.linspace(0, 3, 100)
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)[np.random.default_rng(1).permutation(100)]
    assert set(found(vectors(spark, x), np.cos(3 / 99 * 1.1)).values()) == {0}


def test_odd_rows(spark):
    rows = [(5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], None), (8, [1.0, 0.0], None), (1, [0.0, 0.0], 1), (2, None, 1), (4, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.1, 0.0], 1)]
    rows += [(10, [0.0, 1.0], 2), (11, [1.0, 0.0], 2), (12, [0.0, 1.0], 2), (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    # An id of two vectors joins what is close to either; a null label equals none; lengths differ.
    alone = {k: k for k in (1, 2, 4, 6, 7, 8, 9, None)}
    assert found(df, 0.9, within=("label",)) == alone | {3: 3, 5: 3, 10: 10, 11: 10, 12: 10}
    assert found(df.limit(0), 0.9, within=("label",)) == {}


def test_copies_are_joined_under_any_threshold(spark):
    x = np.repeat(np.random.default_rng(2).normal(size=(4, 6)), 50, axis=0)
    names = found(vectors(spark, x), 0.99)
    assert names == {k: k // 50 * 50 for k in range(200)}


def test_links_do_not_grow_with_the_square(spark, monkeypatch, tmp_path):
    """Of 600 vectors that are all close, 179,700 pairs are no rows of any table written."""
    rng = np.random.default_rng(4)
    x = 1 + 0.1 * rng.normal(size=(600, 8))
    df = vectors(spark, x)
    df.selectExpr("id AS vec_id", "CAST(vector AS array<float>) AS embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    written = []

    def counted(df, name="step", cut=G.cut):
        out = cut(df, name)
        written.append(out.count())
        return out

    for module in (G, M, C):
        monkeypatch.setattr(module, "cut", counted)
    assert {r.component for r in Q.graph_components(spark, str(tmp_path)).collect()} == {0}
    assert max(written) <= 2 * 600


def test_only_rows_outside_the_largest_component_meet_all(spark, monkeypatch):
    """Of 1,000 close rows and 5 far ones in blocks of 50, the last meeting has each close row once a cell."""
    monkeypatch.setattr(C, "ROWS", 50)
    rng = np.random.default_rng(6)
    x = np.concatenate([1 + 0.1 * rng.normal(size=(1000, 8)), np.eye(8)[:5] * [[1, -1] * 4] - 1])
    met = []

    def counted(dealt, threshold, *groups, links=C._links):
        met.append(dealt.count())
        return links(dealt, threshold, *groups)

    monkeypatch.setattr(C, "_links", counted)
    want = of_pairs(x, 0.8, [0] * len(x))
    assert found(vectors(spark, x), 0.8, blocks=8) == want and len(set(want.values())) > 1
    assert len(met) == 2 and met[0] <= 2 * 1005 + 200 and met[1] <= 1000 + 5 * 20

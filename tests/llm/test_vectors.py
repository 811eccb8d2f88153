import math

import numpy as np
import pytest

from memlake.llm.vector_search import hilbert_keys, nearest


def brute(rows, k=20, every=20):
    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    x = np.array([v for _, v in good]) if good else np.zeros((0, 1))
    ids = np.array([i for i, _ in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            score = np.cumsum(x * v, axis=1)[:, -1]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for v in out.values():
        v.sort()
        assert [r for r, _, _ in v] == list(range(1, len(v) + 1))
    return {q: [(i, s) for _, i, s in v] for q, v in out.items()}


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbouring_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)].astype(int), axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)).round(2).tolist()
    rows = [(i, base[i % 60]) for i in range(150)] + [(1000 + i, base[7]) for i in range(80)]
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0] * 7 + [float("nan")]), (260, [None] + [1.0] * 7), (280, [float("inf")] * 8), (None, base[3]), (300, [-0.0] * 7 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got, want = found(nearest(df)), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert got == want
    for few in (df.limit(0), df.where("vec_id = 20"), df.where("vec_id in (20, 21)")):
        assert found(nearest(few)) == {q: v for q, v in brute([(r.vec_id, r.embedding) for r in few.collect()]).items() if v}


def test_ties_go_to_the_smaller_id(spark):
    """Small whole numbers: very many different vectors tie at every place; some rows are repeated."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in rng.permutation(2000).tolist()]
    again = [r for r in rows if r[0] in (3, 20, 40)] * 30
    got = found(nearest(spark.createDataFrame(rows + again, "vec_id long, embedding array<float>").repartition(4), least=10_000))
    assert got == brute(rows)


def test_fewer_products_than_exact_search():
    """On a table far above ``least``, all curves' windows together hold fewer rows than the table."""
    import inspect

    p = {k: v.default for k, v in inspect.signature(nearest).parameters.items()}
    for n in (10_000, 1_000_000, 10**9):
        looked = max(math.ceil(p["window"] * n), p["least"])
        blocks = max(1, 3 * n // looked, -(-n // p["rows_per_block"]))
        reach = max(1, math.ceil((looked * blocks / n - 1) / 2))
        assert p["curves"] * (2 * reach + 1) / blocks < 1


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    got, want = found(nearest(df)), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    assert all(len(v) == 20 for v in got.values())

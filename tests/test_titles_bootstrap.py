"""Nearest titles within reach and beyond, and the bootstrap over many different scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import evaluation as ev


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _edited(rng, t, d):
    for _ in range(d):
        at, kind = rng.randrange(len(t) + 1), rng.randrange(3)
        t = t[:at] + (rng.choice("abcdXY ") if kind else "") + t[at + (kind != 1):]
    return t


def test_titles_in_every_reach(spark):
    rng = random.Random(7)
    titles = {"".join(rng.choice("abcdefAB ") for _ in range(rng.randrange(0, 25))) for _ in range(70)} | {"", "a", "Ab", "ab", "é"}
    names = {_edited(rng, rng.choice(sorted(titles)), rng.randrange(0, 8)) for _ in range(70)} | {"", "q", "z" * 40}
    n, t = (spark.createDataFrame([(x,) for x in sorted(xs)] + [(None,)], f"{c} string") for xs, c in ((names, "name"), (titles, "title")))
    want = {x: min((_distance(x.lower(), y.lower()), y) for y in titles) for x in names}
    assert {r.name: (r.distance, r.nearest) for r in ev.nearest_titles(n, t).collect()} == want
    assert ev.nearest_titles(n, t.where("title is null")).count() == 0 and ev.nearest_titles(n.where("name is null"), t).count() == 0


def test_few_pairs_share_a_segment(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))
    titles = [word() for _ in range(300)]
    t = spark.createDataFrame([(x, len(x)) for x in titles], "t string, size int")
    n = spark.createDataFrame([(_edited(rng, x, 2),) for x in titles], "n string")
    assert 300 <= ev._sharing_segments(n, t, 2).count() < 330


@pytest.mark.parametrize("kind", ["normal", "skewed", "few"])
def test_interval_as_of_plain_draws(spark, kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(5, 2, 4000), "skewed": rng.lognormal(0, 1.5, 4000), "few": rng.integers(0, 2, 900).astype(float)}[kind]
    got = ev.bootstrap_interval(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "score double"), samples=4000, blocks=64).first()
    plain = np.array([rng.choice(x, len(x)).mean() for _ in range(4000)])
    width = np.quantile(plain, 0.975) - np.quantile(plain, 0.025)
    assert got.mean == pytest.approx(x.mean())
    assert abs(got.low - np.quantile(plain, 0.025)) < 0.08 * width and abs(got.high - np.quantile(plain, 0.975)) < 0.08 * width
    assert got.high - got.low == pytest.approx(width, rel=0.08)


def test_a_million_scores(spark):
    df = spark.range(1_000_000).select((F.rand(3) * 10).alias("score"))
    got = ev.bootstrap_interval(df, samples=1000).first()
    assert got.high - got.low == pytest.approx(2 * 1.96 * 10 / np.sqrt(12) / 1000, rel=0.1) and got.low < got.mean < got.high


def test_no_scores(spark):
    assert tuple(ev.bootstrap_interval(spark.createDataFrame([(None,)], "score double"), samples=10).first()) == (None, None, None)

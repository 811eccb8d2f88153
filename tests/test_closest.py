"""The closest name of a table against difflib over all pairs."""

import difflib
import random
import re

import pytest

from memlake.operators.closest import close_candidates, closest_names


def plain(names, candidates, cutoff):
    out = {}
    for n in {x for x in names if x is not None}:
        known = [c for c in set(candidates) if c is not None]
        best = max(((difflib.SequenceMatcher(None, c, n).ratio(), c) for c in known), default=None)
        if n in known:
            out[n] = (n, 1.0)
        elif best and best[0] >= cutoff:
            out[n] = (best[1], best[0])
    return out


def run(spark, names, candidates, cutoff):
    n = spark.createDataFrame([(x,) for x in names], "name string")
    c = spark.createDataFrame([(x,) for x in candidates], "candidate string")
    return {r.name: (r.closest, r.ratio) for r in closest_names(n, c, cutoff=cutoff).collect()}


def edited(r, text):
    s = list(text)
    for _ in range(r.randint(0, 4)):
        k = r.randrange(len(s) + 1)
        s[k : k + r.randint(0, 1)] = r.choice(["", r.choice("abcd ")])
    return "".join(s)


@pytest.mark.parametrize("cutoff", [0.95, 0.8, 0.72, 0.5, 0.0])
def test_as_difflib_over_all_pairs(spark, cutoff):
    r = random.Random(int(cutoff * 100))
    candidates = ["".join(r.choices("abcd ", k=r.randint(0, 24))) for _ in range(120)] + [None, "", "a", "ab"]
    names = [edited(r, c or "") for c in candidates for _ in range(2)] + [None, "", "b", "ba", "zzzz"]
    assert run(spark, names, candidates, cutoff) == plain(names, candidates, cutoff)


def test_part_names(spark, sf_dir):
    """The query's rows, and with other cutoffs."""
    from memlake.plans import catalog

    catalog.load()
    p = sorted({r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect()})
    names = [re.sub("[eo]", "", x) for x in p]
    got = {r.name: (r.closest, r.ratio) for r in catalog.QUERIES["closest_parts"](spark, sf_dir).collect()}
    assert got == plain(names, p, 0.8) and got
    assert run(spark, names, p, 0.9) == plain(names, p, 0.9)


def test_few_pairs_are_compared(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=14)) for _ in range(1000)]
    c = spark.createDataFrame([(w,) for w in words], "text string")
    n = spark.createDataFrame([(w[:5] + "X" + w[6:],) for w in words], "text string")
    assert 1000 <= close_candidates(n, c, 0.8).count() < 0.15 * 1000 * 1000


def test_nothing(spark):
    assert run(spark, [], ["a"], 0.8) == {} and run(spark, ["a"], [], 0.8) == {}

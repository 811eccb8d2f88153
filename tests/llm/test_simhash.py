import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from memlake.llm.components import connected_components
from memlake.llm.simhash import Forest, _link_runs, fingerprint_links, simhash_dedup

BIG = 1 << 63


def brute(rows):
    fps = []
    for _, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    kinds = np.array(sorted(set(fps)), np.uint64)
    root = {int(f): int(f) for f in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(kinds):
        for g in kinds[i + 1 :][np.bitwise_count(kinds[i + 1 :] ^ f) <= 4]:
            root[find(int(f))] = find(int(g))
    low = {}
    for (i, _), f in zip(rows, fps):
        low[find(f)] = min(low.get(find(f), BIG), BIG if i is None else i)
    return sorted(((i, f"{f:016x}", None if low[find(f)] == BIG else low[find(f)]) for (i, _), f in zip(rows, fps)), key=str)


def test_matches_brute_force(documents, odd_docs, no_docs):
    for df in (documents, odd_docs, no_docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in simhash_dedup(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 40])
def test_few_documents(spark, documents, n):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").limit(n).collect()]
    for some in (rows, [(1, "one")] * n):
        assert sorted((tuple(r) for r in simhash_dedup(spark.createDataFrame(some, "doc_id long, text string")).collect()), key=str) == brute(some)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 10**6), st.sampled_from([3, 64, 4096]))
def test_groups_lose_no_link(centre, seed, wide):
    """All fingerprints lie near one; half of them agree in their low half."""
    rng = np.random.default_rng(seed)
    flips = [sum(1 << int(b) for b in rng.choice(np.arange(32 * (i % 2), 64), int(rng.integers(0, 9)), replace=False)) for i in range(150)]
    fps = np.unique(np.array([centre ^ f for f in flips], np.uint64))
    keys = fps & np.uint64(0xFFFFFFFF)
    forest = Forest(len(fps))
    _link_runs(fps, keys, np.arange(len(fps)), fps >> np.uint64(32), forest, wide)
    want = Forest(len(fps))
    a, b = np.nonzero((np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (keys[:, None] == keys[None, :]))
    want.add(a, b)
    assert len(forest.edges()) == len(want.edges())


def test_links_join_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    fps = {0}
    while len(fps) < 3000:
        fps.add(int(rng.choice(list(fps)[-50:])) ^ (1 << int(rng.integers(0, 64))))
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4), 8).collect()
    assert len(links) < 8 * len(fps)
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(out) == len(fps) and len({r.component for r in out}) == 1


@pytest.mark.parametrize("n", [1, 2, 60])
def test_components_of_chains(spark, n):
    links = [(10 * k + i, 10 * k + i + 1) for k in range(n) for i in (5, 0, 3, 1, 4, 2)] + [(7, 7)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert out == {10 * k + i: 10 * k for k in range(n) for i in range(7)}

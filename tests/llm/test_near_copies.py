import re
from fractions import Fraction

import corpus_pipeline as cp
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memlake.llm import simhash as S
from memlake.llm.shingles import WIDE, similar, wide_fingerprint


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Ids that stay: the smallest of each group (null last), once a group."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s == sets[j] or (both and 5 * both >= 4 * len(s | sets[j])):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low.setdefault(find(i), []).append((k is None, k or 0, k))
    return sorted([min(v)[2] for v in low.values()], key=str)


@pytest.fixture(scope="module")
def edited():
    """Ten base texts, each with 30 copies of 0 to 12 % replaced words, at random."""
    rng = np.random.default_rng(5)
    rows = []
    for b in range(10):
        base = rng.integers(0, 5000, 60 * (b + 1))
        for _ in range(31):
            copy = base.copy()
            at = rng.choice(len(base), int(rng.integers(0, 1 + len(base) // 8)), replace=False)
            copy[at] = rng.integers(5000, 10**6, len(at))
            rows.append((int(rng.integers(0, 10**9)), " ".join(map(str, copy))))
    return rows


def check(got, rows, recall=1.0):
    """The smallest id of each true group stays, and of the rows that should go at least the share ``recall`` goes."""
    want, got = brute(rows), sorted(got, key=str)
    left = list(got)
    for i in want:
        left.remove(i)  # fails where a row went that should not
    assert len(rows) - len(got) >= recall * (len(rows) - len(want))


def test_edited_copies(spark, sf_dir, edited):
    """Copies of any similarity from 0.5 on; fingerprints may miss a few that are barely similar."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in edited], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    check([r.doc_id for r in cp.near_copies(spark, df, sf_dir).collect()], edited, 0.97)


def test_runs_agree(spark, sf_dir, edited):
    """The same rows stay, however the input is dealt over partitions."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in edited], "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(r.doc_id for r in cp.near_copies(spark, df.repartition(n), sf_dir).collect()) for n in (1, 7)]
    assert got[0] == got[1]


def test_documents_and_odd_rows(spark, sf_dir, documents, odd_docs, no_docs):
    for df in (documents, odd_docs, no_docs):
        out = cp.near_copies(spark, df, sf_dir).collect()
        check([r.doc_id for r in out], [(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("words", [8, 30, 100, 300, 1000])
def test_recall_by_length(spark, sf_dir, words):
    """Pairs of texts with one word in fifty replaced, at least one: alone with their partner, they are found by the segments only."""
    rng = np.random.default_rng(words)
    rows = []
    for b in range(200):
        base = rng.integers(0, 10**6, words)
        copy = base.copy()
        at = rng.choice(words, max(1, words // 50), replace=False) if words > 60 else [words - 1]
        copy[at] = rng.integers(10**6, 2 * 10**6, len(at))
        rows += [(2 * b, " ".join(map(str, base))), (2 * b + 1, " ".join(map(str, copy)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(50)
    check([r.doc_id for r in cp.near_copies(spark, df, sf_dir).collect()], rows, 0.9)


def test_wide_fingerprint_is_a_majority():
    rng = np.random.default_rng(3)
    assert wide_fingerprint(np.empty(0, np.uint64)) == bytes(8 * WIDE)
    for n in (1, 2, 5, 254, 255, 256, 1000):
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        one = [np.unpackbits(np.frombuffer(wide_fingerprint(s[k : k + 1]), np.uint8)).astype(int) for k in range(n)]
        assert (np.unpackbits(np.frombuffer(wide_fingerprint(s), np.uint8)) == (2 * np.sum(one, axis=0) > n)).all()


def test_fingerprints_tell_similarity():
    rng = np.random.default_rng(7)
    mean, most = S.distance_bounds(Fraction("0.8"))
    d = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        y = np.concatenate([x[: 400 - 44], rng.integers(0, 2**63, 44).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        assert similar(x, y, Fraction("0.8")) and not similar(x, y, Fraction("0.81"))
        d.append(np.unpackbits(np.frombuffer(wide_fingerprint(x), np.uint8) ^ np.frombuffer(wide_fingerprint(y), np.uint8)).sum())
    assert abs(np.mean(d) - mean) < 3 and max(d) <= most


@pytest.mark.parametrize("rows_per_bucket", [1, 100_000])
def test_segments_join_a_large_group(spark, rows_per_bucket):
    """Fingerprints a few bits from one centre: links grow with the group, not with its square, whether balls are sent or not."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2, 512)
    rows = []
    for i in range(3000):
        f = base ^ (rng.random(512) < 0.05) if i % 2 else rng.integers(0, 2, 512)
        rows.append((i, bytearray(np.packbits(f).tobytes())))
    df = spark.createDataFrame(rows, "node long, fp binary").withColumn("digest", F.unhex(F.md5("fp"))).repartition(3)
    pairs = [tuple(r) for r in S.wide_pairs(df, 3000, 110, rows_per_bucket).collect()]
    assert len(pairs) <= S.SEGMENTS * 1500 * (1 if rows_per_bucket > 1 else 1 + S.BALL_BITS) and len(set(pairs)) == len(pairs)
    assert all(a < b and a % 2 and b % 2 for a, b in pairs)
    trees = tree_of(3000, pairs)
    assert len({trees[i] for i in range(1, 3000, 2)}) == 1


def test_a_cut_bucket_loses_no_link(spark):
    """Leaves near one centre, and for each another that is near its leaf only, all under one segment: a cut joins them as a whole bucket does."""
    rng = np.random.default_rng(11)
    width, base = S.SEGMENT_BITS, rng.integers(0, 2, 512)
    rows = [base]
    for _ in range(150):
        leaf = base.copy()
        at = [rng.choice(width, 10, replace=False) + width * j for j in range(1, S.SEGMENTS)]
        leaf[np.concatenate([a[:5] for a in at])] ^= 1
        far = leaf.copy()
        far[np.concatenate([a[5:] for a in at])] ^= 1
        rows += [leaf, far]
    rows = [(i, bytearray(np.packbits(f, bitorder="little").tobytes())) for i, f in enumerate(rows)]
    df = spark.createDataFrame(rows, "node long, fp binary").withColumn("digest", F.unhex(F.md5("fp"))).repartition(3)
    for rows_per_bucket in (100_000, 20, 2):
        pairs = [tuple(r) for r in S.wide_pairs(df, len(rows), 110, rows_per_bucket).collect()]
        assert all(a < b for a, b in pairs) and len(set(pairs)) == len(pairs)
        assert set(tree_of(len(rows), pairs)) == {0}


@pytest.mark.parametrize("pairs, apart", [(100, True), (20, False), (100, False), (300, False)])
def test_recall_does_not_fall_with_the_group(spark, sf_dir, pairs, apart):
    """Copies b of one text with one word replaced, and for each a c with four more: c is similar to its own b only."""
    rng = np.random.default_rng(pairs)
    rows, fresh, base = [], iter(range(10**6, 10**9)), rng.integers(0, 10**6, 200)

    def edit(text, n):
        out = text.copy()
        out[rng.choice(len(out), n, replace=False)] = [next(fresh) for _ in range(n)]
        return out

    for k in range(pairs):
        b = edit(rng.integers(0, 10**6, 200) if apart else base, 1)
        rows += [(2 * k + 1, b), (2 * k + 2, edit(b, 4))]
    rows = [(i, " ".join(map(str, w))) for i, w in ([(0, base)] if not apart else []) + rows]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    check([r.doc_id for r in cp.near_copies(spark, df, sf_dir).collect()], rows, 0.95)


def tree_of(n, pairs):
    """The smallest of each connected group of 0 to n - 1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(5, 60))
def test_met_connects_all_that_is_near_under_a_key(seed, radius):
    """Random walks from a few centres, so that some rows are near a done one only."""
    rng = np.random.default_rng(seed)
    fps = [rng.integers(0, 2**63, WIDE).astype(np.uint64)]
    for _ in range(40):
        flips = np.packbits(rng.random(64 * WIDE) < rng.choice([0.01, 0.05, 0.1])).view(np.uint64)
        fps.append(fps[int(rng.integers(0, len(fps)))] ^ flips)
    fps = np.array(fps)
    keys = rng.integers(0, 3, 41).astype(np.uint64)
    got = S._met(np.concatenate([keys, keys + np.uint64(9)]), np.concatenate([np.arange(41)] * 2), fps, radius)
    far = S._apart(fps[:, None], fps[None])
    a, b = np.nonzero((far <= radius) & (keys[:, None] == keys[None]))
    assert all(far[x, y] == d <= radius and keys[x] == keys[y] for x, y, d in got.tolist())
    assert tree_of(41, got[:, :2].tolist()) == tree_of(41, zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("tile_bytes", [1 << 20, 2000])
def test_tiles_link_what_is_similar(spark, tile_bytes):
    """Members of two clusters, some of one label, against all pairs; one tile, and many."""
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for i in range(120):
        s = np.unique(rng.choice(60 if i % 2 else 1000, 40)).astype(np.uint64) if i % 5 or not i else sets[i - 5][:-2]
        sets[i] = s
        rows.append((i, i % 2, 1000 + i % 2 if i % 3 == 0 else i, bytearray(wide_fingerprint(s)), bytearray(s.tobytes())))
    df = spark.createDataFrame(rows, "node long, cluster long, label long, fp binary, set binary").repartition(3)
    t = Fraction("0.6")
    got = [tuple(r) for r in S.tile_links(df, 512, t, tile_bytes).collect()]
    label = {r[0]: r[2] for r in rows}
    want = [(a, b) for a in range(120) for b in range(a + 1, 120) if a % 2 == b % 2 and label[a] != label[b] and similar(sets[a], sets[b], t)]
    assert want and {tuple(sorted(p)) for p in got} <= set(want)
    same = [(a, b) for a in range(120) for b in range(a) if label[a] == label[b]]
    assert tree_of(120, got + same) == tree_of(120, want + same)


def test_one_row_of_a_repeated_id_stays(spark, sf_dir):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e\nf", "en", "s", 11), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted([r.doc_id for r in cp.near_copies(spark, df, sf_dir).collect()], key=str) == [1, None]


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "n1", 1.0), (2, "A b c d e f", 8, "n2", 2.0), (3, "x", 9, "n3", 3.0)], "doc_id long, text string, `__row` int, node string, id double")
    out = S.near_copy_dedup(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e f", 7, "n1", 1.0), (3, "x", 9, "n3", 3.0)]

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memlake.llm import queries as Q
from memlake.llm.periodic_runs import periodic_runs, scan_texts
from memlake.llm.resampling import ranked, resample
from memlake.llm.sharding import hypergeometric, matrix_row, shard_rows, shard_sizes, split_draw, write_shards


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- periodic runs -----------------------------------------------------------


def brute_runs(words, min_exp=4, min_len=6):
    """Every stretch with its smallest period, kept where long enough and not extended by a neighbour."""
    out, n = [], len(words)
    for s in range(n):
        for e in range(s + min_len, n + 1):
            q = next(q for q in range(1, e - s + 1) if all(words[k] == words[k + q] for k in range(s, e - q)))
            if e - s < min_exp * q or s and words[s - 1] == words[s - 1 + q] or e < n and words[e] == words[e - q]:
                continue
            out.append((s, e - s, q))
    return out


def run_row(doc_id, text, runs):
    words = words_of(text)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def plant(doc_id, text):
    words, n = words_of(text), len(words_of(text))
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))


def fast_runs(words, min_exp=4, min_len=6):
    """Plain: each lag's stretches, the smallest lag of equal ones."""
    out = {}
    for p in range(1, len(words) // min_exp + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(min_len, min_exp * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=36), st.integers(2, 5))
def test_scan_matches_the_definition(words, min_exp):
    want = brute_runs(words, min_exp)
    got = scan_texts([" ".join(words).encode()], min_exp, 6)[1]
    assert sorted(map(tuple, got[:, 1:].tolist())) == sorted(want) == fast_runs(words, min_exp)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 5))
def test_long_periods_in_ranges(seed, parts):
    """Periods on both sides of the shifts that are compared everywhere, several documents at once, lags in ranges."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(4):
        words = []
        while len(words) < rng.integers(0, 2000):
            q = int(rng.integers(1, 90))
            piece = rng.integers(0, 3 if rng.random() < 0.5 else 1000, q).tolist()
            words += (piece * 9)[: int(q * rng.uniform(1, 9))] + rng.integers(0, 2, int(rng.integers(0, 20))).tolist()
        texts.append(" ".join(map(str, words)))
    want = [(d, *r) for d, t in enumerate(texts) for r in fast_runs(t.split())]
    got = [tuple(r) for k in range(parts) for r in scan_texts([t.encode() for t in texts], 4, 6, (k, parts))[1].tolist()]
    least = {}
    for d, s, n, q in got:
        least[d, s, n] = min(q, least.get((d, s, n), q))
    assert sorted((*k, q) for k, q in least.items()) == sorted(want)


def test_op11_matches_brute_force(spark, sf_dir, documents):
    rows = [(r.doc_id, plant(r.doc_id, r.text)) for r in documents.collect()]
    got = sorted(tuple(r) for r in Q.op11_periodic_runs(spark, sf_dir).collect())
    assert got == sorted(run_row(i, t, fast_runs(words_of(t))) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > len(rows) // 20


@pytest.mark.parametrize("long_bytes", [1 << 16, 40])
def test_runs_of_odd_rows(spark, odd_docs, no_docs, long_bytes):
    """Nulls, empty texts, repeated rows, clashing columns; every longer text in ranges of lags."""
    for df in (odd_docs, no_docs):
        out = periodic_runs(df, long_bytes=long_bytes)
        got = sorted((tuple(r)[:8] for r in out.collect()), key=str)
        assert got == sorted((run_row(r.doc_id, r.text, fast_runs(words_of(r.text))) for r in df.collect()), key=str)
        for r in out.collect():
            assert len(r.runs) == r.n_runs and sha(r.collapsed_text) == r.collapsed_sha256


def test_planted_runs_of_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + []
    got = sorted(((r.doc_id, words_of(r.text)) for r in Q.planted_runs(odd_docs).collect()), key=str)
    assert got == sorted(((i, words_of(plant(i, t))) for i, t in rows), key=str)


# --- sharding ----------------------------------------------------------------


def test_large_populations_are_drawn_like_small_ones():
    """The draw by order statistics has the mean and variance of the hypergeometric."""
    for good, bad, sample in ((300, 700, 400), (5000, 100, 3000), (40, 9000, 500), (1000, 1000, 1)):
        rng = np.random.default_rng(good)
        x = np.array([hypergeometric(rng, good, bad, sample, population=20) for _ in range(4000)])
        n, p = good + bad, good / (good + bad)
        var = sample * p * (1 - p) * (n - sample) / (n - 1)
        assert abs(x.mean() - sample * p) < 4 * (var / 4000) ** 0.5 and 0.9 < x.var() / var < 1.1
        assert x.min() >= max(0, sample - bad) and x.max() <= min(good, sample)
    big = hypergeometric(np.random.default_rng(1), 10**11, 3 * 10**11, 10**11)
    assert abs(big - 25 * 10**9) < 10**7


def test_matrix_rows_and_columns_sum(spark):
    sizes = np.array([0, 7, 1, 0, 250, 3, 99, 40, 5])
    upto, room = np.concatenate([[0], np.cumsum(sizes)]), shard_sizes(int(sizes.sum()), 8)
    m = np.array([matrix_row(k, upto, room, 5) for k in range(len(sizes))])
    assert (m >= 0).all() and (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == room).all()
    assert split_draw(np.random.default_rng(0), np.array([2, 0, 3]), 5).tolist() == [2, 0, 3]


def check_shards(out, rows, shards=8):
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == sorted(((i, 1 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) <= set(range(shards)) and [sizes[k] for k in range(shards)] == shard_sizes(len(rows), shards).tolist()
    for k in range(shards):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k]))
    assert all(r.law == "rows" and r.grown_shard is None for r in out)


def test_op12_shards_exactly(spark, sf_dir, documents):
    out = Q.op12_sharding(spark, sf_dir).collect()
    check_shards(out, [(r.doc_id, r.text) for r in documents.collect()])
    again = shard_rows(documents.repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    """Nulls, repeated rows, clashing columns; parts and buckets of a few rows."""
    for df in (odd_docs, no_docs, odd_docs.orderBy("doc_id", "text", "lang").limit(3)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        for per in (250_000, 3):
            check_shards(shard_rows(df, rows_per_part=per).collect(), rows)


def test_equal_rows_fill_no_part(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = shard_rows(df, rows_per_part=100).collect()
    check_shards(out, [(r.doc_id, r.text) for r in df.collect()])
    per_shard = Counter(r.shard for r in out if r.doc_id == 7)
    assert all(180 < per_shard[k] < 320 for k in range(8))  # mean 250, deviation about 10


def test_every_place_is_equally_likely(spark):
    """Each of 40 rows in each of 40 places, over 200 seeds: chi-square within five deviations."""
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    seen = np.zeros((40, 40))
    for seed in range(40):
        for r in shard_rows(df, shards=4, seed=seed, rows_per_part=5).collect():
            seen[r.doc_id, r.shard * 10 + r.slot] += 1
    chi = ((seen - 1) ** 2).sum()
    assert abs(chi - 39 * 39) < 5 * (2 * 39 * 39) ** 0.5


def test_shards_as_files(spark, documents, tmp_path):
    write_shards(documents.withColumn("slot", F.lit("mine")), f"{tmp_path}/out", shards=3, files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, documents.withColumn("slot", F.lit("mine")).collect()))
    sizes = sorted(r["count"] for r in back.groupBy("shard").count().collect())
    assert sizes == sorted(shard_sizes(documents.count(), 3).tolist())


# --- importance resampling ---------------------------------------------------


def brute_resample(docs, target, runs=1, buckets=10_000, percent=10, min_words=20):
    def features(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1))

    all_docs = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in all_docs:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for i, n, f in all_docs:
        weight = sum(c * gain[b] for b, c in f.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_resampling_matches_brute_force(spark, sf_dir, documents, odd_docs, no_docs, runs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for df, percent in ((documents, 10), (odd_docs, 50), (no_docs, 10)):
        got = sorted((tuple(r) for r in resample(df, bench, runs=runs, percent=percent).collect()), key=str)
        assert got == brute_resample([(r.doc_id, r.text) for r in df.collect()], [r.text for r in bench.collect()], runs, percent=percent)


def test_op13_matches_brute_force(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = sorted((tuple(r) for r in Q.op13_importance_resampling(spark, sf_dir).collect()), key=str)
    assert got == brute_resample([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in bench.collect()])


def test_resampling_with_an_empty_target_and_small_groups(spark, documents, no_docs, monkeypatch):
    from memlake.llm import resampling

    monkeypatch.setattr(resampling, "GROUP", 1)
    got = sorted((tuple(r) for r in resample(documents.repartition(9), no_docs, buckets=50).collect()), key=str)
    assert got == brute_resample([(r.doc_id, r.text) for r in documents.collect()], [], buckets=50)


def test_ranks_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("score"), F.col("id"))
    got = ranked(df.repartition(6), [F.col("score").desc(), F.col("id")], rows_per_part=50).orderBy("rank").collect()
    assert [(r.score, r.id, r["rank"]) for r in got] == [(s, i, k + 1) for k, (s, i) in enumerate(sorted(((i % 10, i) for i in range(1000)), key=lambda x: (-x[0], x[1])))]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_importance_resampling"])
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = Q.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)

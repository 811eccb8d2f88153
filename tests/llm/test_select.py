import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm.mixing import mix_schedule, mix_sources, target_sizes
from memlake.llm.quality import classify_quality, keep_quality, text_statistics
from memlake.llm.url_filter import Rule, ShiftAnd, filter_urls

RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


URLS = [None, "", "x", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "http://aorg/x", "http://example.org/es/", "http://x.example.org/es", "http://notexample.org/es/1", "a://example.org/en/1?x#y", "a://example.org/en/2", "a://b.com?/de/", "a://b.com#/de/", "a://b.com/de/x", "a://b.com/x.org/", "a://b.com/fr/" + "z" * 70_000, "a://" + "y." * 40_000 + "com/de/", "a://\u00e9.com/de/\u00e9", "://org/://com/de/"]


def test_urls_match_brute_force(spark, sf_dir):
    odd = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, "http://org/", None, None), (0, None, None, None)], "page_id long, url string, host string, rule int")
    for df in (odd, odd.limit(0), spark.read.parquet(f"{sf_dir}/pages.parquet")):
        rows = [(r.page_id, *judge(r.url, RULES)) for r in df.collect()]
        assert sorted(map(tuple, filter_urls(df, RULES).collect()), key=str) == sorted(rows, key=str)


def glob(rules, host, path):
    """The longest rule's index by regular expressions."""
    said = -1
    for k, r in enumerate(rules):
        one = lambda t, deep: "".join({"*": "[^/]*", "**": ".*" if deep else "[^/]*", "\\*": "\\*"}.get(x, re.escape(x)) for x in re.findall(r"\\\*|\*\*|\*|(?s:.)", t))
        if re.match(f"(?s)[^/]*\\.{one(r.host, False)}{one(r.path, True)}", f".{host}{path}") and (said < 0 or len(r.name) > len(rules[said].name)):
            said = k
    return said


def test_wildcards():
    rules = [Rule("a.com", "/x/*/z", "block"), Rule("a.com", "/**/q", "block"), Rule("b*.net", "/", "block"), Rule("*.c.org", "/*.html", "block"), Rule("a.com", "/\\*/", "allow"), Rule("d.com", "/p*q*r/**", "block"), Rule("**.e.com", "/", "block")]
    hosts = ["a.com", "w.a.com", "b.net", "bb.net", "x.b1.net", "c.org", "u.c.org", "d.com", "e.com", "v.e.com"]
    paths = ["", "/", "/x/y/z", "/x//z", "/x/y/y/z", "/x/z", "/q", "/a/b/q", "/i.html", "/i/j.html", "/*/", "/pqr/", "/p1q2r/3", "/p/q/r/", "/x/y/zz/q"]
    asked = [(h, p) for h in hosts for p in paths]
    best = ShiftAnd(rules).run([f".{h}{p}".encode() for h, p in asked])
    assert best.tolist() == [glob(rules, h, p) for h, p in asked]
    assert set(best.tolist()) == {-1, *range(len(rules))}


def test_wide_masks_take_small_batches(spark):
    rules = [Rule(f"h{i}.net", "/" + "p" * 40, "block") for i in range(8000)]
    assert ShiftAnd(rules).batch * ShiftAnd(rules).words <= 1 << 20
    urls = spark.createDataFrame([(i, f"http://h{i}.net/" + "p" * (39 + i % 2)) for i in range(0, 8000, 37)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in filter_urls(urls, rules).collect()} == {i: "block" if i % 2 else "allow" for i in range(0, 8000, 37)}


def test_many_rules_take_many_words():
    rules = [Rule(f"h{i}.net", f"/p{i % 7}/", "block") for i in range(60)] + [Rule("net", "/", "allow")]
    urls = [f"http://a.h{i}.net/p{k}/q" for i in range(60) for k in range(7)]
    parts = [judge(u, rules) for u in urls]
    best = ShiftAnd(rules).run([b"." + h.encode() + p.encode() for h, p, _, _ in parts])
    assert [rules[i].name for i in best] == [x[2] for x in parts]


def fill(sizes, cap=3.0):
    """Targets by sharing, cutting and resharing until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed = {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in open_))
        over = {s: cap * sizes[s] for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1, None: 50, "d": 0}, {"a": 0, "b": 0}, {"a": 7}, {f"s{i}": 10**i for i in range(6)}])
def test_targets_match_resharing(spark, sizes):
    got = target_sizes(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix(documents, odd_docs, no_docs):
    for df in (documents, odd_docs, no_docs):
        for block in (7, 512):
            rows = mix_sources(df, block=block).collect()
            assert sorted(map(str, rows)) == sorted(map(str, mix_sources(df.repartition(5), block=block).collect()))
            assert len(rows) == df.count()
            text = {r.doc_id: r.text for r in df.collect()}
            total, taken = {}, {}
            for r in rows:
                assert r.size == len([w for w in re.split(r"[\x20\x09-\x0D]+", text[r.doc_id] or "") if w])
                assert 0 <= r.taken <= 3 * r.size
                total[r.source] = total.get(r.source, 0) + r.size
                taken[r.source] = taken.get(r.source, 0) + r.taken
            want = fill(total) if total else {}
            for r in rows:
                assert r.source_size == total[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
                assert abs(taken[r.source] - r.target) <= 1


def test_schedule_is_even(spark):
    t = spark.createDataFrame([(1, 10_000, 10_000, 0.0, 0.25), (2, 30_000, 30_000, 0.25, 1.0)], "sid int, source_size long, want long, lo double, hi double")
    slots = sorted((r.slot, r.sid) for r in mix_schedule(t, 10).collect())
    n = 0
    for k, (_, sid) in enumerate(slots, 1):
        n += sid == 1
        assert abs(n - k / 4) < 6


def brute_scores(docs, labels, shrinkage=0.02):
    """The discriminant written out: two Gaussians with shrunken covariances in units of the pooled spread."""
    f = text_statistics([(t or "").encode() or None for _, t in docs])
    at = {i: k for k, (i, _) in enumerate(docs)}
    y = [(at[i], q) for i, q in labels if i in at and q in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    rows = np.array([k for k, _ in y])
    cls = np.array([q for _, q in y])
    x = f[rows]
    spread = np.sqrt(np.maximum(x.var(axis=0), 1e-12))
    dens = []
    for c in (0, 1):
        z = x[cls == c] / spread
        cov = np.cov(z.T, bias=True)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        d = f / spread - z.mean(axis=0)
        dens.append(np.log((cls == c).mean()) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))


def test_scores_match_brute_force(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in pairs], brute_scores(pairs, [(r.doc_id, r.quality) for r in labels.collect()]), strict=True))
    for r in classify_quality(docs, labels).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (want[r.doc_id] >= 0.3) or abs(want[r.doc_id] - 0.3) < 1e-4
    kept = sorted(r.doc_id for r in keep_quality(docs, labels).collect())
    assert kept == sorted(r.doc_id for r in classify_quality(docs, labels).where("predicted = 1").collect())
    assert keep_quality(docs, labels).columns == docs.columns


def test_kept_odd_rows(spark, sf_dir, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for df in (odd_docs, no_docs):
        want = classify_quality(df, labels).where("predicted = 1").count()
        assert keep_quality(df, labels).count() == want


def test_quality(spark, sf_dir, documents, odd_docs, no_docs):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = classify_quality(docs, labels).join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("hit"), "predicted", "quality")
    assert out.agg(F.avg("hit")).first()[0] > 0.95
    for df in (odd_docs, no_docs):
        for lab in (labels, labels.limit(0), labels.where("quality = 1")):
            rows = classify_quality(df, lab).collect()
            assert len(rows) == df.count()
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)

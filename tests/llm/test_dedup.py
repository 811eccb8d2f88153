import hashlib
import re

from memlake.llm.exact_dedup import exact_dedup
from memlake.llm.line_dedup import LINE, LevelledRuns, batched, dedup_lines
from memlake.llm.chunks import CHUNK, in_chunks
from memlake.llm.mixing import mix_sources
from memlake.llm.salting import SALT, salted
from memlake.llm.substring_dedup import COVER, PERIOD, SHORT, Words, dedup_substrings

import numpy as np

BIG = 1 << 63


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_substrings(rows):
    split = [(BIG if i is None else i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    low = {}
    for i, w in split:
        for q in range(len(w) - 12):
            key = tuple(w[q : q + 13])
            low[key] = min(low.get(key, BIG), i)
    out = []
    for (orig, _), (i, w) in zip(rows, split):
        gone = set()
        for q in range(len(w) - 12):
            if low[tuple(w[q : q + 13])] < i:
                gone.update(range(q, q + 13))
        out.append((orig, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def test_cover_is_a_difference_cover():
    assert {(b - a) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substrings_match_brute_force(documents, odd_docs, no_docs):
    for df in (documents, odd_docs, no_docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert by_rows(dedup_substrings(df, with_text=False)) == brute_substrings(rows)


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits[:n])


def test_different_words_are_told_apart(spark):
    """Words on which polynomial hashes modulo 2**64 agree, at lengths on both sides of the table's."""
    for n in (SHORT, 2048):
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        same = " ".join(f"w{i}" for i in range(12))
        rows = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{same} {x}")]
        got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
        assert by_rows(got) == brute_substrings(rows)
        assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 13}


def test_word_hashes_depend_on_every_byte_and_its_place():
    rng = np.random.default_rng(4)
    some = {bytes(rng.integers(33, 120, int(n)).astype(np.uint8)) for n in rng.integers(1, 90, 2000)}
    some |= {w[:i] + b"~" + w[i + 1 :] for w in list(some)[:300] for i in range(len(w))} | {w + b"!" for w in some}
    w = Words([b" ".join(sorted(some))])
    for half in (0, 1):
        assert len(set(w.hashes(half).tolist())) == len(some)
        assert (w.hashes(half) == Words([b" ".join(sorted(some))]).hashes(half, piece=100)).all()
    assert not (w.hashes(0) == w.hashes(1)).any()


def test_rows_without_id_are_dealt_over_chunks(spark):
    rows = [(None, "a b c")] * 2000 + [(7, f"text {i}") for i in range(2000)]
    got = in_chunks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 128).groupBy(CHUNK).count().collect()
    assert len(got) > 100 and max(r["count"] for r in got) < 100


def test_substrings_kept_text(odd_docs):
    for r in dedup_substrings(odd_docs).collect():
        assert sha(r.kept_text) == r.kept_sha256


def brute_lines(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(fold)
    held = {}
    for n, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), {})[n] = BIG if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := held.get(key(x), {})) >= 5 and max(h.values()) != (BIG if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return sorted(out, key=str)


def test_lines_match_brute_force(documents, odd_docs, no_docs):
    for df in (documents, odd_docs, no_docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert by_rows(dedup_lines(df, with_text=False)) == brute_lines(rows)


def test_levelled_runs_compact_and_anti_join():
    rng = np.random.default_rng(1)
    store, seen = LevelledRuns(fanout=3), {}
    for batch in range(20):
        run = np.zeros(30, LINE)
        run["h1"] = np.sort(rng.choice(200, 30, replace=False))
        run["docs"], run["top"] = 1, batch
        assert set(store.anti_join(run)["h1"].tolist()) == set(run["h1"].tolist()) - set(seen)
        for h in run["h1"].tolist():
            seen[h] = seen.get(h, 0) + 1
        store.add(run)
        assert all(len(level) < 3 for level in store.levels)
    whole = store.compact()
    assert dict(zip(whole["h1"].tolist(), whole["docs"].tolist())) == seen


def test_batches_count_each_line_once():
    rng = np.random.default_rng(8)
    runs, want = [], {}
    for k in range(50):
        run = np.zeros(int(rng.integers(1, 40)), LINE)
        run["h1"] = np.sort(rng.choice(100, len(run), replace=False))
        run["docs"], run["top"] = rng.integers(1, 4, len(run)), rng.integers(0, 1000, len(run))
        runs.append(run)
        for r in run.tolist():
            docs, top = want.get(r[0], (0, -1))
            want[r[0]] = docs + r[2], max(top, r[3])
    for least in (1, 100, 10**6):
        store = LevelledRuns(fanout=2)
        slots = np.concatenate([store.add(batch)[place] for batch, place in batched(runs, least)])
        for run, slot in zip(runs, np.split(slots, np.cumsum([len(r) for r in runs])[:-1]), strict=True):
            assert list(zip(store.docs[slot].tolist(), store.top[slot].tolist())) == [want[h] for h in run["h1"].tolist()]


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(BIG if i is None else i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)
        out.append((i, None if keep == BIG else keep, len(g), keep == (BIG if i is None else i), sha(norm(t))))
    return sorted(out, key=str)


def test_one_id_for_several_texts(spark):
    a, b = "A" * 32, "B" * 32
    rows = [(1, a + "tail"), (2, a + "tail2"), (1, b + "tail"), (3, b + "tail3"), (1, a), (1, b), (2**62 + 1, "x"), (2**63 - 1, "x"), (None, "x"), (None, "y"), (None, "y"), (-5, a), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"first_width": 1, "growth": 3}, {"first_width": 33}):
        assert by_rows(exact_dedup(df, **options)) == brute_exact(rows)


def test_exact_match_brute_force(documents, odd_docs, no_docs):
    for df in (documents, odd_docs, no_docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert by_rows(exact_dedup(df)) == brute_exact(rows)
        assert by_rows(exact_dedup(df, first_width=1, growth=3)) == brute_exact(rows)


def test_equal_rows_are_dealt_apart(spark):
    """100,000 rows without an id, and as many of one id and text, fill no chunk; other rows need no salt."""
    n = 100_000
    rows = spark.range(2 * n + 1000).selectExpr(f"CASE WHEN id < {n} THEN NULL WHEN id < {2 * n} THEN 7 ELSE id END AS doc_id", f"CASE WHEN id < {2 * n} THEN 'same' ELSE string(id) END AS text").repartition(4)
    per = {r[CHUNK]: r["count"] for r in in_chunks(rows, "doc_id", "text", 128).groupBy(CHUNK).count().collect()}
    assert sum(per.values()) == 2 * n + 1000 and len(per) == 128 and max(per.values()) < 2 * (2 * n + 1000) / 128
    out = salted(rows.where("doc_id is not null"), ["doc_id"]).selectExpr("doc_id = 7 AS hot", SALT).distinct().groupBy("hot").agg({SALT: "count"}).collect()
    assert {tuple(r) for r in out} == {(True, n), (False, 0)}


def test_mixing_spreads_equal_rows(spark):
    """Rows of one id, source and text are taken about equally often, whichever bucket they fall into."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 5 END AS doc_id", "'a b c d' AS text", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS source").repartition(3)
    out = mix_sources(rows).collect()
    assert len(out) == 3000 and sum(r.taken for r in out) == 12000 and {r.taken for r in out if r.source == "x"} <= {0, 4, 8} | set(range(9))
    for s in "xy":
        assert sum(r.taken for r in out if r.source == s) == round(next(r.target for r in out if r.source == s))

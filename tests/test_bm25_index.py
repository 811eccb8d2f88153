"""The kept BM25 index against a fresh count of everything."""

import math
import random
from collections import Counter

import pytest

from memlake.operators import bm25
from memlake.operators.bm25_index import PostingIndex

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed, first=0):
    r = random.Random(seed)
    return [(first + i, " ".join(r.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=r.randint(0, 40)))) for i in range(n)]


def plain(docs, queries, k):
    """Rounded scores of all documents, best first, ties by id."""
    split = {i: (t or "").lower().split() for i, t in docs}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = []
    for q, text in queries:
        scores = []
        for i, ws in split.items():
            tf = Counter(ws)
            hit = [(c, tf[w], df[w]) for w, c in Counter(text.lower().split()).items() if tf[w]]
            if hit:
                scores.append((-round(sum(c * math.log(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for c, f, d in hit), 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def same(got, want):
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in got.collect())
    assert got == sorted((q, r, i, round(s, 5)) for q, r, i, s in want)


QUERIES = [(1, "w0 w1 w2"), (2, "W7 w7 w50"), (3, "w59 w58 w57 w0 w3 w9"), (4, "none of these"), (5, "w11")]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_blocks_that_are_left_out_hold_no_better_document(spark, asked, monkeypatch, k):
    monkeypatch.setattr(bm25, "BLOCK", 8)
    docs = corpus(300, 1) + [(1000, None), (1001, "")]
    same(bm25.topk_by_blocks(frame(spark, docs), asked, k), plain(docs, QUERIES, k))


def test_three_adds_are_one_build(spark, asked, tmp_path):
    docs = corpus(300, 2) + [(1000, None), (1001, "")]
    whole, parts = PostingIndex(spark, f"{tmp_path}/one"), PostingIndex(spark, f"{tmp_path}/three")
    whole.add(frame(spark, docs))
    for k in range(3):
        parts.add(frame(spark, docs[k::3]))
    want = plain(docs, QUERIES, 10)
    same(whole.search(asked, 10), want)
    same(parts.search(asked, 10), want)
    plan = parts.search(asked, 10)  # plans of its written steps are gone, those of the scans stay
    assert len(parts.segments()) == 3 and plan.count()


def test_deletes_replacements_and_merges(spark, asked, tmp_path):
    docs = dict(corpus(120, 3))
    ix = PostingIndex(spark, f"{tmp_path}/ix")
    ix.add(frame(spark, list(docs.items())))
    for k in range(3):
        new = dict(corpus(15, 10 + k, first=100 + 10 * k))  # some are replaced
        docs |= new
        ix.add(frame(spark, list(new.items())))
        gone = [5 * k, 5 * k + 1, 9999]
        docs = {i: t for i, t in docs.items() if i not in gone}
        ix.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    same(ix.search(asked, 10), plain(list(docs.items()), QUERIES, 10))
    ix.merge(at_least=2)
    assert len(ix.segments()) == 1
    same(ix.search(asked, 10), plain(list(docs.items()), QUERIES, 10))
    back = dict(corpus(5, 99))
    docs |= back
    ix.add(frame(spark, list(back.items())))  # ids that were deleted come again
    ix.delete(spark.createDataFrame([(50,)], "doc_id long"))
    docs.pop(50)
    same(ix.search(asked, 10), plain(list(docs.items()), QUERIES, 10))


def test_a_broken_add_leaves_nothing(spark, asked, tmp_path):
    docs = corpus(50, 5)
    ix = PostingIndex(spark, f"{tmp_path}/ix")
    ix.add(frame(spark, docs))
    number, _ = ix._manifest()
    ix._write(number + 2, 0, bm25.counted(frame(spark, corpus(20, 6, first=500))))  # no manifest names it
    same(ix.search(asked, 10), plain(docs, QUERIES, 10))
    more = corpus(20, 7, first=500)
    ix.add(frame(spark, more))
    same(ix.search(asked, 10), plain(docs + more, QUERIES, 10))


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    ix = PostingIndex(spark, f"{tmp_path}/ix")
    ix.add(frame(spark, corpus(80, 8)))
    rows = ix._read("postings", [n for n, _ in ix.segments()], [3]).where("term = 'w1'")
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,w1)" in plan


def test_words_are_counted_where_texts_lie(spark):
    """No posting and no text is shuffled to be counted."""
    rows = bm25.counted(spark.createDataFrame([(1, "a b A"), (2, None), (3, " "), (4, "c")], "doc_id long, text string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.dl, r.term or "", r.tf) for r in rows.collect()) == [(1, 3, "a", 2), (1, 3, "b", 1), (2, 0, "", 1), (3, 0, "", 1), (4, 1, "c", 1)]


def test_a_group_sends_on_the_best_only(spark, monkeypatch):
    """Of 200 equal documents each group of blocks gives a query its two of the smallest ids, and queries of several parts miss none."""
    monkeypatch.setattr(bm25, "GROUP", 50)
    monkeypatch.setattr(bm25, "ASKED", 2)
    posted = spark.range(200).selectExpr("cast(id % 20 as string) as block", "id as doc_id", "4L as dl", "'w' as term", "1L as tf")
    weights = spark.range(5).selectExpr("id as query_id", "'w' as term", "1.0D as w")
    some = posted.select("block").distinct().crossJoin(weights.select("query_id")).where("block <> '0'")
    got = [(r.query_id, r.doc_id) for r in bm25.best_of_groups(posted, weights, some, 200, 4.0, 2).collect()]
    assert len(got) == len(set(got)) <= 5 * 2 * 4 and all((q, 1) in got and (q, 0) not in got for q in range(5))

import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from memlake.llm.quality import classify_quality
from test_dedup import brute_lines, sha
from test_select import fill
from test_near_copies import check as check_near_copies


def rows(df):
    return sorted((tuple(r) for r in df.select(cp.COLUMNS).collect()), key=str)


def test_each_stage_does_its_work_on_what_the_last_one_kept(spark, sf_dir, documents, tmp_path):
    docs, seen = documents, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    good, lined, single, mixed, encoded = seen

    kept = classify_quality(documents, cp.table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id")
    assert rows(good) == rows(documents.join(kept, "doc_id"))

    want = {r[0]: r[3] for r in brute_lines([(r.doc_id, r.text) for r in good.collect()])}
    got = {r.doc_id: (sha(r.text or ""), len(r.text) if r.text is not None else None, r.n_chars) for r in lined.collect()}
    assert {i: h for i, (h, _, _) in got.items()} == want
    assert all(n == c for _, n, c in got.values())

    check_near_copies([r.doc_id for r in single.collect()], [(r.doc_id, r.text) for r in lined.collect()])
    assert set(rows(single)) <= set(rows(lined))

    size = {r.doc_id: (r.source, len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])) for r in single.collect()}
    totals = {}
    for s, n in size.values():
        totals[s] = totals.get(s, 0) + n
    target, got = fill(totals), dict.fromkeys(totals, 0)
    for r in mixed.collect():
        got[r.source] += size[r.doc_id][1]
    assert set(rows(mixed)) <= set(rows(single))
    for s in totals:
        assert abs(got[s] - target[s]) <= max(n for x, n in size.values() if x == s)

    assert encoded.count() == mixed.count() and encoded.where("not round_trip").isEmpty()
    assert sorted(r.decoded_sha256 for r in encoded.collect()) == sorted(sha(r.text or "") for r in mixed.collect())
    assert sorted(map(str, cp.run(spark, sf_dir).collect())) == sorted(map(str, encoded.collect()))


def test_odd_and_empty_documents(spark, sf_dir, odd_docs, no_docs):
    """Each stage on nulls, empty texts, repeated rows and clashing columns, and on an empty table."""
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    for df in (odd_docs, no_docs):
        given = df.collect()
        for name, stage in cp.STAGES:
            out = stage(spark, df, sf_dir).collect()
            if name == "quality classifier":
                assert len(out) == classify_quality(df, cp.table(spark, sf_dir, "labels")).where("predicted = 1").count()
            elif name == "line dedup":
                assert sorted(((r.doc_id, sha(r.text or "")) for r in out), key=str) == sorted(((i, h) for i, _, _, h in brute_lines([(r.doc_id, r.text) for r in given])), key=str)
            elif name == "SimHash near-dedup":
                check_near_copies([r.doc_id for r in out], [(r.doc_id, r.text) for r in given])
            elif name == "mixing sources to target weights":
                assert {(r.doc_id, r.text) for r in out} <= {(r.doc_id, r.text) for r in given} and all(size(r.text) for r in out)
            else:
                assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == sorted((str(r.doc_id), sha(r.text or "")) for r in given)


def test_few_documents_through_every_stage(spark, sf_dir, documents):
    """Labels say nothing of most of so few, but each stage gives the columns of documents; alone, a document stays itself."""
    for n in (1, 2, 3):
        few = documents.orderBy("doc_id").limit(n)
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, few, sf_dir)
            assert out.columns == cp.COLUMNS
            if n == 1 and name in ("line dedup", "SimHash near-dedup"):
                assert rows(out) == rows(few)
        one = few.limit(1)
        assert [r.decoded_sha256 for r in cp.STAGES[-1][1](spark, one, sf_dir).collect()] == [sha(r.text or "") for r in one.collect()]

"""Greedy packing as a fold in the JVM, against the plain loop."""

import random

import pytest

from memlake.operators.chunking import pack_sentences, packed_chunks, sentences


@pytest.mark.parametrize("keep_empty", [True, False])
def test_fold_packs_as_the_loop(spark, keep_empty):
    r = random.Random(3)
    texts = [" ".join(" ".join(r.choices("abcde", k=r.randint(1, 9))) + r.choice(".!?") for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, "", "  ", "one", "a b c d e f g h i j k. l"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = {x.doc_id: x.p or [] for x in df.select("doc_id", sentences(df.text).alias("p")).collect()}
    out = packed_chunks(df, 10, keep_empty)
    got = {}
    for x in out.orderBy("doc_id", "pos").collect():
        assert x.n_tokens == len(x.text.split())
        got.setdefault(x.doc_id, []).append(x.text)
    assert got == {i: want for i, p in parts.items() if (want := pack_sentences(p, 10, keep_empty))}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()

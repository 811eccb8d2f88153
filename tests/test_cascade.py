"""Cascaded extraction: rounds add what the last made known, and stop when nothing comes."""

from pyspark.sql import functions as F

from memlake.operators.cascade import cascade, fixpoint, statement_reader

TEXTS = [(1, "a in B; b of C; C of d"), (2, "x in y; q of z"), (3, ""), (4, None), (5, "A in b; a in B")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rounds(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, text string")
    nodes, names, edges = cascade(chunks, *statement_reader(), rounds=2)
    assert rows(nodes.orderBy("chunk_id")) == [(1, "B", 2), (1, "C", 3), (1, "a", 1), (1, "d", 4), (2, "x", 1), (2, "y", 2), (5, "A", 1), (5, "B", 2)]
    assert rows(names) == [(1, "in", 1), (1, "of", 1), (2, "in", 1), (5, "in", 1)]
    assert rows(edges) == [(1, "C", "of", "d", 1), (1, "a", "in", "B", 1), (1, "b", "of", "C", 1), (2, "x", "in", "y", 1), (5, "A", "in", "b", 1)]


def test_a_round_that_adds_nothing_is_the_last(spark):
    asked = []

    def ask(known, r):
        asked.append(r)
        return spark.createDataFrame([(1, "Ab" if r == 1 else "aB")] * 2 + [(1, None)], "chunk_id long, name string")

    got = fixpoint(ask, lambda: [F.col("chunk_id"), F.lower("name")], 9)
    assert rows(got) == [(1, "Ab", 1)] and asked == [1, 2]


def test_no_chunks(spark):
    for t in cascade(spark.createDataFrame([], "chunk_id long, text string"), *statement_reader(), rounds=2):
        assert t.count() == 0

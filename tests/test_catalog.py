"""Every registered query runs; those with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from memlake.plans import catalog
from memlake.sources.tables import TABLES

catalog.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: None if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted((tuple(show(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.SQL:
        assert got
        return
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(e.HERE)


def test_persons_and_addresses(spark, sf_dir):
    """The two patterns that the SQL engine cannot run, against Python's."""
    import re

    from memlake.functions.text import ENTITY_PATTERNS

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    got = {(r.page_id, r.type): r.hits for r in catalog.QUERIES["regex_entities_all"](spark, sf_dir).collect()}
    for kind in ("PERSON", "IP_ADDRESS"):
        pattern = re.compile(ENTITY_PATTERNS[kind][0])
        want = {r.page_id: n for r in pages if (n := sum(1 for _ in pattern.finditer(r.html)))}
        assert {p: n for (p, k), n in got.items() if k == kind} == want


def test_bootstrap_is_of_the_labels(spark, sf_dir):
    """The interval of ten thousand resamples is that of the binomial."""
    q = [r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("quality").collect()]
    r = catalog.QUERIES["bootstrap_ci"](spark, sf_dir).first()
    p, n = sum(q) / len(q), len(q)
    half = 1.96 * (p * (1 - p) / n) ** 0.5
    assert abs(r.mean - p) < 1e-9 and abs(r.low - (p - half)) < 0.25 * half and abs(r.high - (p + half)) < 0.25 * half


def test_clusters_are_trees(spark, sf_dir):
    """Each level's nodes are all children of the next, once; a parent's vector is its children's mean."""
    from memlake.operators.cluster_tree import build_tree
    from pyspark.sql import functions as F

    leaves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("some words").alias("text"))
    nodes = {r.id: r for r in build_tree(leaves, levels=2).collect()}
    for level in range(max(r.level for r in nodes.values())):
        own = sorted(i for i, r in nodes.items() if r.level == level)
        parents = [r for r in nodes.values() if r.level == level + 1]
        assert sorted(c for r in parents for c in r.children) == own
        for r in parents:
            mean = [sum(x) / len(r.children) for x in zip(*(nodes[c].vector for c in r.children))]
            assert r.vector == pytest.approx(mean, abs=1e-5)


def test_words_of_texts_without_any(spark, tmp_path):
    """Null and empty texts, alone under an id and beside another text, give the SQL's rows."""
    docs = [(1, ""), (2, None), (3, "One two. Three\nfour! "), (4, ""), (4, "a b."), (5, None), (5, None), (6, " "), (7, "\n"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.SQL["chunk_words"])
    names = [c[0] for c in want.description]
    df = catalog.QUERIES["chunk_words"](spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == 8 and rows(df.columns, got) == rows(names, want.fetchall())

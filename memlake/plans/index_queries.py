"""Queries over indexes that are kept on disk, added to and deleted from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators.bm25_index import PostingIndex
from memlake.operators.vector_index import VectorIndex
from memlake.plans.catalog import query
from memlake.plans.text_queries import _WORDS, _asked, _bm25
from memlake.plans.vector_queries import _CENTRES, _COS, _centres, _vectors
from memlake.scratch import scratch_path
from memlake.sources.tables import table, texts


@query(f"""WITH {_CENTRES}, live AS (SELECT vec_id, CASE WHEN label = 1 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE label <> 0),
    s AS (SELECT query_id, vec_id AS id, round({_COS.format('v', 'qv')}, 6) AS score FROM live CROSS JOIN c)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 10""")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of an index that was built in two adds; label 0 was deleted again, label 1 replaced.

    All cells are probed, since these vectors have no clusters, and all rows are
    compared exactly whose bounds let them be among the nearest.
    """
    v = _vectors(spark, d)
    ix = VectorIndex(spark, scratch_path(spark, "vector-index"))
    ix.fit(v, cells=16)
    ix.add(v.where("label < 5"))
    ix.add(v.where("label >= 5"))
    ix.delete(v.where("label = 0"))
    ix.add(v.where("label = 1").withColumn("vector", F.reverse("vector")))
    return ix.search(_centres(spark, d), 10, probes=16, rerank=None).withColumn("rank", F.col("rank").cast("long"))


_KEPT = _bm25(f"SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", f"SELECT item_id AS query_id, {_WORDS.format('text')} AS ws FROM benchmark")


@query(f"WITH {_KEPT} SELECT query_id, rank, doc_id, score FROM top WHERE rank <= 10")
def kept_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over a kept index: one add a language, the toxic documents deleted, two segments merged and one left."""
    docs = texts(spark, d, "documents").select("doc_id", "text", "lang")
    ix = PostingIndex(spark, scratch_path(spark, "posting-index"))
    ix.add(docs.where("lang = 'en'"))
    ix.add(docs.where("lang = 'de'"))
    ix.delete(table(spark, d, "labels").where("toxic = 1"))
    ix.merge(at_least=2)
    ix.add(docs.where("lang NOT IN ('en', 'de') OR lang IS NULL").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti"))
    return ix.search(_asked(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))

"""Queries over vectors: exact top-k, filters, batches, joins, graphs of similar vectors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions.vectors import mean_vector, pooled
from memlake.operators import bm25, cluster_tree, retrieval
from memlake.operators.vector_store import knn_join, minmax, predicate, similar_pairs, topk
from memlake.plans.catalog import query
from memlake.plans.text_queries import _DOCS_ASKED, _asked
from memlake.sources.tables import table, texts

_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
_CENTRES = """c AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM (
    SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY ALL)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _centres(spark: SparkSession, d: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query_vector")).withColumnRenamed("label", "query_id")


def _top(where: str = "true", k: int = 10) -> str:
    return f"""WITH {_CENTRES}, s AS (SELECT query_id, vec_id AS id, label, round({_COS.format('embedding', 'qv')}, 6) AS score FROM embeddings CROSS JOIN c)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s WHERE {where} QUALIFY rank <= {k}"""


@query(_top())
def vector_batch(spark: SparkSession, d: str) -> DataFrame:
    return topk(_vectors(spark, d), _centres(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(_top("label IN (1, 2, 3)", 5))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the ranking, so a query always gets its k."""
    return topk(_vectors(spark, d).where(predicate({"label": [1, 2, 3]})), _centres(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_CENTRES}, s AS (SELECT query_id, vec_id AS id, 1 - {_COS.format('embedding', 'qv')} AS distance FROM embeddings CROSS JOIN c)
    SELECT query_id, id, round(distance, 6) AS distance, round((distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w), 6) AS normalized FROM s WINDOW w AS (PARTITION BY query_id)""")
def distance_minmax(spark: SparkSession, d: str) -> DataFrame:
    scores = topk(_vectors(spark, d), _centres(spark, d), None)
    out = minmax(scores.select("query_id", "id", (1 - F.col("score")).alias("distance")), score="distance")
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("normalized", 6).alias("normalized"))


@query(f"""WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank, score FROM p WHERE score >= 0.2 QUALIFY rank <= 5""")
def knn_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return knn_join(_vectors(spark, d), _vectors(spark, d), 5, 0.2).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format('a.embedding', 'b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
    SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim > 0.3""")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_vectors(spark, d), 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""
    WITH {_DOCS_ASKED},
    ds AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_COS.format('v.embedding', 'q.embedding')} AS s FROM embeddings v CROSS JOIN embeddings q JOIN benchmark ON item_id = q.vec_id),
    dt AS (SELECT query_id, doc_id, round(s, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS r FROM ds QUALIFY r <= 50),
    dn AS (SELECT query_id, doc_id, coalesce((s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0), 0) AS n FROM dt WINDOW w AS (PARTITION BY query_id)),
    ln AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS n FROM top WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
    j AS (SELECT query_id, doc_id, round(0.5 * coalesce(dn.n, 0) + 0.5 * coalesce(ln.n, 0), 6) AS score FROM ln FULL JOIN dn USING (query_id, doc_id))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM j QUALIFY rank <= 10""")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    lexical = bm25.bm25_topk(texts(spark, d, "documents"), _asked(spark, d), 50)
    v = _vectors(spark, d)
    asked = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return retrieval.hybrid(lexical, topk(v, asked, 50), 10).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH t AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings), e AS (SELECT vec_id, unnest(range(len(a))) AS i, unnest(a) AS a, unnest(b) AS b FROM t)
    SELECT vec_id, CAST(i AS INT) AS i, round((a::DOUBLE + b::DOUBLE) / 2, 6) AS mean, a::DOUBLE AS first, round((a::DOUBLE + b::DOUBLE) / 2, 6) AS halves FROM e""")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Token vectors pooled by their mask, by the first one, and from two halves."""
    v = table(spark, d, "embeddings").withColumn("b", F.reverse("embedding"))
    tokens = F.array("embedding", "b", F.transform("b", lambda x: x * 0 + 9))
    mask = F.array(F.lit(1), F.lit(1), F.lit(0))
    rows = v.select("vec_id", F.arrays_zip(pooled(tokens, mask).alias("mean"), pooled(tokens, mask, "cls").alias("first"), mean_vector(F.col("embedding"), F.col("b")).alias("halves")).alias("z"))
    return rows.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", "i", F.round("z.mean", 6).alias("mean"), F.col("z.first").alias("first"), F.round("z.halves", 6).alias("halves"))


@query()
def cluster_tree_levels(spark: SparkSession, d: str) -> DataFrame:
    leaves = _vectors(spark, d).withColumn("text", F.concat(F.lit("leaf "), F.col("id").cast("string")))
    return cluster_tree.build_tree(leaves, levels=2).select("id", "level", "text", F.size("children").alias("children"))

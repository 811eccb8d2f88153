"""Queries over the vector store: its life cycle, filters, metrics, order, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators.vector_store import VectorStore
from memlake.plans.catalog import query
from memlake.plans.vector_queries import _CENTRES, _COS, _centres
from memlake.scratch import scratch_path
from memlake.sources.tables import table


def _store(spark: SparkSession, d: str) -> VectorStore:
    """One collection of all vectors, each with its label, number and a date as payload."""
    s = VectorStore(spark, scratch_path(spark, "store"))
    s.create_collection("v")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("vec_id") * 7, F.lit(90)).cast("int")), "yyyy-MM-dd")
    payload = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("n"), F.col("vec_id").cast("string"), F.lit("day"), day)
    s.insert("v", table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload")))
    return s


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id = 5 THEN NULL ELSE CAST(label AS VARCHAR) END AS label, CASE WHEN vec_id = 5 THEN 'changed' WHEN label = 1 THEN 'again' END AS kind FROM embeddings WHERE vec_id NOT IN (3, 4)")
def store_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Inserted, partly replaced, one updated, two deleted, then compacted."""
    s = _store(spark, d)
    again = s.list("v", {"label": 1}).withColumn("payload", F.map_concat("payload", F.create_map(F.lit("kind"), F.lit("again"))))
    s.upsert("v", again)
    s.update("v", "5", payload={"kind": "changed"})
    s.delete("v", ["3", "4"])
    s.compact("v")
    return s.rows("v").select("id", F.col("payload")["label"].alias("label"), F.col("payload")["kind"].alias("kind"))


_FILTERS = {"mixed": "vec_id >= 100 AND vec_id < 400 AND label IN (1, 2, 5)", "dollar": "vec_id >= 100 AND vec_id < 400 AND label <> 2", "none": "false", "member": "vec_id >= 100 AND vec_id < 400 AND label IN (1, 5)"}


@query(f"""WITH {_CENTRES}, f AS ({' UNION ALL '.join(f"SELECT '{tag}' AS filter, vec_id, embedding FROM embeddings WHERE {rule}" for tag, rule in _FILTERS.items())}),
    s AS (SELECT filter, query_id, CAST(vec_id AS VARCHAR) AS id, round({_COS.format('embedding', 'qv')}, 6) AS score FROM f CROSS JOIN c)
    SELECT filter, query_id, id, score, round(1 - score, 6) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY filter, query_id ORDER BY score DESC, id) <= 5""")
def store_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Ranges, memberships and comparisons of payloads, with and without a dollar sign, come before the ranking, so each query gets its five; a missing key matches nothing."""
    s, asked = _store(spark, d), _centres(spark, d)
    filters = {
        "mixed": {"n": {"gte": 100, "lt": 400}, "label": [1, 2, 5], "day": None},
        "dollar": {"n": {"$gte": 100, "$lt": 400}, "label": {"ne": "2"}},
        "none": {"nokey": "x"},
        "member": {"n": {"gte": 100, "lt": 400}, "label": ["1", "5"]},
    }
    out = None
    for tag, rule in filters.items():
        hits = s.search("v", asked, 5, filters=rule).select(F.lit(tag).alias("filter"), "query_id", "id", "score", F.round("distance", 6).alias("distance"))
        out = hits if out is None else out.unionByName(hits)
    return out


@query(f"""WITH {_CENTRES}, s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id, round(list_distance(embedding::DOUBLE[], qv), 6) AS score FROM embeddings CROSS JOIN c)
    SELECT query_id, id, score, round(1 / (1 + score), 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= 7""")
def store_search_l2(spark: SparkSession, d: str) -> DataFrame:
    hits = _store(spark, d).search("v", _centres(spark, d), 7, metric="l2")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.round("similarity", 5).alias("similarity"))


@query(f"""WITH {_CENTRES}, s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id, round(list_dot_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings CROSS JOIN c)
    SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def store_search_inner_product(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).search("v", _centres(spark, d), 3, metric="ip").select("query_id", "id", "score")


@query("""SELECT CAST(vec_id AS VARCHAR) AS id, strftime(DATE '2024-01-01' + CAST((vec_id * 7) % 90 AS INT), '%Y-%m-%d') AS day FROM embeddings WHERE label IN (3, 4) ORDER BY day DESC, id LIMIT 20""")
def store_newest(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two labels, the newest first."""
    return _store(spark, d).list("v", {"label": [3, 4]}, limit=20, newest_by="day").select("id", F.col("payload")["day"].alias("day"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings ORDER BY 1 LIMIT 10")
def store_listed(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).list("v", limit=10).select("id")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, label::VARCHAR AS label FROM embeddings WHERE vec_id IN (7, 11, 2)")
def store_get(spark: SparkSession, d: str) -> DataFrame:
    """Rows by id; one is not there."""
    return _store(spark, d).get("v", ["7", "nothing", "11", "2"]).select("id", F.col("payload")["label"].alias("label"))


@query(f"""WITH {_CENTRES}, s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id, 1 - {_COS.format('embedding', 'qv')} AS distance FROM embeddings CROSS JOIN c)
    SELECT query_id, id, round((distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w), 6) AS normalized FROM s WINDOW w AS (PARTITION BY query_id)""")
def store_distances(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).distances("v", _centres(spark, d)).select("query_id", "id", F.round("normalized", 6).alias("normalized"))


@query("SELECT 'v' AS first, count(*) AS n, 64 AS dims, 2 AS made, 1 AS left_, 0 AS pruned FROM embeddings")
def store_collections(spark: SparkSession, d: str) -> DataFrame:
    """Collections are made, described, dropped and pruned."""
    s = _store(spark, d)
    s.create_collection("w")
    info, made = s.collection_info("v"), len(s.list_collections())
    s.delete_collection("w")
    left = s.list_collections()
    s.prune()
    return spark.createDataFrame([(left[0], info["rows"], info["dims"], made, len(left), len(s.list_collections()))], "first string, n long, dims int, made int, left_ int, pruned int")

"""Queries that compose retrieval: fusion with a graph, gates, permissions, times, dispatch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions import text as X
from memlake.operators import graph as G, graph_memory as GM, retrieval as R
from memlake.operators.vector_store import topk
from memlake.plans.catalog import query
from memlake.plans.graph_queries import _EDGES, _relational
from memlake.plans.pipelines import judge_prompts
from memlake.plans.vector_queries import _CENTRES, _COS, _centres, _vectors
from memlake.sources.tables import table

_HITS = f"""{_CENTRES}, s AS (SELECT query_id, vec_id AS id, round({_COS.format('embedding', 'qv')}, 6) AS score FROM embeddings CROSS JOIN c),
    hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return topk(_vectors(spark, d), _centres(spark, d), k)


@query(f"""WITH {_HITS} SELECT query_id, arg_max(id, (id % 2, id % 5, -rank)) AS id FROM hits WHERE id % 3 <> 0 GROUP BY query_id""")
def gated_answers(spark: SparkSession, d: str) -> DataFrame:
    """The best relevant passage: supported first, then the more useful, then the nearer."""
    i = F.col("id")
    return R.gated(_hits(spark, d), i % 3 != 0, i % 2 == 1, i % 5)


@query(f"WITH {_HITS} SELECT DISTINCT CAST(query_id // 2 AS BIGINT) AS question_id, id FROM hits")
def union_of_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Passages found by any rewrite of a question, each once."""
    return R.union_of_queries(_hits(spark, d).select((F.col("query_id") / 2).cast("long").alias("question_id"), "id"))


@query(f"WITH {_HITS} SELECT query_id, id FROM hits WHERE id % 4 = 0 OR id % 7 = 1")
def allowed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the user's documents, and hits of none."""
    hits = _hits(spark, d).withColumn("document_id", F.when(F.col("id") % 4 != 0, F.col("id") % 7))
    return R.allowed(hits, spark.createDataFrame([(1,)], "document_id long")).select("query_id", "id")


@query(r"SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(regexp_split_to_array(trim(line), '\s+')) >= 4")
def short_lines_dropped(spark: SparkSession, d: str) -> DataFrame:
    return R.short_lines_dropped(table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "line")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-03-01' AND (o_orderstatus <> 'F' OR TIMESTAMP '1996-03-01' < o_orderdate + INTERVAL 90 DAY)""")
def facts_at_a_time(spark: SparkSession, d: str) -> DataFrame:
    """Facts valid at a time; finished ones end after ninety days."""
    at = F.col("o_orderdate").cast("timestamp")
    facts = table(spark, d, "orders").select("o_orderkey", at.alias("valid_at"), F.when(F.col("o_orderstatus") == "F", at + F.expr("INTERVAL 90 DAYS")).alias("invalid_at"))
    return R.temporal(facts, datetime(1996, 3, 1)).select("o_orderkey")


@query(r"""WITH l AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS ws FROM l)
    SELECT conv_id, array_to_string(ws[-64:], ' ') AS context FROM w""")
def long_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's messages in order, cut to the last words."""
    return R.long_context(table(spark, d, "conversations"), "conv_id", "turn", "text", 64)


_MAIL = X.ENTITY_PATTERNS["EMAIL"][0]


@query(f"""WITH q AS (SELECT doc_id, substr(text, 1, 400) AS query FROM documents), e AS (SELECT doc_id, query, list_distinct(regexp_extract_all(query, '{_MAIL}')) AS es FROM q)
    SELECT doc_id AS query_id, unnest(CASE WHEN len(es) > 0 THEN list_transform(es, lambda x: x || ' ' || query) ELSE [query] END) AS query FROM e""")
def entity_queries(spark: SparkSession, d: str) -> DataFrame:
    """A query per entity of a question."""
    return R.entity_queries(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 400).alias("query")), "EMAIL")


@query(f"""WITH {_EDGES}, near AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey < 3), types AS (SELECT 'region:' || r_regionkey AS id FROM region WHERE r_regionkey < 2),
    start AS (SELECT id FROM near UNION ALL SELECT id FROM types LIMIT 5)
    SELECT id, 'out' AS direction, rel, dst AS other FROM start JOIN edges ON src = id UNION ALL SELECT id, 'in', rel, src FROM start JOIN edges ON dst = id""")
def insight_search(spark: SparkSession, d: str) -> DataFrame:
    """Connections of close entities, then of close types; far ones are cut off."""
    n, e = _relational(spark, d)
    key = F.regexp_extract("id", r":(\d+)$", 1).cast("double")
    entity = n.where("id LIKE 'nation:%'").select("id", (key * 0.2).alias("distance"))
    kinds = n.where("id LIKE 'region:%'").select("id", (key * 0.3).alias("distance"))
    return R.insights(n.where("false").select("id"), entity, kinds, n, e, 5).select("id", "direction", "rel", "other")


@query("SELECT agent, CASE WHEN contains(agent, 'bm25') THEN 'bm25' WHEN contains(agent, 'dense') THEN 'dense' ELSE 'hybrid' END AS route FROM (SELECT unnest(['agent_bm25_v2', 'my-dense', 'a_hybrid']) AS agent)")
def routed_agents(spark: SparkSession, d: str) -> DataFrame:
    """Agents are routed by the first search type that their name holds."""
    r = R.search_types()
    return spark.createDataFrame([(a, r.route(a)) for a in ("agent_bm25_v2", "my-dense", "a_hybrid")], "agent string, route string")


@query(f"WITH {_HITS} SELECT query_id, id FROM hits WHERE rank <= 4 UNION ALL SELECT query_id + 100, id FROM hits WHERE rank = 1")
def dispatched_searches(spark: SparkSession, d: str) -> DataFrame:
    """Searches by the name of their type: chunks, and the one passage of a completion."""
    r, v, q = R.search_types(), _vectors(spark, d), _centres(spark, d)
    chunks = r.search("chunks", v, q, k=4).select("query_id", "id")
    return chunks.unionByName(r.search("completion", v, q).select((F.col("query_id") + 100).alias("query_id"), "id"))


@query(f"""WITH {_EDGES}, a AS (SELECT src AS id, dst AS mid FROM edges WHERE rel = 's_nationkey' UNION ALL SELECT dst, src FROM edges WHERE rel = 's_nationkey'),
    b AS (SELECT src AS mid, dst AS reached FROM edges WHERE rel = 'n_regionkey' UNION ALL SELECT dst, src FROM edges WHERE rel = 'n_regionkey')
    SELECT DISTINCT id, reached FROM a JOIN b USING (mid) WHERE id LIKE 'supplier:%'""")
def two_hop_search(spark: SparkSession, d: str) -> DataFrame:
    """From suppliers over their nation to its region."""
    n, e = _relational(spark, d)
    return GM.two_hop(e, n.where("id LIKE 'supplier:%'"), ["s_nationkey"], ["n_regionkey"])


@query(f"""WITH {_EDGES}, a AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'n_regionkey'), b AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 's_nationkey')
    SELECT b.src AS n0, b.dst AS n1, a.dst AS n2, o.src AS n3 FROM b JOIN a ON a.src = b.dst JOIN a o ON o.dst = a.dst""")
def path_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, their nation, its region, and that region's nations, by a pattern of relations."""
    return R.search_types().search("pattern", _relational(spark, d)[1], ["s_nationkey", "n_regionkey", "<n_regionkey"])


_JUDGED = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'abstention' WHEN 1 THEN 'temporal' WHEN 2 THEN 'preference' ELSE 'single' END AS kind FROM conversations"""


@query(f"""SELECT conv_id, turn, CASE kind WHEN 'abstention' THEN 'Question: ' || role || chr(10) || 'Explanation: a' || turn || chr(10) || 'Response: ' || text || chr(10) || 'Does the response say that the question cannot be answered? Answer yes or no.'
        WHEN 'temporal' THEN 'Question: ' || role || chr(10) || 'Reference: a' || turn || chr(10) || 'Response: ' || text || chr(10) || 'An error of one day, week or month is no error. Is the response correct? Answer yes or no.'
        WHEN 'preference' THEN 'Question: ' || role || chr(10) || 'Rubric: a' || turn || chr(10) || 'Response: ' || text || chr(10) || 'Does the response use the user''s preferences as the rubric says? Answer yes or no.'
        ELSE 'Question: ' || role || chr(10) || 'Reference: a' || turn || chr(10) || 'Response: ' || text || chr(10) || 'Is the response correct? Answer yes or no.' END AS prompt
    FROM conversations JOIN ({_JUDGED}) USING (conv_id, turn)""")
def judge_prompts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The judge's prompt of each answer, by question type and abstention."""
    t = table(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("single", "temporal-reasoning", "single-session-preference", "multi"))), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    rows = t.select("conv_id", "turn", F.col("role").alias("question"), F.concat(F.lit("a"), F.col("turn").cast("string")).alias("answer"), F.col("text").alias("response"), kind.alias("question_type"), (F.pmod("turn", F.lit(4)) == 0).alias("abstention"))
    return judge_prompts(rows).select("conv_id", "turn", "prompt")


# --- fusion -------------------------------------------------------------------

_ROUNDS = 20
_FUSED = f"""
    fh AS (SELECT n_regionkey AS query_id, s_suppkey AS fact_id, round(s_acctbal / 10000, 6) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 4 QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) <= 6),
    ph AS (SELECT query_id, p AS phrase, avg(score) AS mean FROM (SELECT query_id, score, unnest(['s' || s_suppkey, 'n' || s_nationkey]) AS p FROM fh JOIN supplier ON s_suppkey = fact_id) GROUP BY ALL),
    fr AS (SELECT 'n' || c_nationkey AS phrase, count(DISTINCT c_mktsegment || c_nationkey) AS chunks FROM customer GROUP BY 1),
    best AS (SELECT query_id, phrase AS id, mean / coalesce(chunks, 1) AS weight FROM ph LEFT JOIN fr USING (phrase) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mean / coalesce(chunks, 1) DESC, phrase) <= 5),
    psg AS (SELECT DISTINCT 'P' || c_mktsegment || c_nationkey AS id, 'n' || c_nationkey AS phrase FROM customer),
    dh AS (SELECT r_regionkey AS query_id, psg.id, round(((ascii(psg.id[2:2]) * 7 + len(psg.id) * 3 + r_regionkey * 11 + CAST(regexp_extract(psg.id, '\\d+$') AS INT) * 13) % 50) / 50.0, 6) AS score FROM psg CROSS JOIN region),
    dn AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END * 0.05 AS weight FROM dh WINDOW w AS (PARTITION BY query_id)),
    seed AS (SELECT query_id, id, sum(weight) AS weight FROM (SELECT * FROM best UNION ALL SELECT * FROM dn) GROUP BY ALL),
    ed AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT id, phrase FROM psg),
    two AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed) GROUP BY ALL),
    step AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM two),
    rs AS MATERIALIZED (SELECT query_id, id, weight / sum(weight) OVER (PARTITION BY query_id) AS reset FROM seed WHERE query_id IN (SELECT query_id FROM fh)),
    r0 AS MATERIALIZED (SELECT query_id, id, reset AS rank FROM rs)"""


def _fused_sql() -> str:
    steps = "".join(
        f", r{k + 1} AS MATERIALIZED (SELECT query_id, id, sum(x) AS rank FROM (SELECT query_id, dst AS id, 0.5 * p * rank AS x FROM step JOIN r{k} ON src = id UNION ALL SELECT query_id, id, 0.5 * reset FROM rs) GROUP BY ALL)" for k in range(_ROUNDS)
    )
    return f"""WITH {_FUSED}{steps}, a AS (SELECT query_id, id, round(rank, 6) AS score FROM r{_ROUNDS} WHERE id LIKE 'P%' UNION ALL SELECT query_id, id, score FROM dh WHERE query_id NOT IN (SELECT query_id FROM fh))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id AS passage_id, score FROM a QUALIFY rank <= 10"""


@query(_fused_sql())
def fused_passages(spark: SparkSession, d: str) -> DataFrame:
    """Facts and dense hits of every question fused over the graph of phrases and passages; a question without facts keeps its dense order.

    A region asks; suppliers in nations are the facts; a nation's customers of a segment are a passage.
    """
    s, n, c, r = (table(spark, d, t) for t in ("supplier", "nation", "customer", "region"))
    phrase = lambda a, key: F.concat(F.lit(a), F.col(key).cast("string"))
    facts = s.select(F.col("s_suppkey").alias("fact_id"), phrase("s", "s_suppkey").alias("s"), F.lit("in").alias("p"), phrase("n", "s_nationkey").alias("o"))
    asked = s.join(n, s.s_nationkey == n.n_nationkey).where("n_regionkey < 4").select(F.col("n_regionkey").alias("query_id"), F.col("s_suppkey").alias("fact_id"), F.round(F.col("s_acctbal") / 10000, 6).alias("score"))
    passages = c.select(F.concat(F.lit("P"), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("chunk_id"), phrase("n", "c_nationkey").alias("phrase")).distinct()
    p = passages.select(F.col("chunk_id").alias("id"))
    noise = (F.ascii(F.substring("id", 2, 1)) * 7 + F.length("id") * 3 + F.col("r_regionkey") * 11 + F.regexp_extract("id", r"\d+$", 0).cast("int") * 13) % 50
    dense = p.crossJoin(F.broadcast(r)).select(F.col("r_regionkey").alias("query_id"), "id", F.round(noise / 50, 6).alias("score"))
    edges = facts.select(F.col("s").alias("src"), F.col("o").alias("dst")).unionByName(passages.select(F.col("chunk_id").alias("src"), F.col("phrase").alias("dst"))).withColumn("weight", F.lit(1.0))
    out = R.fused_batch(facts, R.best_facts(asked, 6), passages, dense, edges, 10, rounds=_ROUNDS)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_EDGES}, two AS (SELECT src, dst FROM edges WHERE rel IN ('n_regionkey', 's_nationkey') UNION ALL SELECT dst, src FROM edges WHERE rel IN ('n_regionkey', 's_nationkey')),
    a AS (SELECT dst AS id, 2.0::DOUBLE AS cost FROM two WHERE src = 'region:0' AND dst LIKE 'nation:%'), b AS (SELECT t.dst AS id, 4.0::DOUBLE AS cost FROM a JOIN two t ON t.src = a.id WHERE t.dst LIKE 'supplier:%')
    SELECT 'region:0' AS id, 0.0::DOUBLE AS cost UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b""")
def graph_walk(spark: SparkSession, d: str) -> DataFrame:
    """A walk from one region through nodes that bring a new concept: its nations, then their suppliers."""
    n, e = _relational(spark, d)
    kind = F.substring_index("id", ":", 1)
    edges = e.where(F.col("rel").isin("n_regionkey", "s_nationkey")).select("src", "dst", F.lit(0.5).alias("weight"))
    seeds = spark.createDataFrame([("region:0", 0.0)], "id string, cost double")
    # A nation adds its kind to the region's; a supplier adds its own; going back adds nothing.
    concepts = n.select("id", F.when(kind == "region", F.array(F.lit("r"))).when(kind == "nation", F.array(F.lit("r"), F.lit("n"))).otherwise(F.array(F.lit("r"), F.lit("n"), F.lit("s"))).alias("concepts"))
    return G.best_first(edges, seeds, concepts)

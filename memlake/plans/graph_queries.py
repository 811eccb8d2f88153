"""Queries over graphs: relational tables as graphs, metrics, subgraphs, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions.vectors import cosine
from memlake.operators import graph as G
from memlake.operators.similar_components import similar_components
from memlake.operators.vector_store import similar_pairs
from memlake.operators.vector_walks import walks_to_answers
from memlake.plans.catalog import query
from memlake.sources.tables import table


def _relational(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = {"region": (table(spark, d, "region"), "r_regionkey"), "nation": (table(spark, d, "nation"), "n_nationkey"), "customer": (table(spark, d, "customer"), "c_custkey"), "supplier": (table(spark, d, "supplier"), "s_suppkey")}
    foreign = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]
    return G.relational_graph(tables, foreign)


_KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))
_NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id, 'TableRow' AS type FROM {t} UNION ALL SELECT '{t}', 'TableType'" for t, k in _KEYS) + ")"
_EDGES = (
    "edges AS ("
    + " UNION ALL ".join(f"SELECT '{t}:' || {k} AS src, '{t}' AS dst, 'is_part_of' AS rel FROM {t}" for t, k in _KEYS)
    + " UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey, 'n_regionkey' FROM nation JOIN region ON n_regionkey = r_regionkey"
    + " UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || n_nationkey, 'c_nationkey' FROM customer JOIN nation ON c_nationkey = n_nationkey"
    + " UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || n_nationkey, 's_nationkey' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)
_GRAPH = f"WITH {_NODES}, {_EDGES}, two AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"


@query(f"WITH {_EDGES} SELECT src, rel, dst FROM edges")
def relational_to_graph(spark: SparkSession, d: str) -> DataFrame:
    return _relational(spark, d)[1].select("src", "rel", "dst")


@query(f"WITH {_EDGES} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.relation_histogram(_relational(spark, d)[1])


def _labels_sql(rounds: int) -> str:
    """Smallest labels handed on over all links, round by round; ``l{rounds}`` has the components of graphs of a diameter within the rounds."""
    return "l0 AS (SELECT id, id AS label FROM nodes)" + "".join(
        f", l{k + 1} AS MATERIALIZED (SELECT l{k}.id, least(any_value(l{k}.label), coalesce(min(o.label), any_value(l{k}.label))) AS label FROM l{k} LEFT JOIN two ON src = l{k}.id LEFT JOIN l{k} o ON o.id = dst GROUP BY l{k}.id)" for k in range(rounds)
    )


@query(f"""{_GRAPH}, {_labels_sql(8)}, sizes AS (SELECT label, count(*) AS n FROM l8 GROUP BY label), n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS m FROM edges)
    SELECT n AS num_nodes, m AS num_edges, round(2.0 * m / n, 6) AS mean_degree, round(m / (n * (n - 1.0)), 6) AS edge_density, (SELECT CAST(count(*) AS INT) FROM sizes) AS num_components, (SELECT max(n) FROM sizes) AS largest FROM n, m""")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = G.graph_metrics(*_relational(spark, d))
    return m.select("num_nodes", "num_edges", F.round("mean_degree", 6).alias("mean_degree"), F.round("edge_density", 6).alias("edge_density"), "num_components", F.element_at("component_sizes", 1).alias("largest"))


@query(f"""{_GRAPH.replace("edges AS (", "all_edges AS (", 1).replace("two AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)", "edges AS (SELECT * FROM all_edges WHERE rel = 'n_regionkey'), two AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)")}, {_labels_sql(4)},
    sizes AS (SELECT label, count(*) AS n FROM l4 GROUP BY label), largest AS (SELECT label FROM sizes ORDER BY n DESC, label LIMIT 1)
    SELECT id FROM l4 WHERE label NOT IN (SELECT label FROM largest)""")
def disconnected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Only regions and nations are linked: all else is outside the largest component."""
    n, e = _relational(spark, d)
    return G.disconnected(n, e.where("rel = 'n_regionkey'"))


_SIMILAR = """p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label
    WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) > 0.35)"""


def _similar(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return similar_pairs(v, 0.35, within=("label",)).select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim")


@query(f"""WITH RECURSIVE {_SIMILAR}, two AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, two.b FROM r JOIN two ON two.a = r.reach)
    SELECT node, min(reach) AS component FROM r GROUP BY node""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of similar vectors with equal labels."""
    return similar_components(table(spark, d, "embeddings"), 0.35, "vec_id", "embedding", within=("label",))


@query(f"""WITH {_SIMILAR}, two AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), deg AS (SELECT x, count(*) AS k FROM two GROUP BY x),
    t AS (SELECT a.x, count(*) AS t FROM two a JOIN two b ON a.x = b.x AND a.y < b.y JOIN p ON p.a = a.y AND p.b = b.y GROUP BY a.x)
    SELECT vec_id AS id, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS coefficient FROM embeddings LEFT JOIN deg ON x = vec_id LEFT JOIN t ON t.x = vec_id""")
def graph_clustering(spark: SparkSession, d: str) -> DataFrame:
    c = G.clustering(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), _similar(spark, d))
    return c.select("id", F.round("coefficient", 6).alias("coefficient"))


@query(f"""WITH {_NODES}, {_EDGES}, two AS (SELECT src AS id FROM edges WHERE rel <> 'is_part_of' UNION ALL SELECT dst FROM edges WHERE rel <> 'is_part_of')
    SELECT id FROM two JOIN nodes USING (id) GROUP BY id HAVING count(*) = 1""")
def degree_one(spark: SparkSession, d: str) -> DataFrame:
    n, e = _relational(spark, d)
    return G.degree_one(n, e.where("rel <> 'is_part_of'"))


@query(f"{_GRAPH} SELECT DISTINCT src AS id, dst AS neighbour FROM two WHERE src LIKE 'nation:%'")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    n, e = _relational(spark, d)
    return G.neighbours(e, n.where(F.col("id").like("nation:%")))


@query(f"""{_GRAPH} SELECT src AS id, 'out' AS direction, rel, dst AS other FROM edges WHERE src LIKE 'nation:%'
    UNION ALL SELECT dst, 'in', rel, src FROM edges WHERE dst LIKE 'nation:%'""")
def connections(spark: SparkSession, d: str) -> DataFrame:
    n, e = _relational(spark, d)
    return G.connections(e, n, n.where(F.col("id").like("nation:%")))


@query(f"""{_GRAPH} SELECT src, rel, dst FROM edges WHERE EXISTS (SELECT 1 FROM nodes WHERE id = src AND type = 'TableRow') AND EXISTS (SELECT 1 FROM nodes WHERE id = dst AND type = 'TableRow')""")
def filtered_subgraph(spark: SparkSession, d: str) -> DataFrame:
    n, e = _relational(spark, d)
    return G.subgraph_where(n, e, F.col("type") == "TableRow")[1].select("src", "rel", "dst")


def _document_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents of lineitem chunks that contain parts, which have brands."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    chunk = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    part = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    doc = F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))
    nodes = li.select(chunk.alias("id"), F.lit("DocumentChunk").alias("type")).union(li.select(doc, F.lit("Document")).distinct()).union(p.select(part("p_partkey"), F.lit("Entity"))).union(p.select("p_brand", F.lit("EntityType")).distinct())
    edges = li.select(chunk.alias("src"), doc.alias("dst"), F.lit("is_part_of").alias("rel")).union(li.select(chunk, part("l_partkey"), F.lit("contains"))).union(p.select(part("p_partkey"), "p_brand", F.lit("is_a")))
    return nodes.dropDuplicates(["id"]), edges.distinct()


_DOC = """WITH doc AS (SELECT min(l_orderkey) AS k FROM lineitem),
    here AS (SELECT DISTINCT l_partkey AS p FROM lineitem, doc WHERE l_orderkey = k), away AS (SELECT DISTINCT l_partkey AS p FROM lineitem, doc WHERE l_orderkey <> k),
    orphan AS (SELECT p FROM here WHERE p IN (SELECT p_partkey FROM part) AND p NOT IN (SELECT p FROM away)),
    kinds AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey IN (SELECT p FROM orphan) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey NOT IN (SELECT p FROM orphan))),
    sub AS (SELECT 'd' || k AS id, 'document' AS category FROM doc UNION ALL SELECT DISTINCT 'c' || l_orderkey || '-' || l_linenumber, 'chunk' FROM lineitem, doc WHERE l_orderkey = k
            UNION ALL SELECT 'p' || p, 'orphan_entity' FROM orphan UNION ALL SELECT p_brand, 'orphan_type' FROM kinds)"""


def _first_document(spark: SparkSession, d: str) -> str:
    return f"d{table(spark, d, 'lineitem').agg(F.min('l_orderkey')).first()[0]}"


@query(f"{_DOC} SELECT id, category FROM sub")
def document_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.document_subgraph(*_document_graph(spark, d), _first_document(spark, d))


@query(f"{_DOC} SELECT category, count(*) AS deleted FROM sub GROUP BY category")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return G.delete_document(*_document_graph(spark, d), _first_document(spark, d))[2]


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f", r{k + 1} AS MATERIALIZED (SELECT s.id, 0.5 * coalesce(g, 0) + 0.5 * reset AS rank FROM s LEFT JOIN (SELECT dst, sum(p * rank) AS g FROM step JOIN r{k} ON step.src = r{k}.id GROUP BY dst) x ON x.dst = s.id)"
        for k in range(rounds)
    )
    return f"""{_GRAPH}, w AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM two WHERE src <> dst GROUP BY ALL),
        step AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM w),
        s AS MATERIALIZED (SELECT id, CASE WHEN id LIKE 'region:%' THEN 1.0 / (SELECT count(*) FROM region) ELSE 0.0 END AS reset FROM nodes),
        r0 AS MATERIALIZED (SELECT id, reset AS rank FROM s){steps} SELECT id, round(rank, 6) AS rank FROM r{rounds}"""


@query(_pagerank_sql(20))
def personalized_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """From the regions, over the operator's twenty rounds: what is left to come is below a millionth."""
    n, e = _relational(spark, d)
    seeds = n.where(F.col("id").like("region:%")).select("id", F.lit(1.0).alias("weight"))
    return G.personalized_pagerank(n, e.withColumn("weight", F.lit(1.0)), seeds, 0.5, 20).select("id", F.round("rank", 6).alias("rank"))


@query("""
    WITH q AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)),
    dist AS (SELECT vec_id AS id, round(1 - list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) AS distance FROM embeddings, q),
    e AS (SELECT s_suppkey AS edge_id, s_suppkey AS src, s_nationkey::BIGINT AS dst, 'rel' || s_suppkey % 5 AS rel FROM supplier),
    rd AS (SELECT rel, 0.1 * rel[4:]::INT AS distance FROM (SELECT DISTINCT rel FROM e))
    SELECT edge_id, src, rel, dst, round(coalesce(a.distance, 'inf'::DOUBLE) + coalesce(b.distance, 'inf'::DOUBLE) + rd.distance, 6) AS total
    FROM e LEFT JOIN dist a ON a.id = src LEFT JOIN dist b ON b.id = dst LEFT JOIN rd USING (rel) ORDER BY total, edge_id LIMIT 10""")
def triplet_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    mean = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))
    nodes = v.join(F.broadcast(mean)).select(F.col("vec_id").alias("id"), F.round(1 - cosine(F.col("embedding"), F.col("q")), 6).alias("distance"))
    s = table(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("edge_id"), F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.concat(F.lit("rel"), (F.col("s_suppkey") % 5).cast("string")).alias("rel"))
    rels = edges.select("rel").distinct().withColumn("distance", 0.1 * F.substring("rel", 4, 9).cast("int"))
    return G.triplet_topk(edges, nodes, rels, 10).withColumn("total", F.round("total", 6))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS chunk_id, 'p' || l_partkey AS s, 's' || l_suppkey AS o FROM lineitem)
    SELECT e AS entity, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, s AS e FROM t UNION ALL SELECT chunk_id, o FROM t) GROUP BY e""")
def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_frequency(_triples(spark, d))


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are dealt first, so no task counts as many different triples as a file's split has rows."""
    part, supp = (F.concat(F.lit(a), F.col(c).cast("string")) for a, c in (("p", "l_partkey"), ("s", "l_suppkey")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey")
    return lines.select(F.col("l_orderkey").alias("chunk_id"), part.alias("s"), F.lit("supplied_by").alias("p"), supp.alias("o")).distinct()


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS chunk_id, 'p' || l_partkey AS s, 's' || l_suppkey AS o FROM lineitem)
    SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT s AS src, o AS dst FROM t UNION ALL SELECT o, s FROM t) GROUP BY ALL""")
def fact_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.fact_edges(_triples(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, w(id, depth) AS (SELECT 'customer:' || min(c_custkey), 0 FROM customer UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = id WHERE depth < 10)
    SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY id""")
def ontology_closure(spark: SparkSession, d: str) -> DataFrame:
    start = table(spark, d, "customer").agg(F.concat(F.lit("customer:"), F.min("c_custkey").cast("string")).alias("id"))
    return G.ontology_closure(_relational(spark, d)[1], start, 10)


_REGIONAL = "rel IN ('n_regionkey', 's_nationkey')"


def _reach_sql(rounds: int) -> str:
    """``r{k}``: all pairs of nodes within ``k`` links."""
    return "r0 AS (SELECT id AS a, id AS b FROM nodes)" + "".join(f", r{k + 1} AS MATERIALIZED (SELECT a, b FROM r{k} UNION SELECT a, dst FROM r{k} JOIN near ON src = b)" for k in range(rounds))


@query(f"""{_GRAPH}, near AS (SELECT src, dst FROM edges WHERE {_REGIONAL} UNION SELECT dst, src FROM edges WHERE {_REGIONAL}), {_reach_sql(6)},
    n AS ({' UNION ALL '.join(f'SELECT {k}::INT AS dist, count(*) AS pairs FROM r{k}' for k in range(7))})
    SELECT dist, pairs FROM n QUALIFY pairs > coalesce(lag(pairs) OVER (ORDER BY dist), 0)""")
def path_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of regions, nations and suppliers lie within each distance; a nation's suppliers are walked as one."""
    n, e = _relational(spark, d)
    return G.path_counts(n, e.where(_REGIONAL))


_CLOSE = """close AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS sim
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
    step AS (SELECT a AS src, b AS dst, 1 / sim AS cost FROM close WHERE sim >= 0.3 UNION ALL SELECT b, a, 1 / sim FROM close WHERE sim >= 0.3)"""


def _walk_sql(rounds: int) -> str:
    """``w{k}``: least costs by at most ``k`` links."""
    return "w0 AS (SELECT item_id AS query_id, vec_id AS id, 0.0::DOUBLE AS cost FROM benchmark JOIN embeddings ON vec_id = item_id)" + "".join(
        f", w{k + 1} AS MATERIALIZED (SELECT query_id, id, min(cost) AS cost FROM (SELECT * FROM w{k} UNION ALL SELECT query_id, dst, w{k}.cost + step.cost FROM w{k} JOIN step ON src = id) GROUP BY ALL)" for k in range(rounds)
    )


@query(f"""WITH {_CLOSE}, {_walk_sql(14)},
    ends AS (SELECT query_id, min(cost) AS stop FROM w14 JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = id WHERE q.label = v.label AND id <> query_id GROUP BY query_id)
    SELECT w14.query_id, id, round(cost, 6) AS cost FROM w14 LEFT JOIN ends USING (query_id) WHERE cost <= coalesce(stop, 'inf'::DOUBLE)""")
def answer_walks(spark: SparkSession, d: str) -> DataFrame:
    """From the vector of each benchmark row through similar ones, the nearest first, to the first of its own label."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(v.select("id", "label"), F.col("query_id") == F.col("id"))
    out = walks_to_answers(v, asked.select("query_id", "id", F.lit(0.0).alias("cost")), asked.select("query_id", "label"), 0.3)
    return out.select("query_id", "id", F.round("cost", 6).alias("cost"))

"""Queries that build and edit graphs: appended parts, nested models, extractions, users' relations, code, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators import chunking, graph as G, graph_memory as GM
from memlake.operators.cascade import cascade, statement_reader
from memlake.operators.vector_store import similar_pairs
from memlake.plans.catalog import query
from memlake.plans.graph_queries import _EDGES, _KEYS, _relational, _triples
from memlake.plans.pipelines import knowledge_graph
from memlake.plans.vector_queries import _CENTRES, _COS, _centres, _vectors
from memlake.sources.tables import table, texts

#: SQL of a name-based UUID in the object namespace, of an expression.
_UUID = """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] FROM (SELECT sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({0})) AS h))"""
_NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id FROM {t} UNION ALL SELECT '{t}'" for t, k in _KEYS) + ")"


@query(f"WITH {_EDGES} SELECT src, rel, dst FROM edges WHERE rel = 'n_regionkey' OR (rel = 's_nationkey' AND src <> 'supplier:1')")
def appended_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges are appended once each; edges to what is no node, and self loops, are left out."""
    n, e = _relational(spark, d)
    kind = F.substring_index("id", ":", 1)
    base = n.where(kind.isin("region", "nation"))
    some = n.where((kind == "supplier") & (F.col("id") != "supplier:1"))
    nodes = G.added_nodes(base, some.unionByName(base))
    links = e.where(F.col("rel").isin("n_regionkey", "s_nationkey")).select("src", "dst", "rel")
    odd = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("self").alias("rel")).unionByName(nodes.select(F.col("id").alias("src"), F.lit("nowhere").alias("dst"), F.lit("lost").alias("rel")))
    edges = G.added_edges(links.where("rel = 'n_regionkey'"), links.unionByName(links).unionByName(odd))
    return G.valid_edges(edges, nodes).select("src", "rel", "dst")


@query(f"WITH {_EDGES} SELECT src, rel, dst FROM edges WHERE rel = 'n_regionkey' AND src <> 'nation:3'")
def known_edges(spark: SparkSession, d: str) -> DataFrame:
    """Which of the asked edges there are, once a nation is taken out."""
    n, e = _relational(spark, d)
    _, left = G.without_nodes(n, e, n.where("id = 'nation:3'"))
    asked = e.where("rel = 'n_regionkey'").select("src", "dst", "rel")
    return G.existing_edges(left, asked.unionByName(asked.withColumn("rel", F.lit("never")))).select("src", "rel", "dst")


@query(f"WITH {_EDGES} SELECT src, rel, dst FROM edges WHERE NOT (rel = 's_nationkey' AND dst IN ('nation:1', 'nation:2'))")
def relation_removed(spark: SparkSession, d: str) -> DataFrame:
    """One relation's edges at two nodes are taken away, all others stay."""
    n, e = _relational(spark, d)
    return G.without_relation(e, n.where("id IN ('nation:1', 'nation:2')"), "s_nationkey").select("src", "rel", "dst")


@query(f"""WITH v AS (SELECT vec_id, label, embedding, ['l' || label, 'm' || vec_id % 5, 'n' || vec_id % 3] AS cs FROM embeddings),
    p AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS.format('a.embedding', 'b.embedding')} AS sim, len(list_intersect(a.cs, b.cs)) / 3.0 AS shared FROM v a JOIN v b ON a.vec_id < b.vec_id)
    SELECT src, dst, round(0.7 * sim + 0.3 * shared, 6) AS weight FROM p WHERE sim > 0.35""")
def similarity_weights(spark: SparkSession, d: str) -> DataFrame:
    """Similar chunks, weighted by similarity and shared concepts."""
    tag = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    v = _vectors(spark, d).withColumn("concepts", F.array(tag("l", F.col("label")), tag("m", F.col("id") % 5), tag("n", F.col("id") % 3)))
    return G.similarity_graph(similar_pairs(v, 0.35, keep=("concepts",))).select("src", "dst", F.round("weight", 6).alias("weight"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer as a struct and their lines as an array of structs."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_quantity").alias("n"))).alias("has"))
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.lit("x").alias("path")).alias("placed_by"))
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "placed_by", "has")


_MODEL = {"placed_by": ("id", "Customer"), "has": ("id", "Part")}


@query("""SELECT 'o' || o_orderkey AS id, 'Order' AS type FROM orders UNION SELECT 'c' || o_custkey, 'Customer' FROM orders UNION SELECT 'p' || l_partkey, 'Part' FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def model_nodes(spark: SparkSession, d: str) -> DataFrame:
    return GM.model_graph(_orders(spark, d), "Order", "id", _MODEL)[0]


@query("""SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed_by' AS rel FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'has' FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def model_edges(spark: SparkSession, d: str) -> DataFrame:
    return GM.model_graph(_orders(spark, d), "Order", "id", _MODEL)[1]


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's extraction: itself and its nation, with a relation between them."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    node = lambda name, kind: F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"))
    edge = F.struct(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("Based In").alias("rel"))
    return j.select(F.format_string("c%06d", "s_suppkey").alias("chunk_id"), F.array(node("s_name", "Company"), node("n_name", "Home Country")).alias("nodes"), F.array(edge).alias("edges"))


_J = "j AS (SELECT printf('c%06d', s_suppkey) AS chunk_id, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH {_J}, n AS (SELECT s_name AS name, 'Entity' AS type FROM j UNION SELECT n_name, 'Entity' FROM j UNION SELECT unnest(['Company', 'Home Country']), 'EntityType')
    SELECT {_UUID.format("translate(lower(name), ' ''', '_')")} AS id, lower(name) AS name, type FROM n""")
def integrated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.integrate(_extracted(spark, d))[0]


@query(f"""WITH {_J}, e AS (SELECT s_name AS a, n_name AS b, 'based_in' AS rel FROM j UNION SELECT s_name, 'Company', 'is_a' FROM j UNION SELECT n_name, 'Home Country', 'is_a' FROM j)
    SELECT {_UUID.format("translate(lower(a), ' ''', '_')")} AS src, {_UUID.format("translate(lower(b), ' ''', '_')")} AS dst, rel FROM e
    UNION SELECT chunk_id, {_UUID.format("translate(lower(x), ' ''', '_')")}, 'contains' FROM (SELECT chunk_id, unnest([s_name, n_name]) AS x FROM j)""")
def integrated_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.integrate(_extracted(spark, d))[1]


@query("""SELECT 'part' AS type, unnest(['p_name', 'p_brand']) AS field, p_partkey AS id, unnest([p_name, p_brand]) AS text FROM part UNION ALL SELECT 'supplier', 'p_name', s_suppkey, s_name FROM supplier""")
def indexed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every type that is to be embedded."""
    p = table(spark, d, "part").select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"), "p_name", "p_brand")
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    return G.index_fields(p.unionByName(s), {"part": ["p_name", "p_brand"], "supplier": ["p_name", "p_brand"]})


def _memory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each label is a user whose vectors are nodes, linked to the next one; a benchmark item brings a new relation."""
    v, b = table(spark, d, "embeddings"), table(spark, d, "benchmark")
    nodes = v.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("label").cast("string").alias("user_id"), F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    edges = v.select(F.col("label").cast("string").alias("user_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("src"), F.lit("next").alias("rel"), F.concat(F.lit("v"), (F.col("vec_id") + 10).cast("string")).alias("dst"))
    new = v.join(b, v.vec_id == b.item_id).select(F.col("label").cast("string").alias("user_id"), F.concat(F.lit("Item "), F.col("vec_id").cast("string")).alias("source"), F.lit("Tells Of").alias("rel"), F.concat(F.lit("Thing "), F.col("vec_id").cast("string")).alias("destination"), F.col("embedding").alias("source_vector"), F.transform("embedding", lambda x: -x).alias("destination_vector"))
    return nodes, edges, new


@query(f"""WITH i AS (SELECT vec_id, label, embedding FROM embeddings JOIN benchmark ON item_id = vec_id),
    opposite AS (SELECT i.vec_id, e.vec_id AS other, {_COS.format('e.embedding', 'list_transform(i.embedding, lambda x: -x)')} AS s FROM i JOIN embeddings e USING (label)),
    near AS (SELECT vec_id, other FROM opposite WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) = 1)
    SELECT CAST(label AS VARCHAR) AS user_id, 'v' || i.vec_id AS src, 'tells_of' AS rel, coalesce('v' || other, {_UUID.format("label || '|thing_' || i.vec_id")}) AS dst FROM i LEFT JOIN near USING (vec_id)""")
def merged_relations(spark: SparkSession, d: str) -> DataFrame:
    """New relations of all users: an end is the user's most similar node, or becomes one; told twice, nothing is added."""
    nodes, edges, new = _memory(spark, d)
    n, e = GM.merge_relations(nodes, edges, new)
    return GM.merge_relations(n, e, new)[1].where("rel = 'tells_of'")


@query(f"""WITH {_CENTRES}, s AS (SELECT query_id, vec_id, round({_COS.format('embedding', 'qv')}, 4) AS sim FROM embeddings CROSS JOIN c), h AS (SELECT * FROM s WHERE sim >= 0.25)
    SELECT query_id, 'v' || vec_id AS src, 'next' AS rel, 'v' || (vec_id + 10) AS dst, sim AS similarity FROM h UNION SELECT query_id, 'v' || (vec_id - 10), 'next', 'v' || vec_id, sim FROM h WHERE vec_id >= 10""")
def relations_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Incoming and outgoing relations of all nodes that are similar enough."""
    nodes, edges, _ = _memory(spark, d)
    return GM.both_directions(nodes, edges, _centres(spark, d), 0.25).select("query_id", "src", "rel", "dst", "similarity")


@query("""SELECT 'n' || a.vec_id AS source, 'next' AS relationship, 'n' || b.vec_id AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 10 WHERE a.label = 2 ORDER BY source, relationship, target LIMIT 20""")
def user_relations(spark: SparkSession, d: str) -> DataFrame:
    """A user's relations by name, after another user's graph is deleted."""
    nodes, edges, _ = _memory(spark, d)
    n, e = GM.without_user(nodes.withColumn("user_id", F.when(F.col("user_id") != "1", "2").otherwise("1")), edges, "1")
    return GM.user_relations(n.unionByName(nodes.where("user_id = '1'").withColumn("user_id", F.lit("2"))), e, "2", 20)


@query("""SELECT 'pkg/n' || n_nationkey || '.py' AS src, 'pkg/n' || n_regionkey || '.py' AS dst FROM nation WHERE n_nationkey <> n_regionkey UNION SELECT 'pkg/n' || n_nationkey || '.py', 'pkg/__init__.py' FROM nation""")
def import_links(spark: SparkSession, d: str) -> DataFrame:
    """Python files and what they import of their own repository."""
    n = table(spark, d, "nation")
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    files = n.select(F.concat(F.lit("pkg/n"), k, F.lit(".py")).alias("path"), F.encode(F.concat(F.lit("import os\nimport pkg.n"), r, F.lit("\nfrom pkg import x\n")), "UTF-8").alias("content"))
    return GM.import_graph(files.union(spark.createDataFrame([("pkg/__init__.py", bytearray(b""))], "path string, content binary")))


@query(f"""WITH c AS (SELECT 'd' || doc_id AS chunk_id, lang, source FROM documents) SELECT chunk_id AS src, {_UUID.format('source')} AS dst, 'is_classified_as' AS rel FROM c UNION SELECT {_UUID.format('source')}, {_UUID.format('lang')}, 'is_subtype_of' FROM c""")
def label_edges(spark: SparkSession, d: str) -> DataFrame:
    """Classified chunks: sources as subclasses of languages."""
    chunks = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "lang", "source")
    return GM.label_graph(chunks, F.col("lang"), F.array("source"))[1]


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^ .;!?…。！？]*(?: |[.;!?…。！？] *)|[^ .;!?…。！？]+')) AS tokens FROM documents WHERE length(text) > 0""")
def knowledge_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document that became chunks of a knowledge graph."""
    return knowledge_graph(texts(spark, d, "documents"), 128)["totals"].select("doc_id", "tokens")


@query("""WITH l AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 1)
    SELECT conv_id || '-' || min(turn) AS chunk_id FROM conversations GROUP BY conv_id UNION SELECT conv_id || '-' || turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM l)""")
def obsolete_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that nothing leads to, and those outside the largest chain."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("chunk_id"))
    links = t.select("conv_id", "turn", F.col("chunk_id").alias("dst")).join(t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("chunk_id").alias("src")), ["conv_id", "turn"]).select("src", "dst")
    return chunking.obsolete_chunks(chunking.checked_chunks(t.withColumn("text", F.col("chunk_id"))), links, t.select(F.col("chunk_id").alias("node"), F.col("conv_id").alias("component")))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS chunk_id, 'p' || l_partkey AS s, 's' || l_suppkey AS o FROM lineitem),
    f AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT s AS src, o AS dst FROM t UNION ALL SELECT o, s FROM t) GROUP BY ALL)
    SELECT 'chunk-' || chunk_id AS src, unnest([s, o]) AS dst, 1.0 AS weight FROM t UNION SELECT src, dst, 0.9 FROM f WHERE src IN ('p1', 's1') UNION SELECT src, dst, weight FROM f WHERE src NOT IN ('p1', 's1')""")
def phrase_graph(spark: SparkSession, d: str) -> DataFrame:
    """Facts, passages and synonyms as one graph; a synonym edge takes the place of a fact's."""
    triples = _triples(spark, d)
    facts = G.fact_edges(triples)
    synonyms = facts.where("src IN ('p1', 's1')").select("src", "dst", F.lit(0.9).alias("weight"))
    return G.merged_edges(facts, G.passage_edges(triples), synonyms)


@query(f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 || '-!' ELSE 'ph' || vec_id END AS phrase, embedding FROM embeddings), w AS (SELECT * FROM v WHERE length(regexp_replace(phrase, '[^A-Za-z0-9]', '', 'g')) > 2),
    p AS (SELECT a.phrase AS src, b.phrase AS dst, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM w a JOIN v b ON a.phrase <> b.phrase)
    SELECT src, dst, score AS weight FROM p WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 4""")
def synonym_links(spark: SparkSession, d: str) -> DataFrame:
    """Similar phrases, for those of over two letters or digits."""
    v = table(spark, d, "embeddings")
    phrase = F.when(F.col("vec_id") % 3 == 0, F.concat((F.col("vec_id") % 10).cast("string"), F.lit("-!"))).otherwise(F.concat(F.lit("ph"), F.col("vec_id").cast("string")))
    return G.synonym_edges(v.select(phrase.alias("id"), F.col("embedding").alias("vector")), 4, 0.3)


@query("""
    WITH c AS (SELECT c_custkey AS chunk_id, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT chunk_id, unnest(['node', 'node', 'node', 'node', 'relation', 'relation', 'triplet', 'triplet', 'triplet']) AS kind,
           unnest([c_name, n_name, r_name, 'world', 'in', 'of', c_name || '|in|' || n_name, n_name || '|of|' || r_name, r_name || '|of|world']) AS name,
           unnest([1, 2, 3, 4, 1, 1, 1, 1, 1]) AS round FROM c""")
def cascaded_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customers' places as statements, read in rounds of three; the world comes with the relations, in the round after."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    said = F.concat_ws("; ", F.concat_ws(" in ", "c_name", "n_name"), F.concat_ws(" of ", "n_name", "r_name"), F.concat(F.col("r_name"), F.lit(" of world")))
    nodes, names, edges = cascade(rows.select(F.col("c_custkey").alias("chunk_id"), said.alias("text")), *statement_reader(), rounds=3)
    kind = lambda t, k, name: t.select("chunk_id", F.lit(k).alias("kind"), name.alias("name"), "round")
    return kind(nodes, "node", F.col("name")).unionByName(kind(names, "relation", F.col("name"))).unionByName(kind(edges, "triplet", F.concat_ws("|", "source", "rel", "target")))

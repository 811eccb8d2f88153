"""Queries over sources and sinks: samples, files written and read again, runs, caches, ingested contents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions.ids import hash_id
from memlake.operators import evaluation as ev, graph_memory as GM, listing as L
from memlake.operators.retrieval import search_types
from memlake.plans.catalog import query
from memlake.plans.graph_queries import _EDGES, _relational
from memlake.plans.pipelines import dataset_names, matched_datasets
from memlake.scratch import scratch_path
from memlake.sources import files, tables as T
from memlake.sources.tables import table


def _text_file(lines: DataFrame, name: str) -> str:
    """Few rows of one text column as a file of their own."""
    path = scratch_path(lines.sparkSession, name)
    lines.coalesce(1).write.text(path)
    return path


def _joined(df: DataFrame, order: str, text: str, sep: str) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.agg(F.array_join(rows, sep).alias("value"))


@query("SELECT doc_id, source FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("row_idx"), F.struct("source").alias("metadata"))
    return T.source_split(docs, "src3", 20).select("doc_id", "metadata.source")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 25")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.sample(table(spark, d, "documents").select("doc_id"), 25, F.col("doc_id"))


@query("SELECT text AS question, md5(text) AS answer, (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) FROM nation) || chr(10) AS context FROM benchmark")
def context_questions(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of questions, each with the text of a context file."""
    b = table(spark, d, "benchmark")
    qa = scratch_path(spark, "qa")
    b.select(F.col("text").alias("question"), F.array(F.md5("text")).alias("answer")).write.json(qa)
    context = _text_file(_joined(table(spark, d, "nation"), "n_nationkey", "n_name", ", "), "context")
    return files.qa_with_context(spark, qa, context, lines=True).select("question", F.element_at("answer", 1).alias("answer"), "context")


@query("SELECT 'nation.' || n_nationkey AS key, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' # no' ELSE '' END AS value FROM nation")
def config_values(spark: SparkSession, d: str) -> DataFrame:
    """A configuration file's values, some in quotes, with comments and blank lines between them."""
    k = F.col("n_nationkey").cast("string")
    line = F.concat(F.lit("nation."), k, F.lit(": "), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"'), "n_name", F.lit(' # no"'))).otherwise(F.col("n_name")), F.lit("  # yes"))
    lines = table(spark, d, "nation").select(F.explode(F.array(line, F.lit(""), F.lit("# all: of it"))).alias("value"))
    return files.config_rows(spark, _text_file(lines, "config")).select("key", "value")


@query("SELECT o_orderpriority, count(*) AS n, 'b' AS run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def saved_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' results in one place; the second run is tried twice."""
    path, o = scratch_path(spark, "runs"), table(spark, d, "orders")
    for status, run in (("O", "a"), ("F", "b"), ("F", "b")):
        T.save_results(o.where(F.col("o_orderstatus") == status).groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, run)
    return T.load_results(spark, path, "b")


@query("SELECT 'region-' || md5(r_name) AS hash_id, r_name FROM region WHERE r_name IN ('EUROPE', 'ASIA')")
def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows by keys in the order asked; one key is not there."""
    stored = T.hashed(table(spark, d, "region"), "r_name", "region-")
    keys = spark.createDataFrame([("EUROPE",), ("nothing",), ("ASIA",)], "n string").select(hash_id(F.col("n"), "region-").alias("k"))
    return T.lookup(stored, [r["k"] for r in keys.collect()]).select("hash_id", "r_name")


@query(f"WITH {_EDGES} SELECT src, rel, dst FROM edges")
def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "graph")
    GM.write_graph(*_relational(spark, d), path)
    return GM.read_graph(spark, path)[1].select("src", "rel", "dst")


@query("SELECT DISTINCT 'chunk-' || md5(text) AS idx, text AS passage FROM conversations")
def extraction_cache(spark: SparkSession, d: str) -> DataFrame:
    """Extraction results by the content of their passage; those that are stored are not added again."""
    cache = files.extraction_rows(table(spark, d, "conversations").select(F.col("text").alias("passage")))
    stored = cache.where("length(passage) > 300")
    return stored.unionByName(T.missing(cache, stored, "idx"))


@query("SELECT count(DISTINCT embedding) AS n FROM embeddings JOIN documents ON doc_id = vec_id WHERE length(trim(text)) > 0")
def embeddable_passages(spark: SparkSession, d: str) -> DataFrame:
    v, t = table(spark, d, "embeddings"), table(spark, d, "documents")
    rows = v.join(t, v.vec_id == t.doc_id).select("text", "embedding")
    return files.embeddable(rows.unionByName(rows)).agg(F.count("*").alias("n"))


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("."))
    return table(spark, d, "pages").select(F.concat(name, F.lit("html")).alias("name"), F.lit("html").alias("extension"), F.encode("html", "UTF-8").alias("content"))


@query("""
    WITH h AS (SELECT DISTINCT md5(html) AS content_hash FROM pages), s AS (SELECT content_hash, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(content_hash || 'me')) AS h FROM h)
    SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS data_id, content_hash, 'me' AS owner FROM s""")
def ingested_files(spark: SparkSession, d: str) -> DataFrame:
    """Contents of an owner, each once; ingested again over what is stored, nothing is added."""
    once = files.ingested(_page_files(spark, d), "me")
    again = files.ingested(_page_files(spark, d).withColumn("name", F.lit("again.html")), "me")
    return files.merged_data(once, again).select("data_id", "content_hash", "owner")


@query("SELECT 'page' || page_id || '.' || CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'mp3' ELSE 'docx' END AS name, CASE page_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'audio' ELSE 'unstructured' END AS kind FROM pages")
def classified_files(spark: SparkSession, d: str) -> DataFrame:
    """What kind of document a file's extension makes it."""
    pick = F.element_at(F.array(*map(F.lit, ("html", "pdf", "mp3", "docx"))), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    rows = table(spark, d, "pages").select(pick.alias("extension"), F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("."), pick).alias("name"))
    return files.classified(rows).select("name", "kind")


@query("""SELECT 'main_dataset' AS dataset, count(*) AS files FROM region UNION ALL SELECT 'geo.' || r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def dataset_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders below a root name the data sets; those below ``geo``, and the root's own."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    paths = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("file:/data/root/geo/"), "r_name", F.lit("/"), "n_name", F.lit(".txt")).alias("path"))
    paths = paths.union(r.select(F.concat(F.lit("file:/data/root/"), "r_name", F.lit(".txt"))))
    names = dataset_names(paths, "/data/root/")
    found = matched_datasets(names, "geo").unionByName(matched_datasets(names, "main_dataset"))
    return found.groupBy("dataset").agg(F.count("*").alias("files"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 7")
def filtered_view(spark: SparkSession, d: str) -> DataFrame:
    """A catalog table by name, with an equality and a membership."""
    table(spark, d, "customer").createOrReplaceTempView("filtered_view_customer")
    return T.filtered_table(spark, "filtered_view_customer", {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 7}).select("c_custkey", "c_name")


@query("SELECT table_name AS name, column_name AS col, CASE table_name WHEN 'nation' THEN 'n_nationkey' ELSE 'r_regionkey' END AS key, CASE WHEN column_name = 'n_regionkey' THEN 'region' END AS refers FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
def reflected_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns, keys and references of tables."""
    got = T.reflect({t: table(spark, d, t) for t in ("nation", "region")}, {"nation": "n_nationkey", "region": "r_regionkey"}, {"nation": [("n_regionkey", "region", "r_regionkey")]})
    rows = [(name, c["name"], t["primary_key"], next((f["ref_table"] for f in t["foreign_keys"] if f["column"] == c["name"]), None)) for name, t in got.items() for c in t["columns"]]
    return spark.createDataFrame(rows, "name string, col string, key string, refers string")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def raw_sql(spark: SparkSession, d: str) -> DataFrame:
    """A query's text, passed on as it is by the search dispatcher."""
    for t in ("nation", "region"):
        table(spark, d, t).createOrReplaceTempView(f"raw_sql_{t}")
    return search_types().search("cypher", spark, "SELECT r_name, count(*) AS n FROM raw_sql_nation JOIN raw_sql_region ON n_regionkey = r_regionkey GROUP BY r_name")


@query("""SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def nested_ontology_links(spark: SparkSession, d: str) -> DataFrame:
    """Regions of nations of suppliers as nested children, written as JSON and read again."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    kids = lambda df, by: df.groupBy(by).agg(F.collect_list("x").alias("children"))
    a = kids(s.select("s_nationkey", F.struct(F.col("s_name").alias("name")).alias("x")), "s_nationkey")
    b = n.join(a, n.n_nationkey == a.s_nationkey, "left").select("n_regionkey", F.struct(F.col("n_name").alias("name"), "children").alias("x"))
    rows = r.join(kids(b, "n_regionkey"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), "children")
    path = scratch_path(spark, "ontology")
    rows.write.json(path)
    return files.nested_ontology(files.jsonl(spark, path, rows.schema), 5)


_XML = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'


def _rdf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions as classes, nations as their subclasses, suppliers as individuals that trade with a region."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    s = s.withColumn("s_name", F.translate("s_name", "#", " "))
    ref = lambda tag, c: F.concat(F.lit(f'<{tag} rdf:resource="http://x/o#'), c, F.lit('"/>'))
    el = lambda tag, name, *inner: F.concat(F.lit(f'<{tag} rdf:about="http://x/o#'), name, F.lit('">'), F.lit("<rdfs:label>l</rdfs:label>"), *inner, F.lit(f"</{tag}>"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = r.select(el("owl:Class", F.col("r_name")).alias("v"))
    lines = lines.union(n.join(r, n.n_regionkey == r.r_regionkey).select(el("owl:Class", F.col("n_name"), ref("rdfs:subClassOf", F.col("r_name")))))
    lines = lines.union(j.select(el("owl:NamedIndividual", F.col("s_name"), ref("rdf:type", F.col("n_name")), ref("owl:tradesWith", F.col("r_name")))))
    path = scratch_path(spark, "rdf")
    # Documents of about a hundred elements, a file each.
    part = F.pmod(F.xxhash64("v"), F.lit(max(1, lines.count() // 100)))
    whole = lines.groupBy(part).agg(F.concat(F.lit(_XML), F.array_join(F.collect_list("v"), "\n"), F.lit("</rdf:RDF>")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.rdf_ontology(spark, path)


@query("""SELECT translate(lower(n_name), ' ', '_') AS src, 'is_a' AS rel, translate(lower(r_name), ' ', '_') AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT translate(lower(s_name), '#', '_'), unnest(['is_a', 'tradesWith']), unnest([translate(lower(n_name), ' ', '_'), translate(lower(r_name), ' ', '_')]) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def rdf_links(spark: SparkSession, d: str) -> DataFrame:
    return _rdf(spark, d)[1]


@query("""SELECT translate(lower(r_name), ' ', '_') AS id, r_name AS name, 'classes' AS kind FROM region UNION ALL SELECT translate(lower(n_name), ' ', '_'), n_name, 'classes' FROM nation UNION ALL SELECT translate(lower(s_name), '#', '_'), translate(s_name, '#', ' '), 'individuals' FROM supplier""")
def rdf_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _rdf(spark, d)[0]


_MULTI = "t AS (SELECT conv_id, 'c' || conv_id || '/' || role AS title, list(text ORDER BY turn) AS ss FROM conversations GROUP BY conv_id, role)"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a question; each role's messages are the sentences of a titled paragraph."""
    t = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("sentences"))
    t = t.select("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), "role").alias("title"), "sentences")
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("title", "sentences"))).alias("context"))


@query(f"""WITH {_MULTI} SELECT conv_id AS id, string_agg(title || ': ' || ss[1], chr(10) ORDER BY title) AS golden FROM t GROUP BY conv_id""")
def multihop_golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden contexts: the first sentence of each titled paragraph."""
    support = F.transform("context", lambda c: F.struct(c["title"].alias("title"), F.lit(0).alias("sent")))
    rows = _titled(spark, d).select(F.col("conv_id").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), "context", support.alias("supporting"))
    return files.multihop(rows, "titled")[1].select("id", "golden")


@query(f"""WITH {_MULTI} SELECT DISTINCT 'doc-' || md5(title || chr(10) || array_to_string(ss, '')) AS doc_id FROM t""")
def multihop_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of decomposed questions: each paragraph once."""
    paragraphs = F.transform("context", lambda c: F.struct(c["title"].alias("title"), F.array_join(c["sentences"], "").alias("paragraph_text")))
    parts = F.transform("context", lambda c: F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(0).alias("paragraph_support_idx")))
    rows = _titled(spark, d).select(F.col("conv_id").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), paragraphs.alias("paragraphs"), parts.alias("question_decomposition"))
    return files.multihop(rows.unionByName(rows), "paragraphs")[0].select("doc_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) IN (1, 8, 100)")
def instances_by_position(spark: SparkSession, d: str) -> DataFrame:
    return T.instances(table(spark, d, "documents").select("doc_id"), positions=[0, 7, 99], id_col="doc_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def left_to_judge(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a judge has not seen, and what a resumed run still has to do: the same here."""
    labels = table(spark, d, "labels")
    todo = ev.needs_judging(labels.where("quality = 1"), labels.where("toxic = 1").select("doc_id"), "doc_id")
    return T.remaining(todo, labels.where("toxic = 1"), ["doc_id"]).select("doc_id")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS field, NULL::VARCHAR AS past FROM part")
def picked_fields(spark: SparkSession, d: str) -> DataFrame:
    """An entry of the first list that is not empty; null past its end."""
    top = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_name")).otherwise(F.array().cast("array<string>"))
    meta: Column = F.array("p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", T.picked(top, meta, F.lit(1)).alias("field"), T.picked(top, meta, F.lit(2)).alias("past"))


@query("""
    WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS qs, list(text ORDER BY turn) FILTER (role = 'assistant') AS ans FROM conversations GROUP BY conv_id),
    z AS (SELECT conv_id, coalesce(qs, []) AS qs, coalesce(ans, []) AS ans FROM c),
    m AS (SELECT conv_id, unnest(range(least(len(qs), len(ans)))) AS pos, qs, ans FROM z WHERE len(qs) > 1 AND len(ans) > 1)
    SELECT conv_id, CAST(pos AS INT) AS pos, qs[pos + 1] AS question, 1 AS n, ans[pos + 1] AS answers FROM m
    UNION ALL SELECT conv_id, 0, qs[1], CAST(len(ans) AS INT), array_to_string(ans, '|') FROM z WHERE NOT (len(qs) > 1 AND len(ans) > 1)""")
def question_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's user messages as questions, the assistant's as answers, paired by position."""
    t = table(spark, d, "conversations")
    of = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return T.question_pairs(t.groupBy("conv_id").agg(of("user").alias("questions"), of("assistant").alias("answers")), "conv_id").withColumn("n", F.size("answers")).withColumn("answers", F.array_join("answers", "|"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a CSV file, inserted into a table by name in two parts, and read from it."""
    path, name = scratch_path(spark, "csv"), f"inserted_{uuid.uuid4().hex}"
    schema = "s_suppkey long, s_name string, s_nationkey int"
    table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(", of")).alias("s_name"), "s_nationkey").write.option("header", "true").option("quoteAll", "true").csv(path)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet LOCATION '{scratch_path(spark, 'inserted')}'")
    rows = files.csv_rows(spark, path, schema)
    n = T.insert_rows(rows.where("s_nationkey < 10"), name) + T.insert_rows(rows.where("s_nationkey >= 10"), name)
    return T.filtered_table(spark, name).where(F.lit(n) == rows.count()).withColumn("s_name", F.regexp_replace("s_name", ", of$", ""))


@query("SELECT conv_id, turn, text FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id, min(turn) FROM conversations GROUP BY 1)")
def rows_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Messages by lists of ids, one a conversation, in the lists' order."""
    t = table(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    first = t.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(F.array(F.concat_ws("-", "conv_id", "turn")).alias("ids"))
    return L.in_order(t, first).select("conv_id", "turn", "text")

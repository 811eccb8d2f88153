from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.functions.sql import register
from memlake.operators import listing as L, memory as M
from memlake.operators.vector_store import VectorStore, knn_join, minmax, predicate
from memlake.sources import files, tables as T


@pytest.fixture
def store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "store"))
    s.create_collection("a")
    s.insert("a", spark.createDataFrame([("1", [1.0, 0.0], {"k": "x", "n": "1"}), ("2", [0.6, 0.8], {"k": "y", "n": "5"}), ("3", [0.0, 1.0], {"k": "x", "n": "9"})], "id string, vector array<float>, payload map<string,string>"))
    return s


def hits(df):
    return [(r.id, round(r.score, 4)) for r in df.orderBy("query_id", "rank").collect()]


def test_store_contract(spark, store, tmp_path):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>")
    assert hits(store.search("a", q, 2)) == [("1", 1.0), ("2", 0.6)]
    assert hits(store.search("a", q, 2, metric="l2")) == [("1", 0.0), ("2", 0.8944)]
    # Filters come first, so the limit is still filled.
    assert hits(store.search("a", q, 2, filters={"k": "x"})) == [("1", 1.0), ("3", 0.0)]
    assert hits(store.search("a", q, 3, filters={"n": {"gte": 2, "lte": 9}})) == [("2", 0.6), ("3", 0.0)]
    assert hits(store.search("a", q, 3, filters={"k": ["y", "z"]})) == [("2", 0.6)]
    assert store.search("a", q, 3, filters={"nokey": "x"}).count() == 0
    r = store.search("a", q, 1).first()
    assert (r.similarity, r.distance) == (1.0, 0.0)
    assert [round(x.normalized, 3) for x in store.distances("a", q).orderBy("distance").collect()] == [0.0, 0.4, 1.0]
    store.upsert("a", spark.createDataFrame([("1", [0.0, 1.0], {"k": "z"})], "id string, vector array<float>, payload map<string,string>"))
    store.delete("a", ["2"])
    store.update("a", "3", payload={"k": "w"})
    assert {r.id: r.payload["k"] for r in store.list("a").collect()} == {"1": "z", "3": "w"}
    assert [r.id for r in store.get("a", ["3", "1", "2"]).collect()] == ["3", "1"]
    assert store.collection_info("a") == {"name": "a", "rows": 2, "dims": 2}
    store.compact("a")
    assert store.rows("a").count() == 2 and store.list_collections() == ["a"]
    # A compaction that was broken off between its two moves is mended.
    root = tmp_path / "store"
    (root / "a").rename(root / ".a.old")
    assert store.has_collection("a") and store.rows("a").count() == 2
    store.create_collection("b")
    assert store.has_collection("b")
    store.prune()
    assert store.list_collections() == []


def test_knn_and_minmax(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id int, vector array<double>")
    got = knn_join(v, v, 2, blocks=3).collect()
    assert len(got) == 12 and all(r.src != r.dst for r in got)
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "query_id int, score double")
    assert [r.normalized for r in minmax(same).collect()] == [0.0, 0.0]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT cosine_distance(array(1.0D, 0.0D), array(0.0D, 2.0D)), cosine_distance(array(1.0D), array(1.0D, 1.0D)), node_key('O''Neil B'), hash_id('x-', 'a')").first()
    assert r[0] == 1.0 and r[1] is None and r[2] == "oneil_b" and r[3] == "x-0cc175b9c0f1b6a831c399e269772661"


def rows(spark, n=20):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + timedelta(hours=i // 2), "ab"[i % 2], i % 5 == 0) for i in range(n)], "id int, created_at timestamp, kind string, is_deleted boolean")


def test_listing(spark):
    df = rows(spark)
    ids = lambda spec: [r.id for r in L.list_rows(df, spec).collect()]
    assert ids(L.Listing(limit=3)) == [1, 2, 3]
    assert ids(L.Listing(limit=3, after=(datetime(2024, 1, 1, 1), 2))) == [3, 4, 6]
    assert ids(L.Listing(limit=3, ascending=False, after=(datetime(2024, 1, 1, 1), 3))) == [2, 1]
    assert ids(L.Listing(before=(datetime(2024, 1, 1, 1), 3))) == [1, 2]
    assert ids(L.Listing(after=(datetime(2024, 1, 1), 1), before=(datetime(2024, 1, 1, 9), 19), limit=4)) == [4, 6, 7, 8]
    assert ids(L.Listing(filters={"kind": "a"}, limit=2)) == [2, 4]
    assert L.size(df, {"kind": None}) == 16 and L.size(df, {"is_deleted": False}) == 16
    with pytest.raises(ValueError, match="after the end"):
        L.date_range(df, "created_at", datetime(2024, 1, 2), datetime(2024, 1, 1))
    t = datetime(2024, 1, 1, 1)
    assert L.date_range(df, "created_at", t, t, inclusive=True).count() == 2 and L.date_range(df, "created_at", t, t).count() == 0


def test_keys_order_and_usage(spark):
    df = rows(spark)
    keys = spark.createDataFrame([(1, "b"), (99, "a")], "id int, kind string")
    assert L.by_keys(df, keys, ["id", "kind"]).count() == 1
    with pytest.raises(KeyError):
        L.by_keys(df, keys, ["id", "kind"], strict=True)
    assert [r.id for r in L.in_order(df, spark.createDataFrame([([7, 3, 9],)], "ids array<int>")).collect()] == [7, 3, 9]
    none = spark.createDataFrame([], "job string, prompt_tokens long, completion_tokens long, total_tokens long")
    assert tuple(L.usage(none, job="x").first()) == (0, 0, 0, 0)
    assert L.last_n(df, ["kind"], "id", 2).count() == 4
    assert predicate({"a": {"gt": 1}}) is not None


def test_memories(spark):
    with pytest.raises(ValueError, match="user_id"):
        M.scoped(rows(spark), other="x")
    facts = spark.createDataFrame([("likes tea", "u"), ("likes tea", "u"), ("likes tea", "v")], "memory string, user_id string")
    assert M.add_events(facts).count() == 2
    f = spark.createDataFrame([(1,), (2,), (3,)], "fact_id int")
    s = spark.createDataFrame([(1, "a", 0.99), (1, "b", 0.8), (2, "b", 0.8), (3, "c", 0.1)], "fact_id int, memory_id string, similarity double")
    assert {r.fact_id: (r.event, r.memory_id) for r in M.decide(f, s).collect()} == {1: ("NONE", "a"), 2: ("UPDATE", "b"), 3: ("ADD", None)}
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "a", "ADD", "x", t), (2, "a", "UPDATE", "y", t + timedelta(1)), (3, "b", "ADD", "z", t), (4, "b", "DELETE", "z", t)], "seq long, memory_id string, event string, memory string, at timestamp")
    r = M.current(log).collect()
    assert [(x.memory_id, x.memory, x.created_at, x.updated_at) for x in r] == [("a", "y", t, t + timedelta(1))]
    h = {x.seq: (x.old_memory, x.new_memory, x.is_deleted) for x in M.memory_history(log).collect()}
    assert h == {1: (None, "x", False), 2: ("x", "y", False), 3: (None, "z", False), 4: ("z", None, True)}
    old = spark.createDataFrame([("1", "a", "p", "n", "UPDATE", t, 0)], "id string, memory_id string, prev_value string, new_value string, event string, timestamp timestamp, is_deleted int")
    assert M.migrated_history(old).first().old_memory == "p"


def test_block_stack(spark):
    ops = [("checkpoint", "a"), ("checkpoint", "b"), ("checkpoint", "c"), ("undo", None), ("undo", None), ("redo", None), ("checkpoint", "d"), ("redo", None)]
    df = spark.createDataFrame([("x", i, o, v) for i, (o, v) in enumerate(ops)] + [("y", 0, "undo", None)], "block_id string, seq int, op string, value string")
    got = {r.block_id: (r.position, r.depth, r.value) for r in M.block_states(df).collect()}
    assert got == {"x": (3, 3, "d"), "y": (0, 0, None)}


def test_summaries_replace_what_they_cover(spark):
    m = spark.createDataFrame([("c", i, r, f"t{i}", 10) for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv string, i_ int, role string, text string, tok int")
    cut = M.summarizer_cutoff(m, "conv", "i_", "tok", 0.4)
    assert cut.first().cutoff == 3
    s = spark.createDataFrame([("c", "short")], "conv string, summary string")
    assert [(r.role, r.text) for r in M.summarized(m, cut, s, "conv", "i_").orderBy("i_").collect()] == [("system", "t0"), ("summary", "short"), ("user", "t3"), ("assistant", "t4")]


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    a = T.hashed(spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), "text", "c-")
    assert T.insert_missing(spark, p, a) == 2 and T.insert_missing(spark, p, a) == 0
    keys = [r.hash_id for r in a.orderBy("text").collect()][::-1]
    assert [r.text for r in T.lookup(spark.read.parquet(p), keys).collect()] == ["b", "a"]
    qa = spark.createDataFrame([(1, ["q1", "q2", "q3"], ["a1", "a2"]), (2, ["q"], ["a1", "a2"])], "context_id int, questions array<string>, answers array<string>")
    got = [(r.context_id, r.question, r.answers) for r in T.question_pairs(qa).orderBy("context_id", "pos").collect()]
    assert got == [(1, "q1", ["a1"]), (1, "q2", ["a2"]), (2, "q", ["a1", "a2"])]
    r = spark.createDataFrame([("x", None, ""), ("y", "v", "w")], "a string, b string, c string").select(T.as_list(F.col("b")), T.as_list(F.col("c"))).collect()
    assert [list(x) for x in r] == [[[], []], [["v"], ["w"]]]
    T.save_results(a, str(tmp_path / "r"), "one")
    T.save_results(a, str(tmp_path / "r"), "two")
    T.save_results(a, str(tmp_path / "r"), "one")  # a retry takes the place of the first try
    assert T.load_results(spark, str(tmp_path / "r"), "one").count() == T.load_results(spark, str(tmp_path / "r"), "two").count() == 2
    assert [x.text for x in T.instances(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id int, text string").repartition(5), positions=[0, 7, 49, 60]).orderBy("id").collect()] == ["t0", "t7", "t49"]
    assert T.remaining(a, a.limit(1), ["hash_id"]).count() == 1
    assert [x.text for x in T.sample(a, 1, F.col("text")).collect()] == [x.text for x in T.sample(a.repartition(3), 1, F.col("text")).collect()]
    s = spark.createDataFrame([(1, ("x",)), (2, ("y",)), (3, ("x",))], "row_idx int, metadata struct<source:string>")
    assert [x.row_idx for x in T.source_split(s, "x", 1).collect()] == [1]
    assert T.reflect({"a": a}, {"a": "hash_id"})["a"]["primary_key"] == "hash_id"
    a.createOrReplaceTempView("some_rows")
    assert T.filtered_table(spark, "some_rows", {"text": ["a"]}).count() == 1
    with pytest.raises(ValueError, match="not a table name"):
        T.filtered_table(spark, "x; drop")


def test_files(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("same")
    (tmp_path / "d" / "sub" / "b.md").write_text("same")
    (tmp_path / "d" / "c.png").write_bytes(b"x")
    f = files.folder(spark, str(tmp_path / "d"))
    assert f.count() == 3 and files.folder(spark, str(tmp_path / "d"), ["txt", ".md"]).count() == 2
    assert {r.name: r.kind for r in files.classified(f).collect()} == {"a.txt": "text", "b.md": "text", "c.png": "image"}
    assert files.ingested(f, "me").count() == 2
    (tmp_path / "d" / "z.odd").write_text("x")
    with pytest.raises(Exception, match="unknown extension"):
        files.classified(files.folder(spark, str(tmp_path / "d"))).collect()
    (tmp_path / "qa.json").write_text('[{"question": "q1", "answer": ["a"]}, {"question": "q2", "answer": ["b"]}]')
    assert files.qa_with_context(spark, str(tmp_path / "qa.json"), str(tmp_path / "d" / "a.txt")).where("context = 'same'").count() == 2
    (tmp_path / "x.csv").write_text('a,b\n"1,2",3\n')
    assert tuple(files.csv_rows(spark, str(tmp_path / "x.csv")).first()) == ("1,2", "3")
    (tmp_path / "o.owl").write_text(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
        '<owl:Class rdf:about="http://x#Car"><rdfs:subClassOf rdf:resource="http://x#Vehicle"/></owl:Class><owl:NamedIndividual rdf:about="http://x#Beetle"><rdf:type rdf:resource="http://x#Car"/></owl:NamedIndividual></rdf:RDF>'
    )
    n, e = files.rdf_ontology(spark, str(tmp_path / "o.owl"))
    assert n.count() == 2 and {(r.src, r.rel, r.dst) for r in e.collect()} == {("car", "is_a", "vehicle"), ("beetle", "is_a", "car")}
    nested = spark.createDataFrame([("a", [("b", [("c",)])])], "name string, children array<struct<name:string,children:array<struct<name:string>>>>")
    assert {tuple(r) for r in files.nested_ontology(nested, 5).collect()} == {("a", "b"), ("b", "c")}


def test_multihop(spark):
    a = spark.createDataFrame([("1", "q", "x", [("T", ["s0", "s1"])], [("T", 1)])], "id string, question string, answer string, context array<struct<title:string,sentences:array<string>>>, supporting array<struct<title:string,sent:int>>")
    docs, qa = files.multihop(a, "titled")
    assert docs.first().text == "T\ns0s1" and qa.first().golden == "T: s1"
    b = spark.createDataFrame([("1", "q", "x", [("T", "body")], [("sub", "y", 0)])], "id string, question string, answer string, paragraphs array<struct<title:string,paragraph_text:string>>, question_decomposition array<struct<question:string,answer:string,paragraph_support_idx:int>>")
    docs, qa = files.multihop(b, "paragraphs")
    assert docs.count() == 1 and qa.first().golden == "T: body"


def test_range_operators_take_a_dollar_sign(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "n int")
    for f in ({"gte": 3, "lt": 5}, {"$gte": 3, "$lt": 5}):
        assert sorted(r.n for r in df.where(predicate({"n": f})).collect()) == [3, 4]
    assert df.where(predicate({"n": {"$ne": 3}, "other": None})).count() == 9


def test_numbers_follow_the_order(spark):
    import random

    ids = random.Random(1).sample(range(10**6), 500)
    got = {r.n: r.pos for r in T.numbered(spark.createDataFrame([(i,) for i in ids], "n long").repartition(7), "n", "pos").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_only_the_owners_memories_are_similar(spark):
    v = lambda *x: list(map(float, x))
    memories = spark.createDataFrame([("a", "u", v(1, 0)), ("a", "u", v(0.9, 0.1)), ("b", "u", v(0, 1)), ("c", "w", v(1, 0)), ("z", "u", v(0, 0))], "memory_id string, user_id string, vector array<double>")
    facts = spark.createDataFrame([(1, "u", v(1, 0), True), (2, "u", v(1, 0), False), (3, "x", v(1, 0), True)], "fact_id int, user_id string, vector array<double>, negates boolean")
    near = M.similar_memories(facts, memories, 5)
    assert sorted((r.fact_id, r.memory_id) for r in near.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    got = {r.fact_id: (r.event, r.memory_id) for r in M.decide(facts, near, negates=F.col("negates")).collect()}
    assert got == {1: ("DELETE", "a"), 2: ("NONE", "a"), 3: ("ADD", None)}


def test_cutoff_takes_its_share_in_decimals(spark):
    """Seven tenths of 90 tokens are 63, which the third message does not reach with 62."""
    rows = [("c", 0, "system", 5), ("c", 1, "user", 30), ("c", 2, "assistant", 32), ("c", 3, "assistant", 1), ("c", 4, "user", 11), ("c", 5, "user", 11)]
    m = spark.createDataFrame(rows, "conv string, i_ int, role string, tok int")
    assert M.summarizer_cutoff(m, "conv", "i_", "tok", 0.7).first().cutoff == 4

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.operators import bm25, cluster_tree, evaluation as ev, retrieval as R
from memlake.plans import pipelines as P
from memlake.providers import HashEmbedder, PatternExtractor, cached_calls, request_key, title
from memlake.streaming import incremental as S


def outputs(spark):
    rows = [("1", "I think.\nAnswer: Paris", ["Paris", "Rome"], "other"), ("2", "Answer: B. Blue", ["x", "blue"], "infbench_choice_eng"), ("3", "one two", ["one", "three"], "ruler_niah_a"), ("4", "Alpha then beta", ["alpha", "BETA"], "eventqa_full"), ("5", "label: 7", ["label: 7"], "icl_x"), ("6", None, ["z"], "other")]
    return spark.createDataFrame(rows, "query_id string, output string, answers array<string>, sub_dataset string")


def test_scoring_router(spark):
    got = {(r.query_id, r.metric): r.value for r in ev.scored(outputs(spark)).collect()}
    assert got["1", "exact_match"] == 1 and got["1", "f1"] == 1 and got["1", "substring_exact_match"] == 1
    assert got["2", "exact_match"] == 1 and got["2", "substring_exact_match"] == 1
    assert got["3", "ruler_recall"] == 0.5 and ("3", "f1") not in got
    assert got["4", "eventqa_recall"] == 1 and got["5", "exact_match"] == 1
    assert not any(q == "6" for q, _ in got)
    means = {r.metric: r.value for r in ev.metric_means(ev.scored(outputs(spark))).collect()}
    assert means["ruler_recall"] == 50
    long = spark.createDataFrame([("input_len", 3.0), ("query_time_len", 2.0), ("f1", 0.5)], "metric string, value double")
    assert {r.metric: r.value for r in ev.metric_means(long).collect()} == {"input_len": 3.0, "query_time_len": 2.0, "f1": 50.0}


def test_recall_and_accuracy(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "query_id int, rank int, doc_id long")
    gold = spark.createDataFrame([(1, 11), (1, 13), (2, 12), (3, 1)], "query_id int, doc_id long")
    assert {r.k: r.recall for r in ev.recall_at(ranked, gold, [1, 2]).collect()} == {1: 0.3333, 2: 0.5}
    acc = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "kind string, ok int")
    assert {r.kind: (r.accuracy, r.n) for r in ev.accuracy_by_type(acc, "ok", "kind").collect()} == {"a": (0.5, 2), "b": (1.0, 1), "all": (0.6667, 3)}


def test_summaries_titles_and_references(spark):
    s = spark.createDataFrame([(2, 4, 1, 2, 1.0), (0, 0, 0, 0, 1.0)], "found int, total int, supported int, sentences int, fluency double")
    assert [(r.recall, r.precision, r.judged_f1) for r in ev.summary_scores(s).collect()] == [(0.5, 0.5, 0.5), (0, 0, 0)]
    t = spark.createDataFrame([("Heat",), ("Heap",), ("Alien",)], "title string")
    n = spark.createDataFrame([("hea",), ("alein",)], "name string")
    assert {r.name: (r.nearest, r.distance) for r in ev.nearest_titles(n, t).collect()} == {"hea": ("Heap", 1), "alein": ("Alien", 2)}
    o = spark.createDataFrame([(1, "1. Heat (1995)\n2. Alein", ["Alien", "Heat"])], "query_id int, output string, titles array<string>")
    assert tuple(ev.recommendation_recall(o, t).first())[1:] == (0.5, 1.0, 1.0)
    r = spark.createDataFrame([(["1"], ["q"], ["a"]), (["1", "2"], ["q"], ["a"])], "question_ids array<string>, questions array<string>, answers array<string>")
    assert ev.unpack_references(r).count() == 1
    assert ev.needs_judging(spark.createDataFrame([("a",), ("b",)], "qa_pair_id string"), spark.createDataFrame([("a",)], "qa_pair_id string")).count() == 1
    assert spark.range(1).select(ev.judged_yes(F.lit("Yes, so it is"))).first()[0]


def test_bootstrap_and_rouge(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4, 5)], "score double")
    r = ev.bootstrap_interval(df, samples=2000).first()
    assert r.mean == 3 and 1 < r.low < 3 < r.high < 5
    assert tuple(ev.bootstrap_interval(df, samples=50).first()) == tuple(ev.bootstrap_interval(df, samples=50).first())
    assert tuple(ev.bootstrap_interval(df.select(F.lit(3.0).alias("score")), samples=50).first()) == (3, 3, 3)
    g = spark.createDataFrame([("the cat sat", ["the cat", "sat the"])], "output string, answers array<string>")
    out = ev.rouge_best(g).first()
    assert out.rougeL_f1 == pytest.approx(0.8) and out.rougeL_recall == 1.0


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a"), (4, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "A C"), (2, "zzz")], "query_id int, query string")
    got = bm25.bm25_topk(d, q, 10).orderBy("rank").collect()
    assert [r.doc_id for r in got][0] == 2 and {r.query_id for r in got} == {1} and len(got) == 3


def test_fusion_falls_back_to_dense(spark):
    nodes = spark.createDataFrame([("p1",), ("p2",), ("x",), ("y",)], "id string")
    edges = spark.createDataFrame([("x", "y", 1.0), ("p1", "x", 1.0), ("p2", "y", 1.0)], "src string, dst string, weight double")
    facts = spark.createDataFrame([("f", "x", "x")], "fact_id string, s string, o string")
    hits = spark.createDataFrame([("f", 1.0)], "fact_id string, score double")
    mentions = spark.createDataFrame([("x", "p1"), ("y", "p2")], "phrase string, chunk_id string")
    dense = spark.createDataFrame([("p1", 0.1), ("p2", 0.9)], "id string, score double")
    assert [r.passage_id for r in R.fused(facts, hits, mentions, dense, nodes, edges, 2).orderBy("rank").collect()] == ["p1", "p2"]
    assert [r.passage_id for r in R.fused(facts, hits.limit(0), mentions, dense, nodes, edges, 2).orderBy("rank").collect()] == ["p2", "p1"]


def test_search_helpers(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "s")], "src string, dst string, rel string")
    near = spark.createDataFrame([("a", 0.1), ("c", 0.7)], "id string, distance double")
    assert R.insights(nodes.limit(0), near, near.limit(0), nodes, edges, 5).count() == 1
    assert R.insights(nodes.where("id = 'b'"), near, near, nodes, edges, 5).count() == 2
    q = spark.createDataFrame([(1, "who met Ada Lovelace"), (2, "who")], "query_id int, query string")
    assert {r.query for r in R.entity_queries(q).collect()} == {"Ada Lovelace who met Ada Lovelace", "who"}
    h = spark.createDataFrame([(1, 1, "x", False, 5), (1, 2, "y", True, 1), (1, 3, "z", True, 3)], "query_id int, rank int, id string, sup boolean, use int")
    assert R.gated(h, F.lit(True), F.col("sup"), F.col("use")).first().id == "z"
    t = datetime(2024, 1, 1)
    f = spark.createDataFrame([(1, t, None), (2, t, t + timedelta(1)), (3, t + timedelta(9), None)], "id int, valid_at timestamp, invalid_at timestamp")
    assert [r.id for r in R.temporal(f, t + timedelta(2)).collect()] == [1]
    owned = spark.createDataFrame([("d1",)], "document_id string")
    docs = spark.createDataFrame([("d1",), ("d2",), (None,)], "document_id string")
    assert R.allowed(docs, owned).count() == 2
    u = spark.createDataFrame([(1, 5), (1, 2), (1, 5)], "question_id int, id int")
    assert [r.id for r in R.union_of_queries(u).collect()] == [2, 5]
    assert R.short_lines_dropped(spark.createDataFrame([("a b c",), ("a b c d",)], "t string"), "t").count() == 1
    c = spark.createDataFrame([(1, 2, "c d"), (1, 1, "a b")], "k int, n int, t string")
    assert R.long_context(c, "k", "n", "t", 3).first().context == "b c d"
    reg = R.search_types()
    assert reg.route("simple_rag_bm25_x") == "bm25" and reg.search("cypher", spark, "SELECT 1 AS x").first().x == 1
    with pytest.raises(ValueError, match="unknown"):
        reg.search("nothing")


def test_knowledge_graph_and_qa(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace met Charles Babbage. They wrote to a@b.org.\n"), (2, "Nothing here.")], "doc_id long, text string")
    g = P.knowledge_graph(docs, 8)
    assert {r.name for r in g["nodes"].where("type = 'Entity'").collect()} == {"ada lovelace", "charles babbage", "a@b.org"}
    assert g["totals"].count() == 2
    assert P.embedded(g["index"], HashEmbedder(8)).where(F.size("vector") == 8).count() == g["index"].count()
    q = spark.createDataFrame([("1", "who met Babbage")], "query_id string, query string")
    out = P.retrieve_and_answer(docs, q, P.first_sentence_answer)
    golds = spark.createDataFrame([("1", ["Ada Lovelace met Charles Babbage"])], "query_id string, answers array<string>")
    assert {r.metric: r.value for r in P.evaluate(out, golds).collect()}["exact_match"] == 100
    j = spark.createDataFrame([("q", "a", "r", "temporal-x", False), ("q", "a", "r", "x", True)], "question string, answer string, response string, question_type string, abstention boolean")
    assert ["day" in r.prompt for r in P.judge_prompts(j).collect()] == [True, False]
    m = spark.createDataFrame([(1, 2, "H\nb"), (1, 1, "H\na"), (1, 3, "G")], "k int, n int, text string")
    assert sorted(r.text for r in P.merged_first_lines(m, "k", "n").collect()) == ["G\n", "H\na\nb"]
    f = spark.createDataFrame([("file:/r/a/b/x.txt",), ("file:/r/y.txt",)], "path string")
    names = P.dataset_names(f, "/r")
    assert [r.dataset for r in names.orderBy("dataset").collect()] == ["a.b", "main_dataset"] and P.matched_datasets(names, "a").count() == 1
    d, gr = spark.createDataFrame([("d",)], "document_id string"), spark.createDataFrame([("u", "read", "d")], "user_id string, permission string, document_id string")
    assert P.permitted(d, gr, "u", "read").count() == 1
    with pytest.raises(PermissionError):
        P.permitted(d, gr, "u", "write")
    b = spark.createDataFrame([("g", "persona", "x"), ("g", "human", "y")], "agent string, label string, value string")
    assert P.system_prompt(b, "agent", "S {CORE_MEMORY} {other}").first().prompt == "S <human>\ny\n</human>\n<persona>\nx\n</persona> {other}"
    assert P.template("judge_temporal-reasoning") == P.TEMPLATES["judge_temporal"]


def test_providers(spark):
    e = PatternExtractor(("EMAIL",)).extract(spark.createDataFrame([(1, "a@b.org a@b.org")], "id int, text string"), "id", "text")
    assert [(r.type, r.name, r.description) for r in e.collect()] == [("EMAIL", "a@b.org", "Email address: a@b.org")] * 2
    req = spark.createDataFrame([("x",), ("x",), ("y",)], "prompt string").withColumn("key", request_key(F.col("prompt")))
    cache = req.where("prompt = 'y'").select("key", F.lit("old").alias("response"))
    answers, new = cached_calls(req, cache, lambda r: r.withColumn("response", F.concat(F.lit("re:"), "prompt")))
    assert sorted(r.response for r in answers.collect()) == ["old", "re:x", "re:x"] and new.count() == 1
    assert spark.range(1).select(title(F.lit("a b c d e f g h"), F.lit("x, y"))).first()[0] == "a b c d e f g... [x, y]"


def test_tree_levels(spark):
    leaves = spark.createDataFrame([(str(i), f"text {i}", [float(i % 3) * 5 + i * 0.01, float(i)]) for i in range(40)], "id string, text string, vector array<double>")
    tree = cluster_tree.build_tree(leaves, levels=2, components=2)
    assert {r.level: r.n for r in tree.groupBy("level").agg(F.count("*").alias("n")).collect()}[0] == 40
    top = tree.where("level = 1")
    assert top.select(F.sum(F.size("children"))).first()[0] == 40


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "text string").coalesce(1).write.mode("append").parquet(src)
    write([("a",), ("b",), ("a",)])
    go = lambda: S.memorize(S.table_stream(spark, src, "text string"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    go()
    write([("b",), ("c",)])
    go()
    go()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="another checkpoint"):
        S.memorize(S.table_stream(spark, src, "text string"), str(tmp_path / "out"), str(tmp_path / "mark2"))
    ev_src = str(tmp_path / "ev")
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, "a", 1.0), (1, t, "a", 1.0), (2, t + timedelta(minutes=90), "a", 2.0)], "id int, ts timestamp, event_type string, value double").write.parquet(ev_src)
    stream = spark.readStream.schema("id int, ts timestamp, event_type string, value double").parquet(ev_src)
    assert {r.start: r.n for r in S.run_to_memory(S.windows(stream, "1 hour"), "w1").collect()} == {t: 2, t + timedelta(hours=1): 1}
    S.run_to_table(S.distinct_events(stream, ["id"]), str(tmp_path / "d"), str(tmp_path / "dm")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    b = S.bounded_buffer(stream.select(F.lit("k").alias("k"), "ts", F.col("id").cast("string").alias("text")), "k", "ts", "text", 2)
    S.run_to_table(b, str(tmp_path / "b"), str(tmp_path / "bm")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [("k", "1", 2)]
    assert [list(x) for x in spark.range(1).select(S.batched(F.array(*map(F.lit, range(5))), 2)).first()[0]] == [[0, 1], [2, 3], [4]]
    assert S.task_chain(spark.range(4), lambda d: d.where("id > 1"), lambda d: d.limit(1)).count() == 1


def test_rouge_lsum_is_rouge_l_on_one_line_and_unites_lines(spark):
    from memlake.functions.arrow import lcs_length, lcs_places, rouge_l, rouge_lsum, summary_hits

    df = spark.createDataFrame([("the cat sat on a mat", "a cat sat there"), ("", "x"), (None, None), ("a b", "a b")], "p string, g string")
    for r in df.select(rouge_l("p", "g").alias("a"), rouge_lsum("p", "g").alias("b")).collect():
        assert tuple(r.a) == pytest.approx(tuple(r.b))
    # The gold's line is covered by two lines together; a word counts as often as both texts have it.
    assert summary_hits("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5") == (4, 10, 5)
    assert summary_hits("x\nx", "x x x") == (1, 2, 3)
    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in "ab")
        places = sorted(lcs_places(a, b))
        assert len(places) == lcs_length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in places)


def test_chunks_by_bpe_tokens(spark):
    from memlake.functions.arrow import BpeSize
    from memlake.operators.chunking import packed_chunks
    from memlake.plans.text_queries import BPE_PATTERN, BPE_RANKS

    with open(BPE_RANKS, "rb") as f:
        size = BpeSize(f.read(), BPE_PATTERN)
    assert size("") == 0 and size("Hello world") == 2
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    parts = [r.text for r in packed_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), 30, size=size).orderBy("pos").collect()]
    whole = [s for s in parts if s]
    assert " ".join(whole) == text and all(sum(size(s) for s in p.replace(". ", ".|").split("|")) <= 30 for p in whole)


def test_languages(spark):
    from memlake.providers import language

    df = spark.createDataFrame([("The cat and the dog",), ("Le chat et la souris",), ("der Hund und die Katze",), ("el perro y los gatos",), ("xyz",), ("the la",)], "t string")
    assert [r.l for r in df.select(language(F.col("t")).alias("l")).collect()] == ["en", "fr", "de", "es", "unknown", "en"]


def test_broken_json_is_closed_in_one_pass():
    import json

    from memlake.functions.arrow import close_json

    whole = '{"a": ["x, y", {"b": 1}], "c": "d\\"e"}'
    for n in range(1, len(whole) + 1):
        got = close_json(whole[:n])
        assert got is None or json.loads(got) is not None
    assert close_json(whole) == whole and json.loads(close_json(whole[:20])) == {"a": ["x, y"]}
    assert close_json(None) is None and close_json("no") is None
    assert close_json('["' + "a" * 200_000) is not None


def test_nearest_titles_match_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcAB ") for _ in range(rng.randrange(0, 12)))
    titles, names = {word() for _ in range(80)}, {word() for _ in range(60)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {n: min((distance(n.lower(), t.lower()), t) for t in titles) for n in names}
    got = ev.nearest_titles(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([(t,) for t in titles] + [(None,)], "title string"))
    assert {r.name: (r.distance, r.nearest) for r in got.collect()} == want


def test_pooling(spark):
    from memlake.functions.vectors import pooled

    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<double>>, m array<int>")
    r = df.select(pooled(F.col("t"), F.col("m")), pooled(F.col("t"), F.col("m"), "cls")).collect()
    assert [list(x) for x in r] == [[[2.0, 3.0], [1.0, 2.0]], [None, [1.0, 2.0]]]


def test_embedders_by_name(spark):
    from memlake.providers import EMBEDDERS, embedder

    assert embedder("hash", 8).dims == 8 and "hash" in EMBEDDERS
    with pytest.raises(ValueError):
        embedder("none")


def test_polling_finds_new_files(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    q = S.polled(S.table_stream(spark, str(tmp_path / "in"), "id long"), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "c"), "100 milliseconds")
    try:
        q.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(seen) == [0, 1, 2, 3, 4]

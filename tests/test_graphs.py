import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import graph as G, graph_memory as GM, retrieval as R


def graph(spark, n, links):
    return spark.createDataFrame([(str(i),) for i in range(n)], "id string"), spark.createDataFrame([(str(a), str(b), "r") for a, b in links], "src string, dst string, rel string")


CONNECTED = (5, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (2, 2)])
APART = (9, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 6), (6, 7), (7, 8)])


def test_metrics_of_a_connected_graph(spark):
    r = G.graph_metrics(*graph(spark, *CONNECTED), optional=True).first()
    assert (r.num_nodes, r.num_edges, r.mean_degree, r.edge_density) == (5, 6, 2.4, 0.3)
    assert (r.num_components, r.component_sizes, r.num_self_loops, r.diameter) == (1, [5], 1, 2)
    assert r.clustering == 0 and r.mean_path == 1.5


def test_metrics_of_a_graph_in_parts(spark):
    n, e = graph(spark, *APART)
    r = G.graph_metrics(n, e).first()
    assert (r.num_nodes, r.num_edges, r.num_components, r.component_sizes) == (9, 8, 2, [5, 4])
    assert r.mean_degree == pytest.approx(16 / 9) and r.edge_density == pytest.approx(8 / 72)
    assert (r.num_self_loops, r.diameter, r.mean_path, r.clustering) == (-1, -1, -1, -1)
    assert sorted(x.id for x in G.disconnected(n, e).collect()) == ["5", "6", "7", "8"]


def test_clustering_and_hops(spark):
    n, e = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert {r.id: r.coefficient for r in G.clustering(n, e).collect()} == {"0": 1.0, "1": 1.0, "2": pytest.approx(1 / 3), "3": 0.0, "4": 0.0}
    d = {(r.src, r.dst): r.dist for r in G.hops(n, e).collect()}
    assert d["0", "3"] == 2 and d["3", "1"] == 2 and ("0", "4") not in d


def test_nodes_and_edges_come_and_go(spark):
    n, e = graph(spark, 3, [(0, 1), (1, 2)])
    assert G.added_nodes(n, spark.createDataFrame([("2",), ("3",), ("3",)], "id string")).count() == 4
    new = spark.createDataFrame([("0", "1", "r"), ("0", "1", "s"), ("0", "1", "s")], "src string, dst string, rel string")
    assert G.added_edges(e, new).count() == 3
    assert G.existing_edges(e, new).count() == 1
    left = G.without_nodes(n, e, n.where("id = '1'"))
    assert left[0].count() == 2 and left[1].count() == 0
    assert G.without_relation(e, n.where("id = '1'"), "r").count() == 1
    assert G.valid_edges(e.union(spark.createDataFrame([("0", "9", "r"), ("1", "1", "r")])), n).count() == 2


def pagerank(n, w, seeds, damping, rounds):
    a = np.zeros((n, n))
    for (i, j), x in w.items():
        if i != j:
            a[i, j] += x
            a[j, i] += x
    out = a.sum(axis=1)
    s = np.array(seeds, float) / sum(seeds)
    r = s.copy()
    for _ in range(rounds):
        moved = (a / np.where(out > 0, out, 1)[:, None]).T @ r + r[out == 0].sum() * s
        r = damping * moved + (1 - damping) * s
    return r


@pytest.mark.parametrize("links", [{(0, 1): 1.0, (1, 2): 2.0, (2, 3): 0.5, (3, 0): 1.0}, {(0, 1): 1.0, (1, 2): 3.0, (2, 2): 5.0}])
def test_pagerank_matches_power_iteration(spark, links):
    n, _ = graph(spark, 5, [])
    e = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in links.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("0", 1.0), ("2", 3.0), ("4", 0.5), ("1", -1.0)], "id string, weight double")
    got = {r.id: r.rank for r in G.personalized_pagerank(n, e, seeds, 0.5, 12).collect()}
    want = pagerank(5, links, [1, 0, 3, 0, 0.5], 0.5, 12)
    assert [got[str(i)] for i in range(5)] == pytest.approx(want.tolist())
    assert sum(got.values()) == pytest.approx(1)


def test_triplets_best_first(spark):
    e = spark.createDataFrame([(1, "a", "r", "b"), (2, "b", "r", "c"), (3, "a", "s", "c"), (4, "a", "r", "x")], "edge_id int, src string, rel string, dst string")
    nd = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "id string, distance double")
    ed = spark.createDataFrame([("r", 0.1), ("s", 0.0)], "rel string, distance double")
    assert [(r.edge_id, round(r.total, 6)) for r in G.triplet_topk(e, nd, ed, 3).collect()] == [(1, 0.4), (3, 0.4), (2, 0.6)]
    assert [r.edge_id for r in G.triplet_topk(e, nd, ed, 9).collect()][-1] == 4


def test_best_first_goes_through_new_concepts(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 1.0), ("a", "c", 0.2), ("c", "d", 1.0)], "src string, dst string, weight double")
    c = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", ["z"]), ("d", ["z"])], "id string, concepts array<string>")
    seeds = spark.createDataFrame([("a", 0.0)], "id string, cost double")
    assert {r.id: r.cost for r in G.best_first(e, seeds, c).collect()} == {"a": 0.0, "b": 2.0, "c": 3.0}


def test_document_subgraph_and_delete(spark):
    nodes = spark.createDataFrame([("d1", "Document"), ("d2", "Document"), ("c1", "DocumentChunk"), ("c2", "DocumentChunk"), ("e1", "Entity"), ("e2", "Entity"), ("t1", "EntityType"), ("t2", "EntityType"), ("s1", "TextSummary")], "id string, type string")
    edges = spark.createDataFrame([("c1", "d1", "is_part_of"), ("c2", "d2", "is_part_of"), ("c1", "e1", "contains"), ("c1", "e2", "contains"), ("c2", "e2", "contains"), ("e1", "t1", "is_a"), ("e2", "t2", "is_a"), ("s1", "c1", "made_from")], "src string, dst string, rel string")
    sub = {r.id: r.category for r in G.document_subgraph(nodes, edges, "d1").collect()}
    assert sub == {"d1": "document", "c1": "chunk", "e1": "orphan_entity", "t1": "orphan_type", "s1": "summary"}
    n, e, counts = G.delete_document(nodes, edges, "d1")
    assert {r.id for r in n.collect()} == {"d2", "c2", "e2", "t2"} and e.count() == 3 and counts.count() == 5
    n, _, _ = G.delete_document(nodes, edges, "d1", hard=True)
    assert {r.id for r in n.collect()} == {"d2", "c2", "e2"}


def test_integrate_normalises_and_dedups(spark):
    x = spark.createDataFrame([("c1", [("Ada L", "Person")], [("Ada L", "Babbage", "Knows Of")]), ("c2", [("ada l", "person")], [])], "chunk_id string, nodes array<struct<name:string,type:string>>, edges array<struct<source:string,target:string,rel:string>>")
    n, e = G.integrate(x)
    assert n.count() == 2 and {r.rel for r in e.collect()} == {"knows_of", "is_a", "contains"}


def test_similarity_weights_and_layers(spark):
    p = spark.createDataFrame([("a", "b", 0.9, ["x", "y"], ["y"])], "a string, b string, sim double, concepts_a array<string>, concepts_b array<string>")
    assert G.similarity_graph(p).first().weight == pytest.approx(0.7 * 0.9 + 0.3)
    fact = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    syn = spark.createDataFrame([("a", "b", 0.8)], "src string, dst string, weight double")
    assert {(r.src, r.dst): r.weight for r in G.merged_edges(fact, syn).collect()} == {("a", "b"): 0.8, ("b", "c"): 2.0}


def test_model_graph_counts(spark, tmp_path):
    rows = spark.createDataFrame([("c1", ("d1", "p"), [("e1", "x"), ("e2", "y")]), ("c2", ("d1", "p"), [("e1", "x")])], "id string, part_of struct<id:string,path:string>, contains array<struct<id:string,name:string>>")
    n, e = GM.model_graph(rows, "Chunk", "id", {"part_of": ("id", "Document"), "contains": ("id", "Entity")})
    assert n.count() == 5 and e.count() == 5
    GM.write_graph(n, e, str(tmp_path / "g"))
    assert [x.count() for x in GM.read_graph(spark, str(tmp_path / "g"))] == [5, 5]


def test_relations_are_merged_into_a_users_graph(spark):
    nodes = spark.createDataFrame([("n1", "u", "ada", [1.0, 0.0]), ("n2", "v", "ada", [1.0, 0.0])], "id string, user_id string, name string, vector array<double>")
    edges = spark.createDataFrame([], "user_id string, src string, rel string, dst string")
    new = spark.createDataFrame([("u", "Ada B", "Knows", "Bob", [0.99, 0.05], [0.0, 1.0])], "user_id string, source string, rel string, destination string, source_vector array<double>, destination_vector array<double>")
    n, e = GM.merge_relations(nodes, edges, new)
    assert n.count() == 3 and e.first().src == "n1"
    n2, e2 = GM.merge_relations(n, e, new)
    assert n2.count() == 3 and e2.count() == 1
    assert [tuple(r) for r in GM.user_relations(n, e, "u").collect()] == [("ada", "knows", "bob")]
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    assert GM.both_directions(n, e, asked).count() == 1
    assert GM.without_user(n, e, "u")[0].count() == 1


def test_code_and_label_graphs(spark):
    files = spark.createDataFrame([("pkg/a.py", bytearray(b"import pkg.b\nfrom pkg import c\n")), ("pkg/b.py", bytearray(b"import os\n")), ("pkg/__init__.py", bytearray(b""))], "path string, content binary")
    assert {(r.src, r.dst) for r in GM.import_graph(files).collect()} == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/__init__.py")}
    c = spark.createDataFrame([("c1", "Text", ["News", "Essay"])], "chunk_id string, label string, subs array<string>")
    n, e = GM.label_graph(c, F.col("label"), F.col("subs"))
    assert n.count() == 3 and e.count() == 4
    hops = spark.createDataFrame([("s", "c", "summarizes"), ("c", "f", "defines")], "src string, dst string, rel string")
    assert [tuple(r) for r in GM.two_hop(hops, spark.createDataFrame([("s",)], "id string"), ["summarizes"], ["defines"]).collect()] == [("s", "f")]


def test_relations_meet_the_users_own_most_similar_node(spark):
    """Sixty other users' nodes are nearer than the user's own two, of which one is taken."""
    others = [(f"o{i:02}", f"x{i}", "ada", [1.0, 0.0]) for i in range(60)]
    nodes = spark.createDataFrame([*others, ("n1", "u", "ada", [0.99, 0.05]), ("n2", "u", "ada l", [0.97, 0.2])], "id string, user_id string, name string, vector array<double>")
    edges = spark.createDataFrame([], "user_id string, src string, rel string, dst string")
    new = spark.createDataFrame([("u", "Ada", "Knows", "Bob", [1.0, 0.0], [0.0, 1.0])], "user_id string, source string, rel string, destination string, source_vector array<double>, destination_vector array<double>")
    n, e = GM.merge_relations(nodes, edges, new)
    assert n.count() == 63 and [r.src for r in e.collect()] == ["n1"]


def test_walks_have_no_hop_limit(spark):
    """A chain of 14 cheap edges beats one dear edge, and goes on beyond it."""
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 10.0) for i in range(14)] + [("n0", "n13", 0.2)], "src string, dst string, weight double")
    c = spark.createDataFrame([(f"n{i}", [f"c{i}"]) for i in range(15)], "id string, concepts array<string>")
    seeds = spark.createDataFrame([("n0", 0.0)], "id string, cost double")
    got = {r.id: r.cost for r in G.best_first(e, seeds, c).collect()}
    assert got == {f"n{i}": pytest.approx(i / 10) for i in range(15)}
    assert G.best_first(e, seeds, c, 2).count() == 6


def test_closure_has_no_depth_limit_and_takes_cycles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(53)] + [(53, 0)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "id int")
    assert {r.id: r.depth for r in G.ontology_closure(links, start).collect()} == {i: i for i in range(54)}
    assert G.ontology_closure(links, start, 2).count() == 3


@pytest.mark.parametrize("links", [{(0, 1): 1.0, (1, 2): 2.0, (2, 3): 0.5, (3, 0): 1.0}, {(0, 1): 1.0, (1, 2): 3.0}])
def test_walks_of_many_queries_match_power_iteration(spark, links):
    """Node 4 has no edges: the mass of a seed there restarts."""
    e = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in links.items()], "src string, dst string, weight double")
    weights = {"x": [1, 0, 3, 0, 0.5], "y": [0, 0, 1, 0, 0], "z": [0, 0, 0, 0, 2]}
    seeds = spark.createDataFrame([(q, str(i), w / 2) for q, ws in weights.items() for i, w in enumerate(ws) for _ in range(2)] + [("x", "3", -1.0)], "query_id string, id string, weight double")
    got = {(r.query_id, r.id): r.rank for r in G.pagerank_of_queries(e, seeds, 0.5, 12).collect()}
    for q, ws in weights.items():
        want = pagerank(5, links, ws, 0.5, 12)
        assert [got.get((q, str(i)), 0.0) for i in range(5)] == pytest.approx(want.tolist())


def test_all_questions_are_fused_as_one_is(spark):
    facts = spark.createDataFrame([(1, "a", "r", "b"), (2, "b", "r", "c"), (3, "d", "r", "a")], "fact_id int, s string, p string, o string")
    mentions = spark.createDataFrame([("P1", "a"), ("P1", "b"), ("P2", "c"), ("P3", "d"), ("P3", "a")], "chunk_id string, phrase string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("d", "a", 1.0), ("P1", "a", 1.0), ("P1", "b", 1.0), ("P2", "c", 1.0), ("P3", "d", 1.0), ("P3", "a", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "P1", "P2", "P3")], "id string")
    hits = spark.createDataFrame([("q1", 1, 0.9), ("q1", 2, 0.5), ("q2", 3, 0.7)], "query_id string, fact_id int, score double")
    dense = spark.createDataFrame([(q, p, s + k / 7) for k, q in enumerate(("q1", "q2", "q3")) for p, s in (("P1", 0.3), ("P2", 0.9), ("P3", 0.5))], "query_id string, id string, score double")
    got = R.fused_batch(facts, hits, mentions, dense, edges, 3).collect()
    for q in ("q1", "q2", "q3"):
        one = R.fused(facts, hits.where(F.col("query_id") == q).drop("query_id"), mentions, dense.where(F.col("query_id") == q).drop("query_id"), nodes, edges, 3).collect()
        want = sorted((r.rank, r.passage_id, round(r.score, 5)) for r in one)
        assert sorted((r.rank, r.passage_id, round(r.score, 5)) for r in got if r.query_id == q) == want


def test_hubs_do_not_change_the_coefficient(spark):
    rng = np.random.default_rng(2)
    links = {(0, i) for i in range(1, 60)} | {tuple(sorted(map(int, rng.choice(np.arange(1, 60), 2, replace=False)))) for _ in range(150)}
    n, e = graph(spark, 61, sorted(links) + [(5, 5)])
    near = {i: {a + b - i for a, b in links if i in (a, b)} for i in range(61)}
    want = {str(i): 2 * sum((a, b) in links for a in s for b in s if a < b) / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for i, s in near.items()}
    assert {r.id: pytest.approx(r.coefficient) for r in G.clustering(n, e).collect()} == want


def test_relations_of_all_similar_nodes(spark):
    """More nodes than any cut-off lie above the threshold: all of their relations are found."""
    nodes = spark.createDataFrame([(f"n{i}", [1.0, i / 1000]) for i in range(300)], "id string, vector array<double>")
    edges = spark.createDataFrame([(f"n{i}", "r", "x") for i in range(300)], "src string, rel string, dst string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    assert GM.both_directions(nodes, edges, asked, 0.7).count() == 300
    assert GM.both_directions(nodes, edges, asked, 0.7, 10).count() == 10


@pytest.mark.parametrize("of_group", [1 << 22, 40])
def test_triangles_of_groups(spark, of_group):
    """Every triangle is counted at its three nodes, in however many parts nodes are; no open triangle is a row of a join."""
    rng = np.random.default_rng(2)
    near = np.triu(rng.random((60, 60)) < 0.2, 1)
    near[3, 4:] = True
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(near))], "a long, b long").repartition(3)
    both = (near | near.T).astype(int)
    want = np.diag(both @ both @ both) // 2
    assert {r.n: r.t for r in G.triangles(links, of_group).collect()} == {i: t for i, t in enumerate(want.tolist()) if t}
    nodes = spark.range(62).select(F.col("id").cast("string").alias("id"))
    c = G.clustering(nodes, links.select(F.col("b").cast("string").alias("src"), F.col("a").cast("string").alias("dst")))
    k = both.sum(axis=1)
    assert {int(r.id): round(r.coefficient, 6) for r in c.collect()} == {i: round(2 * want[i] / (k[i] * (k[i] - 1)), 6) if i < 60 and k[i] > 1 else 0.0 for i in range(62)}
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan

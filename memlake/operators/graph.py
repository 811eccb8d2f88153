"""Graphs as node and edge DataFrames.

Nodes have ``id``; edges have ``src``, ``dst`` and, where it matters,
``rel`` and ``weight``.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake.functions.ids import node_id
from memlake.functions.text import node_key
from memlake.operators.vector_store import knn_join
from memlake.scratch import cut, drop


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns]))


# --- building ---------------------------------------------------------------


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ordered dedup: the first row per key stays."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def fact_edges(triples: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: one for each triple ``(s, p, o)``, in both directions."""
    e = triples.select(F.col("s").alias("src"), F.col("o").alias("dst")).where("src <> dst")
    return both_ways(e).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def passage_edges(triples: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: each chunk to the phrases of its triples, once."""
    e = triples.select("chunk_id", F.explode(F.array("s", "o")).alias("dst")).distinct()
    return e.select(F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("src"), "dst", F.lit(1.0).alias("weight"))


def synonym_edges(phrases: DataFrame, k: int, threshold: float = 0.8) -> DataFrame:
    """``(src, dst, weight)``: the most similar phrases ``(id, vector)`` of each that has over two letters or digits."""
    long = phrases.where(F.length(F.regexp_replace("id", "[^A-Za-z0-9]", "")) > 2)
    return knn_join(long, phrases, k, threshold).select("src", "dst", F.col("score").alias("weight"))


def entity_frequency(triples: DataFrame) -> DataFrame:
    """``(entity, chunks)``: in how many chunks an entity occurs; what a chunk has is known before entities are shuffled."""
    e = triples.select("chunk_id", F.explode(F.array("s", "o")).alias("entity"))
    return e.distinct().groupBy("entity").agg(F.count("chunk_id").alias("chunks"))


def merged_edges(*layers: DataFrame) -> DataFrame:
    """Edges of all layers; of one pair, the last layer's weight stands."""
    out = None
    for k, layer in enumerate(layers):
        part = layer.select("src", "dst", "weight", F.lit(k).alias("layer"))
        out = part if out is None else out.union(part)
    return out.groupBy("src", "dst").agg(F.max_by("weight", "layer").alias("weight"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes, without self loops."""
    n = nodes.select("id")
    return edges.where("src <> dst").join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")


def added_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.unionByName(new.dropDuplicates(["id"]).join(nodes, "id", "left_anti"), allowMissingColumns=True)


def added_edges(edges: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "rel")) -> DataFrame:
    """Multigraph upsert: an edge is known by ends and relation."""
    fresh = new.dropDuplicates(list(keys))
    return edges.join(fresh, list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def existing_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(edges, ["src", "dst", "rel"], "left_semi")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left when ``gone`` ids and their edges go."""
    g = gone.select("id")
    e = edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(g, "id", "left_anti"), e


def without_relation(edges: DataFrame, nodes: DataFrame, rel: str, end: str = "dst") -> DataFrame:
    """Drops edges of one relation at the given end of the nodes."""
    gone = edges.where(F.col("rel") == rel).join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges.join(gone, ["src", "dst", "rel"], "left_anti")


def similarity_graph(pairs: DataFrame, concepts_a: str = "concepts_a", concepts_b: str = "concepts_b") -> DataFrame:
    """Weights of similar pairs: 0.7 of the similarity, 0.3 of the shared concepts over the fewer's number."""
    shared = F.size(F.array_intersect(concepts_a, concepts_b))
    least = F.least(F.size(concepts_a), F.size(concepts_b))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim", (0.7 * F.col("sim") + 0.3 * F.when(least > 0, shared / least).otherwise(0.0)).alias("weight"))


def integrate(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted ``(chunk_id, nodes, edges)`` with normalised names and ids; the first of each stays.

    ``nodes`` holds structs ``(name, type)``, ``edges`` structs ``(source, target, rel)``.
    """
    n = extracted.select("chunk_id", F.explode("nodes").alias("n"))
    own = n.select(node_id(F.col("n.name")).alias("id"), F.lower("n.name").alias("name"), F.lit("Entity").alias("type"), "chunk_id")
    kinds = n.select(node_id(F.col("n.type")).alias("id"), F.lower("n.type").alias("name"), F.lit("EntityType").alias("type"), "chunk_id")
    nodes = first_of(own.unionByName(kinds), ["id"], "chunk_id").select("id", "name", "type")
    e = extracted.select("chunk_id", F.explode("edges").alias("e"))
    rel = e.select(node_id(F.col("e.source")).alias("src"), node_id(F.col("e.target")).alias("dst"), node_key(F.col("e.rel")).alias("rel"))
    is_a = n.select(node_id(F.col("n.name")).alias("src"), node_id(F.col("n.type")).alias("dst"), F.lit("is_a").alias("rel"))
    has = n.select(F.col("chunk_id").cast("string").alias("src"), node_id(F.col("n.name")).alias("dst"), F.lit("contains").alias("rel"))
    return nodes, rel.unionByName(is_a).unionByName(has).dropDuplicates()


def relational_graph(tables: dict[str, tuple[DataFrame, str]], foreign: list[tuple[str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """A node per row and table, an edge per row to its table and per foreign key.

    ``tables`` maps a name to its rows and key column; ``foreign`` lists
    ``(table, column, table, column)``.
    """
    nodes = edges = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for name, (df, key) in tables.items():
        own = F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
        kind = df.sparkSession.createDataFrame([(name, "TableType")], "id string, type string")
        nodes = add(add(nodes, df.select(own.alias("id"), F.lit("TableRow").alias("type"))), kind)
        edges = add(edges, df.select(own.alias("src"), F.lit(name).alias("dst"), F.lit("is_part_of").alias("rel")))
    for a, ca, b, cb in foreign:
        left, ka = tables[a]
        right, kb = tables[b]
        x = left.select(F.col(ka).cast("string").alias("ak"), F.col(ca).alias("fk")).where("fk is not null")
        y = right.select(F.col(kb).cast("string").alias("bk"), F.col(cb).alias("fk"))
        edges = add(edges, x.join(y, "fk").select(F.concat(F.lit(f"{a}:"), "ak").alias("src"), F.concat(F.lit(f"{b}:"), "bk").alias("dst"), F.lit(ca).alias("rel")))
    return nodes, edges


def index_fields(rows: DataFrame, fields: dict[str, list[str]], type_col: str = "type") -> DataFrame:
    """``(type, field, id, text)`` of every field that is to be embedded."""
    out = None
    for kind, names in fields.items():
        own = rows.where(F.col(type_col) == kind)
        entries = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("text")) for n in names]))
        part = own.select(F.col(type_col).alias("type"), "id", entries.alias("e")).select("type", "e.field", "id", "e.text").where("text is not null")
        out = part if out is None else out.unionByName(part)
    return out


# --- reading ----------------------------------------------------------------


def connections(edges: DataFrame, nodes: DataFrame, of: DataFrame, rel: str | None = None) -> DataFrame:
    """``(id, direction, rel, other)`` of the asked ids, both directions."""
    e = edges if rel is None else edges.where(F.col("rel") == rel)
    asked = of.select("id")
    out_ = asked.join(e, F.col("id") == F.col("src")).select("id", F.lit("out").alias("direction"), "rel", F.col("dst").alias("other"))
    in_ = asked.join(e, F.col("id") == F.col("dst")).select("id", F.lit("in").alias("direction"), "rel", F.col("src").alias("other"))
    return out_.union(in_).join(nodes.select(F.col("id").alias("other")), "other", "left_semi").select("id", "direction", "rel", "other")


def match_path(edges: DataFrame, steps: list[str], start: DataFrame | None = None) -> DataFrame:
    """``(n0, n1, …)``: the paths of a pattern of relations, from ``start (id)`` where given.

    A step is a relation's name, followed from source to target, or from target
    to source after ``<``; ``*`` is any relation.  A node may occur twice.
    """
    out = None if start is None else start.select(F.col("id").alias("n0"))
    for k, step in enumerate(steps):
        rel, back = step.lstrip("<"), step.startswith("<")
        e = edges if rel == "*" else edges.where(F.col("rel") == rel)
        a, b = ("dst", "src") if back else ("src", "dst")
        hop = e.select(F.col(a).alias(f"n{k}"), F.col(b).alias(f"n{k + 1}")).distinct()
        out = hop if out is None else out.join(hop, f"n{k}")
    return out.select(*[f"n{k}" for k in range(len(steps) + 1)])


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    return both_ways(edges.select("src", "dst")).join(of.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()


def subgraph_where(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and edges with both ends among them."""
    kept = nodes.where(condition)
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree)``: ends at a node; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def degree_one(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    n = nodes if kind is None else nodes.where(F.col("type") == kind)
    return degrees(n, edges).where("degree = 1").select("id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: weak components named by their smallest id.

    Links shrink to stars in alternating steps, each a written table, so the
    rounds grow with the logarithm of the longest path.
    """
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        two = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(two.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        drop(pairs, large)
        if small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            break
        pairs = small
    return nodes.select(F.col("id").alias("node")).join(small.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def disconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes outside the largest component (of equals, the one with the smallest name)."""
    c = cut(components(nodes, edges))
    largest = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(largest, "component", "left_anti").select(F.col("node").alias("id"))


def hops(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``(src, dst, dist)``: shortest path lengths between all nodes, by frontier joins.

    For descriptive metrics of small graphs; the result is as large as its reachable pairs.
    """
    step = cut(both_ways(edges.select("src", "dst")).where("src <> dst").distinct())
    seen = cut(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("dist")))
    front, d = seen, 0
    while limit is None or d < limit:
        d += 1
        near = front.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = cut(near.join(seen, ["src", "dst"], "left_anti").withColumn("dist", F.lit(d)))
        if front.isEmpty():
            break
        before, seen = seen, cut(seen.unionByName(front))
        drop(before)
    return seen


def neighbourhood(nodes: DataFrame, edges: DataFrame, lg_k: int = 12, limit: int | None = None) -> DataFrame:
    """``(dist, pairs)``: about how many ordered pairs of nodes lie within each distance, each node with itself included.

    A node holds one HyperLogLog sketch of what it has reached, of at most
    ``2 ** lg_k`` bytes or so; each round unites it with its neighbours', until
    no estimate grows.  So space is linear in nodes, however many pairs there
    are.  The relative error of a count is about ``0.8 / 2 ** (lg_k / 2)``.
    """
    step = cut(both_ways(edges.select("src", "dst")).where("src <> dst").distinct())
    held = cut(nodes.select("id").distinct().groupBy("id").agg(F.hll_sketch_agg(F.col("id").cast("string"), lg_k).alias("sketch")))
    out, d = [], 0
    while True:
        out.append((d, held.agg(F.coalesce(F.sum(F.hll_sketch_estimate("sketch")), F.lit(0))).first()[0]))
        if d == limit or d and out[-1][1] <= out[-2][1]:
            break
        came = held.join(step, held.id == step.src).select(F.col("dst").alias("id"), "sketch").join(held.select("id"), "id", "left_semi")
        before, held = held, cut(held.unionByName(came).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")))
        drop(before)
        d += 1
    drop(step, held)
    if d and out[-1][1] <= out[-2][1]:
        out.pop()
    return nodes.sparkSession.createDataFrame(out, "dist int, pairs long")


def path_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(dist, pairs)``: how many ordered pairs of nodes lie within each distance, each node with itself included.

    Exact.  Nodes of equal neighbours, known by 128 bits of their hashes, are one
    class: they are two links apart from each other, and equally far from any
    other node.  So pairs of classes are walked (``hops``), and counted by their
    sizes; the leaves of a hub are one class, however many they are.
    """
    ids = cut(nodes.select("id").distinct())
    is_node = lambda c: ids.withColumnRenamed("id", c)
    step = both_ways(edges.select("src", "dst")).where("src <> dst").distinct().join(is_node("src"), "src", "left_semi").join(is_node("dst"), "dst", "left_semi")
    step = cut(step)
    near = [F.bit_xor(F.xxhash64("dst", F.lit(k))).alias(f"x{k}") for k in range(2)]
    alike = step.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("low"), F.max("dst").alias("high"), *near)
    classes = alike.groupBy("n", "low", "high", "x0", "x1").agg(F.min("src").alias("class"), F.count("*").alias("size"))
    classes = cut(classes)
    of = cut(alike.join(classes, ["n", "low", "high", "x0", "x1"]).select(F.col("src").alias("id"), "class"))
    links = step.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    sizes = classes.select("class", F.col("size").cast("long").alias("size"))
    far = hops(sizes.select(F.col("class").alias("id")), links).where("src <> dst").join(sizes.toDF("src", "ns"), "src").join(sizes.toDF("dst", "nd"), "dst")
    own = ids.agg(F.lit(0).alias("dist"), F.count("*").alias("pairs"))
    twins = sizes.where("size > 1").select(F.lit(2).alias("dist"), (F.col("size") * (F.col("size") - 1)).alias("pairs"))
    new = own.unionByName(twins).unionByName(far.select("dist", (F.col("ns") * F.col("nd")).alias("pairs"))).groupBy("dist").agg(F.sum("pairs").alias("pairs"))
    return new.select("dist", F.sum("pairs").over(W.orderBy("dist")).alias("pairs"))  # one row a distance


def path_metrics(nodes: DataFrame, edges: DataFrame, lg_k: int = 12) -> tuple[int, float]:
    """Diameter and mean path length between connected nodes, by ``neighbourhood``; a diameter may come out too small where its last pairs are few among very many."""
    rows = sorted(tuple(r) for r in neighbourhood(nodes, edges, lg_k).collect())  # one row a distance
    far = rows[-1][1] - rows[0][1]
    return rows[-1][0], sum(d * (n - before) for (d, n), (_, before) in zip(rows[1:], rows, strict=False)) / far if far else 0.0


#: Links of a group whose triangles are counted as a whole, and open triangles that are looked up at once.
GROUP_LINKS, OPEN = 1 << 22, 1 << 21


def triangles(links: DataFrame, of_group: int = GROUP_LINKS) -> DataFrame:
    """``(n, t)``: how many triangles each node of the different links ``(a, b)``, numbers ``a < b``, is in.

    Nodes are dealt to parts, and each three of them, repeats included, make a
    group, which gets the links between its parts: a link goes to as many groups as
    there are parts, about the root of the links, and a triangle lies in one group.
    Open triangles are looked up there and never leave it.
    """
    parts = max(4, math.ceil(math.sqrt(6 * links.count() / of_group)))
    three = F.array_sort(F.array(F.col("a") % parts, F.col("b") % parts, F.col("c")))
    code = three[0] * (parts * parts) + three[1] * parts + three[2]
    dealt = links.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select("a", "b", code.alias("g"))

    def count(table: pa.Table) -> pa.Table:
        g, m = table.column("g")[0].as_py(), table.num_rows
        own = [g // parts**2, g // parts % parts, g % parts]
        nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        order = np.lexsort((ends[m:], ends[:m]))
        a, b = ends[:m][order], ends[m:][order]
        keys = a * len(nodes) + b
        # The three parts as a sum: four to the number of a part.
        sign = {p: 4**k for k, p in enumerate(sorted(set(own)))}
        signs, want = np.array([sign[p] for p in (nodes % parts).tolist()]), sum(sign[p] for p in own)
        later = np.searchsorted(a, a, side="right") - np.arange(m) - 1
        upto, t, k = np.cumsum(later), np.zeros(len(nodes), np.int64), 0
        while k < m:
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + OPEN, side="right")))
            n = later[k:stop]
            one = np.repeat(np.arange(k, stop), n)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            here = signs[a[one]] + signs[b[one]] + signs[b[two]] == want
            one, two = one[here], two[here]
            key = b[one] * len(nodes) + b[two]
            hit = keys[np.minimum(np.searchsorted(keys, key), m - 1)] == key
            for x in (a[one[hit]], b[one[hit]], b[two[hit]]):
                t += np.bincount(x, minlength=len(nodes))
            k = stop
        some = np.flatnonzero(t)
        return pa.table({"n": nodes[some], "t": t[some]})

    return dealt.groupBy("g").applyInArrow(count, "n long, t long").groupBy("n").agg(F.sum("t").alias("t"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, coefficient)``: linked pairs among a node's neighbours; 0 below two neighbours.

    Links point from the end of lower degree to the other, so each triangle is
    found once, at a node with few links out, however many a hub has.
    """
    e = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct())
    deg = e.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    deg = cut(deg.orderBy("k", "id").withColumn("n", F.monotonically_increasing_id()))  # numbers in the order of degrees
    both = e.join(deg.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x").join(deg.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
    tri = triangles(cut(both.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b"))))
    c = deg.join(tri, "n", "left").select("id", F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("coefficient"))
    return nodes.select("id").join(c, "id", "left").fillna(0.0, ["coefficient"])


#: Nodes up to which paths are counted pair by pair; more are estimated by sketches.
EXACT_PATHS = 2000


def graph_metrics(nodes: DataFrame, edges: DataFrame, optional: bool = False, exact_paths: int = EXACT_PATHS) -> DataFrame:
    """One row of descriptive metrics; the optional ones are -1 unless asked for, or the graph is in parts.

    Paths of a graph of more than ``exact_paths`` nodes are estimated (``path_metrics``).

    The driver reads counts only; the sizes of the components, largest first, are
    gathered by Spark from their histogram.
    """
    n, m = nodes.count(), edges.count()
    sizes = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    spread = cut(sizes.groupBy("n").agg(F.count("*").alias("times")), "sizes")
    listed = spread.agg(F.coalesce(F.sum("times"), F.lit(0)).cast("int").alias("num_components"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "times")), asc=False), lambda s: F.array_repeat(s["n"], s["times"].cast("int")))).alias("component_sizes"))
    loops, diameter, mean_path, cluster = -1, -1, -1.0, -1.0
    if optional:
        loops = edges.where("src = dst").count()
        cluster = clustering(nodes, edges).agg(F.avg("coefficient")).first()[0] or 0.0
        if spread.where("n > 0").agg(F.sum("times")).first()[0] == 1:
            if n > exact_paths:
                diameter, mean_path = path_metrics(nodes, edges)
            else:
                far = hops(nodes, edges).where("src <> dst").agg(F.max("dist").alias("d"), F.avg("dist").alias("a")).first()
                diameter, mean_path = far["d"] or 0, far["a"] or 0.0
    row = (n, m, 2 * m / n if n else 0.0, m / (n * (n - 1)) if n > 1 else 0.0, loops, diameter, mean_path, cluster)
    scalars = nodes.sparkSession.createDataFrame([row], "num_nodes long, num_edges long, mean_degree double, edge_density double, num_self_loops long, diameter int, mean_path double, clustering double")
    return scalars.join(F.broadcast(listed)).select("num_nodes", "num_edges", "mean_degree", "edge_density", "num_components", "component_sizes", "num_self_loops", "diameter", "mean_path", "clustering")


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


def document_subgraph(nodes: DataFrame, edges: DataFrame, doc: str) -> DataFrame:
    """``(id, category)``: a document, its chunks, the entities only they contain, the types only those have, and the chunks' summaries."""
    spark = nodes.sparkSession
    chunks = edges.where((F.col("rel") == "is_part_of") & (F.col("dst") == doc)).select(F.col("src").alias("id"))
    contains = edges.where("rel = 'contains'").select(F.col("src").alias("chunk"), F.col("dst").alias("id"))
    here = contains.join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi").select("id").distinct()
    elsewhere = contains.join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_anti").select("id")
    orphans = here.join(elsewhere, "id", "left_anti")
    is_a = edges.where("rel = 'is_a'").select(F.col("src").alias("entity"), F.col("dst").alias("id"))
    mine = orphans.select(F.col("id").alias("entity"))
    kinds = is_a.join(mine, "entity", "left_semi").select("id").distinct().join(is_a.join(mine, "entity", "left_anti").select("id"), "id", "left_anti")
    made = edges.where("rel = 'made_from'").join(chunks.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    parts = {"document": spark.createDataFrame([(doc,)], "id string"), "chunk": chunks, "orphan_entity": orphans, "orphan_type": kinds, "summary": made}
    out = None
    for name, df in parts.items():
        part = df.join(nodes.select("id"), "id", "left_semi").select("id", F.lit(name).alias("category"))
        out = part if out is None else out.union(part)
    return out


def delete_document(nodes: DataFrame, edges: DataFrame, doc: str, hard: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges left without a document's subgraph, and ``(category, deleted)``; ``hard`` also drops entities and types left with one edge."""
    gone = cut(document_subgraph(nodes, edges, doc))
    n, e = without_nodes(nodes, edges, gone)
    if hard:
        single = degree_one(n.where(F.col("type").isin("Entity", "EntityType")), e).select("id", F.lit("degree_one").alias("category"))
        gone = cut(gone.union(single))
        n, e = without_nodes(nodes, edges, gone)
    return n, e, gone.groupBy("category").agg(F.count("*").alias("deleted"))


# --- ranking ----------------------------------------------------------------


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 20) -> DataFrame:
    """``(id, rank)`` on an undirected weighted graph after fixed rounds; restarts fall on ``seeds (id, weight)``.

    Negative and null seed weights count as 0; without any seed all nodes are.
    The mass of nodes without edges restarts too.
    """
    e = edges.select("src", "dst", F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight")).where("src <> dst and weight > 0")
    two = both_ways(e).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = two.groupBy("src").agg(F.sum("weight").alias("total"))
    step = cut(two.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    s = nodes.select("id").join(seeds.select("id", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("w")), "id", "left").fillna(0.0, ["w"])
    sums = s.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
    reset = F.col("w") / sums["w"] if sums["w"] else F.lit(1.0 / max(1, sums["n"]))
    linked = step.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    s = cut(s.select("id", reset.alias("reset")).join(linked, "id", "left").fillna(False, ["linked"]))
    rank = s.select("id", F.col("reset").alias("rank"))
    some_stuck, written = not s.where("not linked").isEmpty(), []
    for k in range(rounds):
        got = step.join(rank, step.src == rank.id).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = s.join(got.withColumnRenamed("dst", "id"), "id", "left").fillna(0.0, ["got"])
        if some_stuck:
            stuck = s.where("not linked").join(rank, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
            new = new.join(F.broadcast(stuck)).withColumn("got", F.col("got") + F.col("stuck") * F.col("reset"))  # one row
        rank = new.select("id", (damping * F.col("got") + (1 - damping) * F.col("reset")).alias("rank"))
        if k % 4 == 3:
            rank = cut(rank)
            drop(*written)
            written = [rank]
    return rank


def pagerank_of_queries(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 20) -> DataFrame:
    """``(query_id, id, rank)``: a personalised PageRank for each query's ``seeds (query_id, id, weight)``, all moved together.

    A query has rows only for the nodes that its walk has reached.  Seed weights
    of a node add up, negative and null ones count as 0; the mass of nodes
    without edges restarts.
    """
    e = edges.select("src", "dst", F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight")).where("src <> dst and weight > 0")
    two = both_ways(e).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = two.groupBy("src").agg(F.sum("weight").alias("total"))
    step = cut(two.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    s = seeds.groupBy("query_id", "id").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w")).where("w > 0")
    total = s.groupBy("query_id").agg(F.sum("w").alias("total"))
    reset = cut(s.join(total, "query_id").select("query_id", "id", (F.col("w") / F.col("total")).alias("reset")))
    linked = step.select(F.col("src").alias("id")).distinct()
    lone, written = not reset.join(linked, "id", "left_anti").isEmpty(), []
    rank = reset.withColumnRenamed("reset", "rank")
    for k in range(rounds):
        moved = rank.join(step, rank.id == step.src).groupBy("query_id", "dst").agg(F.sum(F.col("p") * F.col("rank")).alias("x")).select("query_id", F.col("dst").alias("id"), (damping * F.col("x")).alias("x"))
        back = reset.withColumn("stuck", F.lit(0.0))
        if lone:
            held = rank.join(linked, "id", "left_anti").groupBy("query_id").agg(F.sum("rank").alias("stuck"))
            back = reset.join(held, "query_id", "left").fillna(0.0, ["stuck"])
        back = back.select("query_id", "id", ((1 - damping + damping * F.col("stuck")) * F.col("reset")).alias("x"))
        rank = moved.unionByName(back).groupBy("query_id", "id").agg(F.sum("x").alias("rank"))
        if k % 4 == 3:
            rank = cut(rank)
            drop(*written)
            written = [rank]
    return rank


def triplet_topk(edges: DataFrame, node_distance: DataFrame, edge_distance: DataFrame, k: int) -> DataFrame:
    """``(edge_id, src, rel, dst, total)``: the ``k`` triplets with the least summed distance, best first.

    Ends and relations without a distance are infinitely far; ties go to the smaller edge id.
    """
    far = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    d = node_distance.select("id", "distance")
    out = edges.join(d.toDF("src", "ds"), "src", "left").join(d.toDF("dst", "dd"), "dst", "left").join(edge_distance.select("rel", F.col("distance").alias("de")), "rel", "left")
    total = far("ds") + far("dd") + far("de")
    return out.select("edge_id", "src", "rel", "dst", total.alias("total")).orderBy("total", "edge_id").limit(k)


def best_first(edges: DataFrame, seeds: DataFrame, concepts: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(id, cost)``: cheapest cost from the seeds at 1/weight an edge, through nodes that add a concept.

    ``seeds`` has ``(id, cost)`` and ``concepts`` has ``(id, concepts)``.  A
    node goes on the frontier only while its cost falls and it has concepts that
    its predecessor on the way has not.  The walk ends when the frontier is
    empty, or after ``rounds`` edges where a number is given.
    """
    c = concepts.select("id", "concepts")
    two = cut(both_ways(edges.select("src", "dst", "weight")).where("weight > 0").join(c.toDF("src", "cs"), "src", "left").join(c.toDF("dst", "cd"), "dst", "left").where(F.size(F.array_except(F.coalesce("cd", F.array()), F.coalesce("cs", F.array()))) > 0).select("src", "dst", (1 / F.col("weight")).alias("cost")))
    best = cut(seeds.groupBy("id").agg(F.min("cost").alias("cost")))
    front = best
    for _ in itertools.count() if rounds is None else range(rounds):
        new = front.join(two.withColumnRenamed("cost", "step"), front.id == two.src).groupBy("dst").agg(F.min(F.col("cost") + F.col("step")).alias("cost"))
        new = new.select(F.col("dst").alias("id"), "cost")
        front = cut(new.join(best.withColumnRenamed("cost", "had"), "id", "left").where("had is null or cost < had").select("id", "cost"))
        if front.isEmpty():
            break
        before, best = best, cut(best.union(front).groupBy("id").agg(F.min("cost").alias("cost")))
        if before is not front:
            drop(before)
    return best


def best_first_batch(edges: DataFrame, seeds: DataFrame, concepts: DataFrame, answers: DataFrame, delta: float = 1.0) -> DataFrame:
    """``(query_id, id, cost)``: for each question, all nodes that are no dearer than its cheapest answer.

    As ``best_first``, for a table of questions: ``seeds`` has ``(query_id, id,
    cost)`` and ``answers`` ``(query_id, id)``.  Nodes lie in buckets of ``delta``
    by their cost; a step opens each question's lowest bucket that is not done.
    A question stops once that bucket's cheapest node costs more than an answer
    that it has; one whose answers are out of reach walks to the end.
    """
    c = concepts.select("id", "concepts")
    two = both_ways(edges.select("src", "dst", "weight")).where("weight > 0").join(c.toDF("src", "cs"), "src", "left").join(c.toDF("dst", "cd"), "dst", "left")
    two = two.where(F.size(F.array_except(F.coalesce("cd", F.array()), F.coalesce("cs", F.array()))) > 0)
    two = cut(two.groupBy("src", "dst").agg(F.min(1 / F.col("weight")).alias("step")))
    asked = answers.select("query_id", "id").distinct().withColumn("answer", F.lit(True))
    have = cut(seeds.groupBy("query_id", "id").agg(F.min("cost").alias("cost")).withColumn("todo", F.lit(True)).join(asked, ["query_id", "id"], "left"))
    while True:
        end = F.coalesce(F.min(F.when(F.col("answer"), F.col("cost"))), F.lit(float("inf")))
        state = have.groupBy("query_id").agg(F.min(F.when(F.col("todo"), F.col("cost"))).alias("low"), end.alias("end"))
        open_ = state.where("low <= end").select("query_id", "end", ((F.floor(F.col("low") / delta) + 1) * delta).alias("top"))
        front = cut(have.where("todo").join(open_, "query_id").where("cost < top and cost <= end").select("query_id", "id", "cost"))
        if front.isEmpty():
            break
        new = front.join(two, front.id == two.src).select("query_id", F.col("dst").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(True).alias("todo"))
        done = front.select("query_id", "id", "cost", F.lit(False).alias("todo"))
        every = have.select("query_id", "id", "cost", "todo").unionByName(done).unionByName(new)
        # The least cost, and of equal ones that which is done.
        least = every.groupBy("query_id", "id").agg(F.min(F.struct("cost", "todo")).alias("s")).select("query_id", "id", "s.cost", "s.todo")
        before, have = have, cut(least.join(asked, ["query_id", "id"], "left"))
        drop(before, front)
    ends = have.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("answer"), F.col("cost"))), F.lit(float("inf"))).alias("end"))
    return have.join(ends, "query_id").where("cost <= end").select("query_id", "id", "cost")


def ontology_closure(links: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, depth)``: everything reached from ``start`` over ``(src, dst)`` links, nearest first; to ``depth`` links where it is given."""
    step = cut(links.select("src", "dst").distinct())
    seen = front = cut(start.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        near = front.join(step, front.id == step.src).select(F.col("dst").alias("id")).where("id is not null").distinct()
        front = cut(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        before, seen = seen, cut(seen.unionByName(front))
        drop(before)
    return seen

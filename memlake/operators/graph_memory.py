"""Graph memories of users, code graphs, typed models as graphs, labels as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions.ids import node_id, uuid5
from memlake.functions.text import node_key
from memlake.functions.vectors import dot, norm, normalized
from memlake.operators.bm25 import ranked
from memlake.operators.vector_store import topk


def merge_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame, same: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """A user's graph with new relations ``(user_id, source, rel, destination, source_vector, destination_vector)``.

    An end is the user's node that is most similar to it, at ``same`` or more;
    else it becomes a node.  A relation that is there already stays one.
    """
    ends = None
    for name in ("source", "destination"):
        part = new.select("user_id", node_key(name).alias("name"), F.col(f"{name}_vector").alias("vector"))
        ends = part if ends is None else ends.unionByName(part)
    ends = ends.dropDuplicates(["user_id", "name"]).withColumn("qid", F.concat_ws("|", "user_id", "name"))
    # Only the user's own nodes are met, so none of another user's can take a place.
    own = nodes.where(norm("vector") > 0).select("user_id", F.col("id"), normalized(F.col("vector")).alias("v"))
    asked = ends.where(norm("vector") > 0).select("user_id", F.col("qid").alias("query_id"), normalized(F.col("vector")).alias("q"))
    pairs = own.join(asked, "user_id").where(F.size("v") == F.size("q")).select("query_id", "id", dot(F.col("v"), F.col("q")).alias("score"))
    near = ranked(pairs.where(F.col("score") >= same), 1, tie="id").select(F.col("query_id").alias("qid"), "id")
    known = ends.select("qid").join(near, "qid", "left")
    resolved = ends.join(known, "qid").withColumn("node", F.coalesce("id", uuid5(F.col("qid"))))
    fresh = resolved.where("id is null").select(F.col("node").alias("id"), "user_id", "name", "vector")
    at = resolved.select("user_id", "name", "node")
    rel = new.select("user_id", node_key("source").alias("s"), node_key("rel").alias("rel"), node_key("destination").alias("d"))
    rel = rel.join(at.toDF("user_id", "s", "src"), ["user_id", "s"]).join(at.toDF("user_id", "d", "dst"), ["user_id", "d"]).select("user_id", "src", "rel", "dst").distinct()
    return nodes.unionByName(fresh), edges.unionByName(rel.join(edges, ["user_id", "src", "rel", "dst"], "left_anti"))


def user_relations(nodes: DataFrame, edges: DataFrame, user: str, limit: int = 100) -> DataFrame:
    """``(source, relationship, target)`` of a user."""
    n = nodes.where(F.col("user_id") == user).select("id", "name")
    e = edges.where(F.col("user_id") == user)
    return e.join(n.toDF("src", "source"), "src").join(n.toDF("dst", "target"), "dst").select("source", F.col("rel").alias("relationship"), "target").orderBy("source", "relationship", "target").limit(limit)


def both_directions(nodes: DataFrame, edges: DataFrame, asked: DataFrame, threshold: float = 0.7, k: int | None = None) -> DataFrame:
    """Incoming and outgoing relations of all nodes at least ``threshold`` similar to the asked vectors, each once; of the ``k`` most similar where ``k`` is given."""
    near = topk(nodes.select("id", "vector"), asked, k)
    hits = near.select("query_id", F.col("id").alias("hit"), F.round("score", 4).alias("similarity")).where(F.col("similarity") >= threshold)
    out_ = hits.join(edges, F.col("hit") == F.col("src")).select("query_id", "src", "rel", "dst", "similarity")
    in_ = hits.join(edges, F.col("hit") == F.col("dst")).select("query_id", "src", "rel", "dst", "similarity")
    return out_.union(in_).distinct()


def without_user(nodes: DataFrame, edges: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("user_id") != user), edges.where(F.col("user_id") != user)


def model_graph(rows: DataFrame, kind: str, id_col: str, relations: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of nested rows: each relation column is a struct, or an array of structs, with the given id field and type.

    ``relations`` maps a column to ``(id field, type)``; the column's name is the edge's.
    """
    nodes = rows.select(F.col(id_col).cast("string").alias("id"), F.lit(kind).alias("type"))
    edges = None
    for name, (field, other) in relations.items():
        many = rows.schema[name].dataType.typeName() == "array"
        one = rows.select(F.col(id_col).cast("string").alias("src"), (F.explode(name) if many else F.col(name)).alias("x")).where("x is not null")
        nodes = nodes.unionByName(one.select(F.col(f"x.{field}").cast("string").alias("id"), F.lit(other).alias("type")))
        part = one.select("src", F.col(f"x.{field}").cast("string").alias("dst"), F.lit(name).alias("rel"))
        edges = part if edges is None else edges.unionByName(part)
    if edges is None:
        edges = rows.sparkSession.createDataFrame([], "src string, dst string, rel string")
    return nodes.dropDuplicates(["id"]), edges.distinct()


def label_graph(chunks: DataFrame, label: Column, subclasses: Column) -> tuple[DataFrame, DataFrame]:
    """Classified chunks as a graph: label type and subclasses are nodes; ``is_classified_as`` and ``is_subtype_of`` are edges."""
    c = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), label.alias("label"), F.explode(subclasses).alias("sub"))
    nodes = c.select(node_id(F.col("label")).alias("id"), F.col("label").alias("name"), F.lit("LabelType").alias("type")).union(c.select(node_id(F.col("sub")), "sub", F.lit("LabelSubclass"))).dropDuplicates(["id"])
    edges = c.select("chunk_id", node_id(F.col("sub")).alias("dst"), F.lit("is_classified_as").alias("rel")).toDF("src", "dst", "rel")
    edges = edges.union(c.select(node_id(F.col("sub")), node_id(F.col("label")), F.lit("is_subtype_of")))
    return nodes, edges.distinct()


def import_graph(files: DataFrame) -> DataFrame:
    """``(src, dst)``: Python files ``(path, content)`` and the files of the same repository that they import.

    A module is known by its dotted path from the repository's root.
    """
    f = files.select("path", F.decode(F.col("content"), "UTF-8").alias("text"), F.translate(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".").alias("module"))
    names = F.concat(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import"), F.lit(1)))
    used = f.select(F.col("path").alias("src"), F.explode(F.array_distinct(names)).alias("module"))
    return used.join(f.select("module", F.col("path").alias("dst")), "module").where("src <> dst").select("src", "dst").distinct()


def two_hop(edges: DataFrame, start: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """``(id, reached)`` over an edge of the first relations, then one of the second, in either direction."""
    step = lambda rels: edges.where(F.col("rel").isin(rels)).select("src", "dst").union(edges.where(F.col("rel").isin(rels)).select("dst", "src"))
    a = start.select("id").join(step(first).toDF("id", "mid"), "id")
    return a.join(step(second).toDF("mid", "reached"), "mid").select("id", "reached").distinct()


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")

"""Exact vector search and one table behind the vector-store contract."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from memlake.functions.vectors import METRICS, dot, norm, normalized
from memlake.operators.bm25 import ranked
from memlake.operators.metric_join import close_pairs, nearest_between


def _shown(value: Any) -> str:
    """A value as Spark casts it to text."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def predicate(filters: Mapping[str, Any] | None, payload: Column | None = None) -> Column:
    """AND of payload conditions; a missing key never matches.

    A list means membership, ``{"gte", "lte", "gt", "lt", "eq", "ne"}`` a
    comparison (``$gte`` and so on too), ``None`` no condition, anything else equality as text.  Without
    ``payload`` keys are columns; else it is a map of strings.
    """
    out = F.lit(True)
    for key, want in (filters or {}).items():
        if want is None:
            continue
        have = F.col(key) if payload is None else F.element_at(payload, F.lit(key))
        if isinstance(want, Mapping):
            want = {op.lstrip("$"): v for op, v in want.items()}
            num = have if payload is None else have.cast("double")
            ops = {"gte": num >= want.get("gte"), "lte": num <= want.get("lte"), "gt": num > want.get("gt"), "lt": num < want.get("lt"), "eq": have == want.get("eq"), "ne": have != want.get("ne")}
            for op in want:
                out &= ops[op]
        elif isinstance(want, list | tuple | set):
            out &= have.cast("string").isin([_shown(w) for w in want])
        else:
            out &= have.cast("string") == _shown(want)
    return F.coalesce(out, F.lit(False))


def cells(df: DataFrame) -> int:
    """Into how many parts a join of all with all is dealt: as many as shuffles have, eight at least."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _numbered(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def topk(vectors: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", keep: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: exact nearest of every query; without ``k`` all scores, unranked.

    The query set meets the rows block by block, by an equality join on the
    block: Spark broadcasts the queries below its size threshold and shuffles
    blocks above it.  The window's limit is applied before its shuffle.
    """
    measure, high = METRICS[metric]
    n = blocks or cells(vectors)
    v, q = F.col(vector_col), F.col(query_vector)
    if metric == "cosine":
        # Unit vectors once a row, so a pair costs one product; zero vectors have no cosine.
        vectors, queries = vectors.where(norm(v) > 0), queries.where(norm(q) > 0)
        v, q, measure = normalized(v), normalized(q), lambda x, y: F.when(F.size(x) == F.size(y), dot(x, y))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("__v"), *keep, F.pmod(F.xxhash64(id_col), F.lit(n)).alias("__b"))
    asked = queries.select(F.col(query_id).alias("query_id"), q.alias("__q"), F.explode(_numbered(n)).alias("__b"))
    pairs = rows.join(asked, "__b")
    scored = pairs.select("query_id", "id", *keep, measure(F.col("__v"), F.col("__q")).alias("score")).where("score is not null")
    if k is None:
        return scored
    if high:
        return ranked(scored, k, tie="id").select("query_id", "rank", "id", "score", *keep)
    near = scored.withColumn("score", -F.col("score"))
    return ranked(near, k, tie="id").select("query_id", "rank", "id", (-F.col("score")).alias("score"), *keep)


def minmax(scores: DataFrame, by: str = "query_id", score: str = "score", out: str = "normalized") -> DataFrame:
    """Min-max per query; equal scores give 0.  The bounds are pre-aggregated, so no task holds a query's rows."""
    bounds = scores.groupBy(F.col(by).alias("__by")).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    j = scores.join(bounds, scores[by].eqNullSafe(bounds["__by"]))
    return j.withColumn(out, F.when(F.col("__hi") > F.col("__lo"), (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))).drop("__by", "__lo", "__hi")


def _grid(a: DataFrame, b: DataFrame, key_a: str, key_b: str, blocks: int) -> DataFrame:
    """All pairs of two tables of different column names, dealt into about ``blocks`` cells.

    Each side goes to one row or column of the grid, so to the root of the number of cells.
    """
    side = max(1, math.isqrt(blocks))
    a = a.withColumn("__i", F.pmod(F.xxhash64(key_a), F.lit(side))).withColumn("__j", F.explode(_numbered(side)))
    b = b.withColumn("__j", F.pmod(F.xxhash64(key_b), F.lit(side))).withColumn("__i", F.explode(_numbered(side)))
    return a.join(b, ["__i", "__j"])


def knn_join(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None, id_col: str = "id", vector_col: str = "vector", blocks: int | None = None) -> DataFrame:
    """``(src, dst, score)``: the ``k`` most cosine-similar rows of ``right`` for each of ``left``, itself left out.

    With a threshold, unit vectors meet in cells around pivots, which rows too far
    apart do not share, and a block sends on each row's ``k`` best; without one, all
    meet in the cells of a grid.
    """
    n = blocks or cells(left)
    if threshold is not None:
        pairs = nearest_between(left, right, k, threshold, n, id_col, vector_col).where(F.col("score") >= threshold)
    else:
        unit = lambda df, i, v: df.select(F.col(id_col).alias(i), normalized(F.col(vector_col)).alias(v))
        met = _grid(unit(left, "src", "va"), unit(right, "dst", "vb"), "src", "dst", n)
        pairs = met.where("src <> dst").select("src", "dst", dot(F.col("va"), F.col("vb")).alias("score"))
    return ranked(pairs, k, query="src", tie="dst").select("src", "dst", "rank", "score")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", keep: tuple[str, ...] = (), within: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """``(a, b, sim)`` of pairs ``a < b`` above the cosine threshold, met in cells around pivots (``metric_join``).

    Columns of ``within`` must be equal: they are keys of the join, so rows that differ in them never meet.
    """
    out = close_pairs(vectors, threshold, blocks or cells(vectors), id_col, vector_col, keep, within).where(F.col("sim") > threshold)
    return out.select("a", "b", "sim", *[f"{c}_{s}" for s in "ab" for c in keep], *within)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by ``order``; the window's limit is applied before its shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class VectorStore:
    """Collections of ``(id, vector, payload)`` under one folder: append-only parts, latest wins, deletes are tombstones.

    Of an id written twice in one write the row with the smaller payload text wins.

    Scores are returned as both similarity and distance, so no caller has to know which one ``score`` means.
    """

    DDL = "id string, vector array<float>, payload map<string,string>, seq long, deleted boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def list_collections(self) -> list[str]:
        _, fs, root = self._fs()
        names = {s.getPath().getName() for s in fs.listStatus(root)} if fs.exists(root) else set()
        moved = {n[1:-4] for n in names if n.startswith(".") and n.endswith(".old")}
        return sorted({n for n in names if not n.startswith(".")} | moved)

    def has_collection(self, name: str) -> bool:
        return name in self.list_collections()

    def create_collection(self, name: str) -> None:
        if not self.has_collection(name):
            self.spark.createDataFrame([], self.DDL).write.parquet(self._folder(name))

    def delete_collection(self, name: str) -> None:
        jvm, fs, _ = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self._folder(name)), True)

    def prune(self) -> None:
        for name in self.list_collections():
            self.delete_collection(name)

    def collection_info(self, name: str) -> dict[str, Any]:
        rows = self.rows(name)
        first = rows.select(F.size("vector").alias("d")).first()
        return {"name": name, "rows": rows.count(), "dims": first["d"] if first else None}

    def _log(self, name: str) -> DataFrame:
        self._mended(name)
        return self.spark.read.schema(self.DDL).parquet(self._folder(name))

    def rows(self, name: str) -> DataFrame:
        """Current rows."""
        tie = F.coalesce(F.array_join(F.array_sort(F.map_values("payload")), "|"), F.lit(""))
        return latest(self._log(name), ["id"], [F.desc("seq"), F.asc(tie)]).where(~F.col("deleted")).select("id", "vector", "payload")

    @staticmethod
    def _next() -> int:
        """A write's time in nanoseconds; no table is read for it."""
        return time.time_ns()

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Adds or replaces by id."""
        rows.select("id", "vector", "payload", F.lit(self._next()).cast("long").alias("seq"), F.lit(False).alias("deleted")).write.mode("append").parquet(self._folder(name))

    insert = upsert

    def update(self, name: str, id_: str, vector: list[float] | None = None, payload: Mapping[str, str] | None = None) -> None:
        """Replaces the vector, the payload, or both, of a row that exists."""
        row = self.rows(name).where(F.col("id") == id_)
        if vector is not None:
            row = row.withColumn("vector", F.array(*map(F.lit, vector)).cast("array<float>"))
        if payload is not None:
            row = row.withColumn("payload", F.create_map(*[F.lit(str(x)) for kv in payload.items() for x in kv]))
        self.upsert(name, row)

    def delete(self, name: str, ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("payload"), F.lit(self._next()).cast("long").alias("seq"), F.lit(True).alias("deleted")).write.mode("append").parquet(self._folder(name))

    def compact(self, name: str) -> None:
        """Rewrites a collection without superseded rows: a whole new folder takes the old one's place."""
        jvm, fs, _ = self._fs()
        path = lambda n: jvm.org.apache.hadoop.fs.Path(self._folder(n))
        whole = self.rows(name).select("*", F.lit(1).cast("long").alias("seq"), F.lit(False).alias("deleted"))
        whole.write.mode("overwrite").parquet(self._folder(f".{name}.new"))
        fs.rename(path(name), path(f".{name}.old"))
        fs.rename(path(f".{name}.new"), path(name))
        fs.delete(path(f".{name}.old"), True)

    def _mended(self, name: str) -> None:
        """Puts back the folder that a broken ``compact`` had moved away."""
        jvm, fs, _ = self._fs()
        path = lambda n: jvm.org.apache.hadoop.fs.Path(self._folder(n))
        if not fs.exists(path(name)) and fs.exists(path(f".{name}.old")):
            fs.rename(path(f".{name}.old"), path(name))

    def get(self, name: str, ids: list[str]) -> DataFrame:
        """Rows by id, in the order asked."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
        return self.rows(name).join(asked, "id").orderBy("pos").select("id", "vector", "payload")

    def list(self, name: str, filters: Mapping[str, Any] | None = None, limit: int | None = None, newest_by: str | None = None) -> DataFrame:
        out = self.rows(name).where(predicate(filters, F.col("payload")))
        out = out.orderBy(F.desc(F.element_at("payload", F.lit(newest_by))), "id") if newest_by else out.orderBy("id")
        return out.limit(limit) if limit else out

    def search(self, name: str, queries: DataFrame, k: int = 5, metric: str = "cosine", filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Filters first, then ranks; ``queries`` has ``query_id`` and ``query_vector``."""
        hits = topk(self.rows(name).where(predicate(filters, F.col("payload"))), queries, k, metric, keep=("payload",))
        return hits.select("query_id", "rank", "id", "score", *self._both(metric), "payload")

    @staticmethod
    def _both(metric: str) -> tuple[Column, Column]:
        similarity = {"cosine": F.col("score"), "ip": F.col("score"), "l2": 1 / (1 + F.col("score"))}[metric]
        distance = {"cosine": 1 - F.col("score"), "ip": -F.col("score"), "l2": F.col("score")}[metric]
        return similarity.alias("similarity"), distance.alias("distance")

    batch_search = search

    def distances(self, name: str, queries: DataFrame, metric: str = "cosine") -> DataFrame:
        """Every row's distance to every query, unranked, min-max normalised per query."""
        hits = topk(self.rows(name), queries, None, metric)
        return minmax(hits.select("query_id", "id", "score", *self._both(metric)), score="distance")

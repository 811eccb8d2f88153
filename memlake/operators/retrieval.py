"""Composed retrieval: from queries to ranked passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from memlake.functions import text as X
from memlake.operators import bm25, graph
from memlake.operators.vector_store import minmax, topk
from memlake.scratch import cut


def dense(passages: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", **cols) -> DataFrame:
    """``(query_id, rank, id, score)``."""
    return topk(passages, queries, k, metric, **cols)


def hybrid(lexical: DataFrame, dense_hits: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Weighted sum of min-max normalised lexical and dense scores; a missing one counts 0."""
    a = minmax(lexical.select("query_id", "doc_id", "score")).select("query_id", "doc_id", F.col("normalized").alias("ls"))
    b = minmax(dense_hits.select("query_id", F.col("id").alias("doc_id"), "score")).select("query_id", "doc_id", F.col("normalized").alias("ds"))
    j = a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", (alpha * F.coalesce("ds", F.lit(0.0)) + (1 - alpha) * F.coalesce("ls", F.lit(0.0))).alias("score"))
    return bm25.ranked(j, k).select("query_id", "rank", "doc_id", "score")


def union_of_queries(hits: DataFrame) -> DataFrame:
    """Distinct passages over all rewrites of a question, in document order."""
    return hits.select("question_id", "id").distinct().orderBy("question_id", "id")


def short_lines_dropped(df: DataFrame, c: str, least: int = 4) -> DataFrame:
    """Generated lines with more than three words."""
    return df.where(F.size(F.split(F.trim(c), r"\s+")) >= least)


def fused(facts: DataFrame, fact_hits: DataFrame, mentions: DataFrame, dense_hits: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, link_top_k: int = 5, passage_weight: float = 0.05, damping: float = 0.5, rounds: int = 20) -> DataFrame:
    """Graph and dense fusion for one query: ``(rank, passage_id, score)``.

    Seeds are the phrases of the best facts, by mean fact score over the number
    of chunks that hold the phrase, and every passage by its normalised dense
    score at a small weight.  Personalised PageRank ranks the passages; without
    facts the dense order stands.
    """
    dense_n = minmax(dense_hits.withColumn("query_id", F.lit(0))).select(F.col("id"), (F.col("normalized") * passage_weight).alias("weight"))
    chosen = fact_hits.join(facts, "fact_id")
    if chosen.isEmpty():
        w = W.orderBy(F.desc("score"), "id")
        return dense_hits.select(F.row_number().over(w).alias("rank"), F.col("id").alias("passage_id"), "score").where(F.col("rank") <= k)
    freq = mentions.groupBy("phrase").agg(F.countDistinct("chunk_id").alias("chunks"))
    phrases = chosen.select("score", F.explode(F.array("s", "o")).alias("phrase")).groupBy("phrase").agg(F.avg("score").alias("mean"))
    phrases = phrases.join(freq, "phrase", "left").select("phrase", (F.col("mean") / F.coalesce("chunks", F.lit(1))).alias("weight"))
    best = phrases.orderBy(F.desc("weight"), "phrase").limit(link_top_k).select(F.col("phrase").alias("id"), "weight")
    seeds = best.unionByName(dense_n)
    rank = graph.personalized_pagerank(nodes, edges, seeds, damping, rounds).join(dense_hits.select("id"), "id", "left_semi")
    w = W.orderBy(F.desc("rank_"), "id")
    return rank.withColumnRenamed("rank", "rank_").select(F.row_number().over(w).alias("rank"), F.col("id").alias("passage_id"), F.col("rank_").alias("score")).where(F.col("rank") <= k)


def best_facts(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, fact_id, score)``: the ``k`` best facts of each question, ties by fact."""
    return bm25.ranked(hits, k, tie="fact_id").select("query_id", "fact_id", "score")


def fused_batch(facts: DataFrame, fact_hits: DataFrame, mentions: DataFrame, dense_hits: DataFrame, edges: DataFrame, k: int, link_top_k: int = 5, passage_weight: float = 0.05, damping: float = 0.5, rounds: int = 20) -> DataFrame:
    """Graph and dense fusion for all questions at once: ``(query_id, rank, passage_id, score)``.

    As ``fused``, with a ``query_id`` in ``fact_hits`` and ``dense_hits``; the
    walks of all questions move together, over the nodes that each has reached.
    Questions without facts keep their dense order.
    """
    dense_n = minmax(dense_hits).select("query_id", "id", (F.col("normalized") * passage_weight).alias("weight"))
    freq = mentions.groupBy("phrase").agg(F.countDistinct("chunk_id").alias("chunks"))
    chosen = fact_hits.join(facts, "fact_id")
    phrases = chosen.select("query_id", "score", F.explode(F.array("s", "o")).alias("phrase")).groupBy("query_id", "phrase").agg(F.avg("score").alias("mean"))
    weighed = phrases.join(freq, "phrase", "left").select("query_id", F.col("phrase").alias("id"), (F.col("mean") / F.coalesce("chunks", F.lit(1))).alias("weight"))
    w = W.partitionBy("query_id").orderBy(F.desc("weight"), "id")
    best = weighed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= link_top_k).drop("n")
    asking = cut(fact_hits.select("query_id").distinct())
    seeds = best.unionByName(dense_n).join(asking, "query_id", "left_semi")
    rank = graph.pagerank_of_queries(edges, seeds, damping, rounds)
    walked = rank.join(dense_hits.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", F.col("rank").alias("score"))
    plain = dense_hits.join(asking, "query_id", "left_anti").select("query_id", "id", "score")
    return bm25.ranked(walked.unionByName(plain), k, tie="id").select("query_id", "rank", F.col("id").alias("passage_id"), "score")


def insights(exact: DataFrame, entity_hits: DataFrame, type_hits: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, cutoff: float = 0.5) -> DataFrame:
    """Connections of the node asked for, else of close hits (entities before types), each relation once.

    ``entity_hits`` and ``type_hits`` have ``(id, distance)``.
    """
    hits = entity_hits.withColumn("src", F.lit(0)).unionByName(type_hits.withColumn("src", F.lit(1))).where(F.col("distance") < cutoff)
    near = hits.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("distance", "id"))).where(F.col("n") <= k).orderBy("src", "n").limit(k).select("id")
    start = near if exact.isEmpty() else exact.select("id")
    return graph.connections(edges, nodes, start).dropDuplicates(["id", "rel", "other"])


def entity_queries(queries: DataFrame, kind: str = "PERSON") -> DataFrame:
    """One query per entity found in a question: ``"{entity} {question}"``; questions without entities stay as they are."""
    found = queries.select("query_id", "query", F.array_distinct(X.entities("query", kind)).alias("es"))
    each = F.when(F.size("es") > 0, F.transform("es", lambda e: F.concat(e, F.lit(" "), F.col("query")))).otherwise(F.array("query"))
    return found.select("query_id", F.explode(each).alias("query"))


def gated(hits: DataFrame, relevant, supported, utility) -> DataFrame:
    """The best passage per query among the relevant ones: supported first, then the more useful, then the nearer."""
    h = hits.withColumn("__rel", relevant).where("__rel")
    best = F.max_by("id", F.struct(supported.cast("int"), utility, -F.col("rank")))
    return h.groupBy("query_id").agg(best.alias("id"))


def temporal(facts: DataFrame, at) -> DataFrame:
    """Facts valid at a time: from ``valid_at`` on, before ``invalid_at``."""
    t = F.lit(at)
    return facts.where((F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (t < F.col("invalid_at"))))


def long_context(chunks: DataFrame, by: str, order: str, text: str, keep: int) -> DataFrame:
    """All chunks of a context in order, cut to the last ``keep`` words."""
    joined = chunks.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("context"))
    return joined.select(by, X.keep_tail("context", keep).alias("context"))


def allowed(hits: DataFrame, owned: DataFrame) -> DataFrame:
    """Hits of owned documents, and hits of none."""
    free = hits.where("document_id is null")
    return hits.join(owned.select("document_id"), "document_id", "left_semi").unionByName(free)


class Registry:
    """Search functions by name; each search is logged."""

    def __init__(self) -> None:
        self._by: dict[str, Callable[..., DataFrame]] = {}
        self.log: list[tuple[str, dict]] = []

    def add(self, name: str, f: Callable[..., DataFrame]) -> None:
        self._by[name] = f

    def names(self) -> list[str]:
        return sorted(self._by)

    def route(self, agent: str) -> str:
        """The first registered name that is part of an agent's name."""
        for name in self._by:
            if name in agent:
                return name
        raise NotImplementedError(agent)

    def search(self, name: str, *args, **options) -> DataFrame:
        if name not in self._by:
            raise ValueError(f"unknown search type {name}")
        self.log.append((name, options))
        return self._by[name](*args, **options)


def search_types() -> Registry:
    """The search types a user can ask for."""
    r = Registry()
    r.add("bm25", bm25.bm25_topk)
    r.add("dense", dense)
    r.add("hybrid", hybrid)
    r.add("chunks", lambda passages, queries, k=10: dense(passages, queries, k))
    r.add("summaries", lambda summaries, queries, k=10: dense(summaries, queries, k))
    r.add("completion", lambda passages, queries: dense(passages, queries, 1))
    r.add("insights", insights)
    r.add("graph_completion", graph.triplet_topk)
    r.add("fused", fused)
    r.add("fused_batch", fused_batch)
    r.add("pattern", graph.match_path)
    r.add("cypher", lambda spark, sql: spark.sql(sql))
    return r

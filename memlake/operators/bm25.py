"""BM25: postings as a DataFrame, scored by joins, cut by a window that is pruned before its shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from memlake.functions.text import words
from memlake.scratch import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents a block, and what bounds are raised by, so that rounding skips no block.
BLOCK, SLACK = 64, 1e-6
#: Documents and queries of a group that is scored as a whole, and texts whose words are counted at once.
GROUP, ASKED, TEXTS = 4096, 4096, 256


def ranked(scores: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "doc_id", digits: int = 6) -> DataFrame:
    """Top ``k`` per query by rounded score, ties by id, with ``rank``."""
    s = scores.withColumn(score, F.round(score, digits))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text") -> DataFrame:
    """``(id, term, tf)``."""
    t = words(F.lower(text_col)) if tokens is None else tokens
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(t).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text: str = "query", tokens: Column | None = None, query_tokens: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` for the documents that share a term with a query.

    Only postings of the queries' terms are kept, as a written table in which a
    document's terms lie together; the queries' weights are one too, so Spark
    knows their size when it chooses how to join them, and scores are summed
    before they are shuffled.  A query term counts as often as it is repeated.
    The idf is ``ln(1 + (N - df + 0.5) / (df + 0.5))``, which no term's frequency
    makes negative.
    """
    t = words(F.lower(text_col)) if tokens is None else tokens
    q = words(F.lower(query_text)) if query_tokens is None else query_tokens
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(q).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = docs.select(F.col(id_col).alias("doc_id"), t.alias("ts"))
    stats = terms.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    kept = terms.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = cut(kept.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # One row of corpus statistics, so broadcasting it is bounded.
    weights = asked.join(df, "term").join(F.broadcast(stats))
    weights = weights.select("query_id", "term", "avgdl", (F.col("qtf") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    weights = cut(weights, "weights")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """``(doc_id, dl, term, tf)`` of texts of different ids: each is split and counted where it lies.  A text without words has one row, without a term."""
    t = words(F.lower(text_col)) if tokens is None else tokens
    split = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(t, F.array().cast("array<string>")).alias("ts"))
    schema = T.StructType([split.schema["doc_id"], T.StructField("dl", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                ts, ids = batch.column("ts"), batch.column("doc_id")
                dl = pc.list_value_length(ts).to_numpy().astype(np.int64)
                flat = ts.flatten().dictionary_encode()
                n = max(1, len(flat.dictionary))
                key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * n + flat.indices.to_numpy(), return_counts=True)
                row, none = key // n, np.flatnonzero(dl == 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(dl[row]), flat.dictionary.take(pa.array(key % n)), pa.array(tf.astype(np.int64))], names=schema.names)
                if len(none):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(none)), pa.array(dl[none]), pa.nulls(len(none), flat.dictionary.type), pa.array(np.ones(len(none), np.int64))], names=schema.names)

    return split.mapInArrow(count, schema)


def saturation(tf: Column, dl: Column, mean: Column | float, k1: float = K1, b: float = B) -> Column:
    """What a term's frequency counts for: more with a higher one, less in a longer text."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def bounds(postings: DataFrame) -> DataFrame:
    """``(term, block, n, tf, dl)``: per block the number of a term's documents, their highest frequency and shortest length."""
    return postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))


def best_of_groups(postings: DataFrame, weights: DataFrame, some: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    """``(query_id, doc_id, score)``: the ``k`` best documents of each query's blocks ``some (query_id, block)``, within each group of blocks.

    Postings of a group's documents are shuffled once, however many queries share
    a term, and a query's scores there are one array; only its best leave the task.
    """
    groups = max(1, n // GROUP)
    parts = max(1, weights.select("query_id").distinct().count() // ASKED)
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("__g")
    own = postings.join(some.select("block").distinct(), "block", "left_semi")
    left = own.select("block", "doc_id", "term", saturation(F.col("tf"), F.col("dl"), mean).alias("s"), group, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__p"))
    packed = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("ws"))
    asks = some.groupBy("query_id", group).agg(F.collect_list("block").alias("blocks")).join(packed, "query_id")
    right = asks.select("query_id", "blocks", F.col("ws.term").alias("terms"), F.col("ws.w").alias("ws"), "__g", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("__p"))
    schema = T.StructType([weights.schema["query_id"], postings.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def best(posted: pa.Table, asked: pa.Table) -> pa.Table:
        to_arrow = [posted.schema.field("doc_id").type, asked.schema.field("query_id").type]
        if not posted.num_rows or not asked.num_rows:
            return pa.table([pa.array([], to_arrow[1]), pa.array([], to_arrow[0]), pa.array([], pa.float64())], names=schema.names)
        terms = posted.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        at = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
        code = {t: c for c, t in enumerate(terms.dictionary.to_pylist())}
        ids = posted.column("doc_id").combine_chunks()
        # Documents by their ids, so that of equal scores the smaller id is the smaller place.
        doc = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        size, first = doc.max() + 1, np.unique(doc, return_index=True)[1]
        blocks = posted.column("block").combine_chunks().dictionary_encode()
        place, block = {b: c for c, b in enumerate(blocks.dictionary.to_pylist())}, blocks.indices.to_numpy()[first]
        doc, s = doc[order], posted.column("s").to_numpy()[order]
        query, found, scores = [], [], []
        for q, (names, ws, mine) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("terms", "ws", "blocks")), strict=True)):
            runs = [(at[code[t]], at[code[t] + 1], w) for t, w in zip(names, ws, strict=True) if t in code]
            if not runs:
                continue
            of = np.concatenate([doc[x:y] for x, y, _ in runs])
            score = np.bincount(of, np.concatenate([w * s[x:y] for x, y, w in runs]), size)
            wanted = np.zeros(len(place), bool)
            wanted[[place[b] for b in mine if b in place]] = True
            hit = np.zeros(size, bool)
            hit[of] = True
            d = np.flatnonzero(hit & wanted[block])
            r = np.round(score[d], 6)
            if len(d) > k:
                d, r = (x[r >= np.partition(r, len(r) - k)[len(r) - k]] for x in (d, r))
            d = d[np.argsort(-r, kind="stable")[:k]]
            query.append(np.full(len(d), q))
            found.append(d)
            scores.append(score[d])
        query, found = (pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (query, [first[d] for d in found]))
        return pa.table([asked.column("query_id").take(query), ids.take(found), pa.array(np.concatenate([np.empty(0), *scores]))], names=schema.names)

    return left.groupBy("__g", "__p").cogroup(right.groupBy("__g", "__p")).applyInArrow(best, schema)


def pruned_topk(postings: DataFrame, limits: DataFrame, asked: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)``, exact.

    ``postings`` has ``(block, doc_id, dl, term, tf)`` and ``limits`` their bounds,
    both of the terms in ``asked`` (``query_id, term, qtf``) at least.
    """
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = limits.groupBy("term").agg(F.sum("n").alias("df"))
    weights = cut(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w")), "weights")
    most = F.sum(F.col("w") * saturation(F.col("tf"), F.col("dl"), mean))
    blocks = cut(limits.join(weights, "term").groupBy("query_id", "block").agg(most.alias("bound")), "blocks")

    best = ranked(blocks, max(2, k // 8), score="bound", tie="block").select("query_id", "block")
    sure = ranked(best_of_groups(postings, weights, best, n, mean, k), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    sure = cut(sure.where(F.col("found") == k).select("query_id", "least"), "least")
    rest = blocks.join(sure, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select("query_id", "block")
    return ranked(best_of_groups(postings, weights, cut(rest, "blocks"), n, mean, k), k).select("query_id", "rank", "doc_id", "score")


def questions(queries: DataFrame, query_col: str = "query_id", text_col: str = "query", tokens: Column | None = None) -> DataFrame:
    """``(query_id, term, qtf)``."""
    q = words(F.lower(text_col)) if tokens is None else tokens
    return queries.select(F.col(query_col).alias("query_id"), F.explode(q).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def topk_by_blocks(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text: str = "query", tokens: Column | None = None, query_tokens: Column | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``k`` best documents of each query, by bounds of blocks first.

    Texts are split once: each document adds one entry without a word, of which
    the statistics are made, to the postings of the queries' terms.
    """
    asked = cut(questions(queries, query_col, query_text, query_tokens), "asked")
    t = words(F.lower(text_col)) if tokens is None else tokens
    split = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(t, F.array().cast("array<string>")).alias("ts"))
    each = split.select("doc_id", F.size("ts").cast("long").alias("dl"), F.explode(F.concat("ts", F.array(F.lit("")))).alias("term"))
    terms = asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    tf = cut(each.join(terms, "term", "left_semi").repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    stats = tf.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    posted = tf.where("term <> ''").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, stats.n // BLOCK))))
    return pruned_topk(posted, bounds(posted), asked, stats.n, stats.mean or 1.0, k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` by scores of all documents that share a term; at sf0.1 half the time of ``topk_by_blocks``, whose bounds pay off where they are kept."""
    return ranked(bm25_scores(docs, queries, **options), k).select("query_id", "rank", "doc_id", "score")

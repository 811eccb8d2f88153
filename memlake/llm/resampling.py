"""Importance resampling towards a target distribution, over bucket-partitioned postings.

Features are runs of words, hashed into buckets.  A bucket's gain says how much
likelier it is in the target corpus than in the whole one; a document's weight is
the sum of its features' gains, and documents are drawn without replacement by
adding a Gumbel number to each weight and keeping the highest.

Documents are read once.  A batch of them sends each part of the bucket space
one packed list of postings (bucket, document, count).  A part is co-grouped with
both corpora's totals of its buckets, computes their gains, and answers each
batch with its documents' contributions, which are summed by document.  A list
has one posting for all repeats within a document, and a part is cut by batches
into groups of a bounded number, so a bucket that every document holds fills no
task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from memlake.llm.periodic_runs import word_numbers
from memlake.llm.scratch import bounded_batches, discard, written
from memlake.llm.substring_dedup import Words, mix

#: A-Z become a-z; all ASCII bytes but letters and digits become spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Parts of the bucket space, and batches whose postings meet in one group of a part.
PARTS, GROUP = 64, 64
POSTINGS = "chunk long, part int, docs binary, buckets binary, counts binary, ids array<long>, n_words array<long>, n_features array<long>, sums array<long>"


def feature_buckets(texts: list[bytes], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the document and bucket of every feature: all runs of 1 to ``runs`` words."""
    w = Words([t.translate(_LETTERS) for t in texts])
    numbers = word_numbers(w)
    docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    data = w.data.tobytes()
    for n in range(1, runs + 1):
        at = np.flatnonzero(w.left >= n) if len(w.start) else np.empty(0, np.int64)
        if not len(at):
            break
        # Each different run is hashed once; two runs are the same where their words' numbers are.
        same = numbers[at].astype(np.int64)
        for k in range(1, n):
            same = np.unique(same * (int(numbers.max()) + 1) + numbers[at + k], return_inverse=True)[1]
        _, first, place = np.unique(same, return_index=True, return_inverse=True)
        spans = [at[first] + k for k in range(n)]
        words = [b" ".join(data[a:b] for a, b in zip(w.start[list(s)].tolist(), w.end[list(s)].tolist())) for s in zip(*(x.tolist() for x in spans))] if n > 1 else [data[a:b] for a, b in zip(w.start[spans[0]].tolist(), w.end[spans[0]].tolist(), strict=True)]
        hashed = np.fromiter((zlib.crc32(x) % buckets for x in words), np.int64, len(words))
        docs.append(w.doc[at])
        found.append(hashed[place])
    return w.count, np.concatenate(docs), np.concatenate(found)


def postings(docs: DataFrame, id_col: str, text_col: str, runs: int, buckets: int, parts: int) -> DataFrame:
    """Of each batch of documents: a row a part with its postings, a row (part -1) about the documents, and one (part -2) with its features per bucket."""
    width = -(-buckets // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, batch in enumerate(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, chunk = len(texts), (TaskContext.get().partitionId() << 32) + nth
            words, doc, bucket = feature_buckets(texts, runs, buckets)
            key, count = np.unique((bucket // width * n + doc) * width + bucket % width, return_counts=True)
            part, rest = np.divmod(key, n * width) if n else (key, key)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            full = part[cut[:-1]].tolist()
            blobs = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:])] for x in ((rest // width).astype(np.uint32), (rest % width).astype(np.uint16), count.astype(np.uint32))]
            sums = np.bincount(bucket, minlength=buckets)
            empty = [None] * len(full)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * (len(full) + 2), pa.int64()), pa.array([*full, -1, -2], pa.int32()), *(pa.array([*b, None, None], pa.binary()) for b in blobs),
                    *(pa.array([*empty, x, None], pa.list_(pa.int64())) for x in (batch.column("id").to_pylist(), words, np.bincount(doc, minlength=n))), pa.array([*empty, None, sums], pa.list_(pa.int64())),
                ],
                names=["chunk", "part", "docs", "buckets", "counts", "ids", "n_words", "n_features", "sums"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, POSTINGS)


def bucket_totals(sent: DataFrame, name: str) -> DataFrame:
    """``(bucket, name)``: the corpus's features per bucket, where there are any."""
    return sent.where("part = -2").select(F.posexplode("sums").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias(name))


def gain(of_target: float, all_target: float, of_all: float, all_all: float, buckets: int) -> int:
    """1000 times the logarithm of the smoothed shares' quotient, cut downwards."""
    return math.floor(1000 * math.log((of_target + 1.0) * (all_all + buckets) / ((of_all + 1.0) * (all_target + buckets))))


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """``(row, id, n_words, n_features, weight)`` per document; see ``resample``."""
    spark, parts = docs.sparkSession, min(PARTS, buckets)
    width = -(-buckets // parts)
    sent = written(postings(docs, id_col, text_col, runs, buckets, parts), "postings")
    other = written(postings(target.withColumn("__id", F.lit(0)), "__id", target_col, runs, buckets, parts).where("part = -2"), "target-postings")
    totals = bucket_totals(sent, "s").join(bucket_totals(other, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    totals = written(totals, "bucket-totals")  # at most one row a bucket
    everything = totals.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    groups = -(-max(1, sent.where("part = -1").count()) // GROUP)

    def contributions(lists: pa.Table, both: pa.Table) -> pa.Table:
        chunks, out_docs, out_weights = [], [], []
        if lists.num_rows:
            part = lists.column("part")[0].as_py()
            gains = np.zeros(width, np.int64)
            for b, s, t in zip(*(both.column(c).to_pylist() for c in ("bucket", "s", "t")), strict=True):
                gains[b - part * width] = gain(t, everything.t, s, everything.s, buckets)
            for chunk, d, b, c in zip(*(lists.column(x).to_pylist() for x in ("chunk", "docs", "buckets", "counts")), strict=True):
                doc = np.frombuffer(d, np.uint32)
                own, at = np.unique(doc, return_index=True)
                chunks.append(chunk)
                out_docs.append(own.tobytes())
                out_weights.append(np.add.reduceat(gains[np.frombuffer(b, np.uint16)] * np.frombuffer(c, np.uint32).astype(np.int64), at).tobytes())
        return pa.table([pa.array(chunks, pa.int64()), pa.array(out_docs, pa.binary()), pa.array(out_weights, pa.binary())], names=["chunk", "docs", "weights"])

    def by_document(about: pa.Table, given: pa.Table) -> pa.Table:
        ids, words, features = (about.column(c)[0].values for c in ("ids", "n_words", "n_features"))
        weight = np.zeros(len(ids), np.int64)
        for d, x in zip(given.column("docs").to_pylist(), given.column("weights").to_pylist(), strict=True):
            weight[np.frombuffer(d, np.uint32)] += np.frombuffer(x, np.int64)
        # A number that tells rows of equal score and id apart, so that ranges can be cut between them.
        row = mix(np.arange(len(ids), dtype=np.uint64) + mix(np.array([about.column("chunk")[0].as_py()], np.uint64))).view(np.int64)
        return pa.table([pa.array(row), ids, words, features, pa.array(weight)], names=["row", "id", "n_words", "n_features", "weight"])

    salt = F.pmod(F.xxhash64("chunk"), F.lit(groups))
    lists = sent.where("part >= 0").select("chunk", "part", "docs", "buckets", "counts", salt.alias("salt"))
    both = totals.select(F.floor(F.col("bucket") / width).cast("int").alias("part"), "bucket", "s", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("salt"))
    given = lists.groupBy("part", "salt").cogroup(both.groupBy("part", "salt")).applyInArrow(contributions, "chunk long, docs binary, weights binary")
    about = sent.where("part = -1").select("chunk", "ids", "n_words", "n_features")
    out = written(about.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(by_document, "row long, id long, n_words long, n_features long, weight long"), "weights")
    discard(sent, other, totals)
    return out


def ranked(rows: DataFrame, order: list, rows_per_part: int = 1_000_000) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, which no single task has to see: rows are cut into ranges, and a row's rank is its place behind all lower ranges."""
    spark = rows.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // rows_per_part)
    place = F.monotonically_increasing_id()
    cut = written(rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("__at", place), "ranked")
    in_range = cut.withColumn("__range", F.shiftright("__at", 33)).withColumn("__nth", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = in_range.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row a range
    return in_range.join(before, "__range").withColumn("rank", F.col("__before") + F.col("__nth") + 1).drop("__at", "__range", "__nth", "__n", "__before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", runs: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score``, ``rank`` of those drawn (else null).

    Words are runs of ASCII letters, digits and all other characters beyond
    ASCII, A-Z lower-cased; features are all runs of 1 to ``runs`` words, repeats
    included, and a feature's bucket is its crc32 modulo ``buckets``.  ``weight``
    sums their gains.  ``score`` adds a Gumbel number made of ``seed`` and the id.
    Of the documents with at least ``min_words`` words, ``percent`` % with the
    highest scores are drawn, ties to the smaller id.

    Null and empty texts have no features and weight 0; in either corpus they
    count for nothing.  A null id's number is that of the empty text, and it comes
    after all others in ties; rows that repeat an id are rows of their own.  An
    empty corpus gives an empty result, and an empty target gains of its own; other columns are ignored.
    """
    rows = importance_weights(docs, target, id_col, text_col, target_col, runs, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = rows.withColumn("score", F.col("weight") + gumbel)
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    best = ranked(enough, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = best.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

"""BM25 over a kept index: posting segments, tombstones, merges, block bounds.

An add writes one segment: its postings, in folders by a hash of their term and
sorted by it, and bounds of each term per block of documents.  A search reads
only the folders of its terms.  It first sums the bounds per block, scores the
few most promising blocks of each query, and then only the blocks whose bound
reaches the score that is to be beaten; no other block can hold a better one.

What counts is said by the newest finished manifest, a small table of segments
and deletions with their statistics, so a broken write leaves nothing behind that
is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.operators.bm25 import BLOCK, bounds, counted, pruned_topk, questions
from memlake.scratch import cut
from memlake.sources.tables import exists
from memlake.streaming.incremental import folders

#: Folders of terms, and segments of a level that are merged into one of the next.
BUCKETS, MERGE = 32, 8
#: Up to so many terms are filters of the scan by name; more are joined.
NAMED = 1000
MANIFEST = "kind string, number int, level int, docs long, words long"


def bucket(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class PostingIndex:
    """Documents ``(doc_id, text)`` under a folder.  An id that is added again replaces its document; one deleted may be added again.

    Null and empty texts count as documents without words; of an id that comes
    twice in an add, one row is taken.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.path = spark, path.rstrip("/")
        posting = f"term string, block string, bucket int, segment int, dl long, tf long, doc_id {id_type}"
        self.schemas = {"documents": f"doc_id {id_type}, dl long, segment int", "deleted": f"doc_id {id_type}, segment int", "postings": posting, "bounds": "term string, block string, n long, tf long, dl long, bucket int, segment int"}

    def _manifest(self) -> tuple[int, list]:
        """The newest finished manifest's number and rows: one a segment, one a deletion."""
        done = [int(f.rpartition("=")[2]) for f in folders(self.spark, f"{self.path}/manifests") if exists(self.spark, f"{f}/_SUCCESS")]
        if not done:
            return -1, []
        return max(done), self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/number={max(done)}").collect()

    def _publish(self, number: int, rows: list) -> None:
        self.spark.createDataFrame([tuple(r) for r in rows], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/number={number}")

    def segments(self) -> list[tuple[int, int]]:
        """``(number, level)`` of what is read."""
        return sorted((r.number, r.level) for r in self._manifest()[1] if r.kind == "segment")

    def _read(self, kind: str, numbers: list[int], buckets: list[int] | None = None) -> DataFrame | None:
        if not numbers:
            return None
        rows = self.spark.read.schema(self.schemas[kind]).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/segment={n}" for n in numbers))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _live(self, rows: DataFrame, manifest: list) -> DataFrame:
        """Rows of documents that no later deletion names."""
        gone = self._read("deleted", [r.number for r in manifest if r.kind == "deleted"])
        if gone is None:
            return rows
        gone = gone.groupBy("doc_id").agg(F.max("segment").alias("gone")).withColumnRenamed("doc_id", "__id")
        return rows.join(gone, (rows.doc_id == gone["__id"]) & (gone.gone >= rows.segment), "left_anti")

    def _write(self, number: int, level: int, rows: DataFrame, docs: DataFrame | None = None) -> tuple:
        """Writes the counted rows as a segment; returns its line of the manifest.  ``docs`` are its documents, where they are known."""
        docs = rows.select("doc_id", "dl").distinct() if docs is None else docs.select("doc_id", "dl")
        docs.write.mode("overwrite").parquet(f"{self.path}/documents/segment={number}")
        sizes = self._read("documents", [number]).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        block = F.concat(F.lit(f"{number}-"), F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sizes.n // BLOCK))).cast("string"))
        parts = rows.where("term is not null").select("doc_id", "dl", "term", "tf", block.alias("block"), bucket("term").alias("bucket"))
        parts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        bounds(self._read("postings", [number])).withColumn("bucket", bucket("term")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/bounds/segment={number}")
        return ("segment", number, level, sizes.n, sizes.words)

    def _gone(self, number: int, ids: DataFrame, manifest: list) -> list[tuple]:
        """Writes the deletion of those of ``ids`` that are held; its line of the manifest, none if there are none."""
        held = self._documents(manifest)
        if held is None:
            return []
        out = cut(held.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "dl"), "gone")
        sizes = out.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
        if not sizes.n:
            return []
        out.select("doc_id").write.mode("overwrite").parquet(f"{self.path}/deleted/segment={number}")
        return [("deleted", number, 0, -sizes.n, -sizes.words)]

    def _documents(self, manifest: list) -> DataFrame | None:
        held = self._read("documents", [r.number for r in manifest if r.kind == "segment"])
        return None if held is None else self._live(held, manifest)

    def add(self, docs: DataFrame) -> None:
        """Writes one segment, and merges eight of a level when there are so many."""
        number, manifest = self._manifest()
        docs = docs.select("doc_id", "text")
        if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # texts are shuffled only where an id is repeated
            docs = docs.dropDuplicates(["doc_id"])
        rows = cut(counted(docs), "added")
        # A deletion counts for segments up to its number, so the segment comes after it.
        gone = self._gone(number + 1, rows, manifest)
        self._publish(number + 2, [*manifest, *gone, self._write(number + 2, 0, rows)])
        self.merge()

    def delete(self, ids: DataFrame) -> None:
        number, manifest = self._manifest()
        self._publish(number + 1, [*manifest, *self._gone(number + 1, ids, manifest)])

    def merge(self, at_least: int = MERGE) -> None:
        """While a level has so many segments, writes what is live in them as one of the next level."""
        while True:
            number, manifest = self._manifest()
            levels: dict[int, list] = {}
            for r in manifest:
                if r.kind == "segment":
                    levels.setdefault(r.level, []).append(r)
            level, many = next(((lv, rs) for lv, rs in sorted(levels.items()) if len(rs) >= at_least), (0, []))
            if not many:
                return
            numbers = [r.number for r in many]
            held, have = (self._live(self._read(kind, numbers), manifest) for kind in ("documents", "postings"))
            new = self._write(number + 1, level + 1, have, held)
            left = [r for r in manifest if r not in many]
            # Deletions still take off what they took from the merged segments, which the new one does not hold.
            docs, total = sum(r.docs for r in many) - new[3], sum(r.words for r in many) - new[4]
            if docs:
                left.append(("merged", number + 1, 0, docs, total))
            self._publish(number + 1, [*left, new])

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, rank, doc_id, score)`` for ``queries`` with ``query_id`` and ``query``."""
        _, manifest = self._manifest()
        numbers = [r.number for r in manifest if r.kind == "segment"]
        n, total = sum(r.docs for r in manifest), sum(r.words for r in manifest)
        asked = cut(questions(queries), "asked")
        buckets = [r.bucket for r in asked.select(bucket("term").alias("bucket")).distinct().collect()]  # BUCKETS at most
        some = asked.select("term").distinct().limit(NAMED + 1).collect()

        def of_terms(rows: DataFrame) -> DataFrame:
            return rows.where(F.col("term").isin([r.term for r in some])) if len(some) <= NAMED else rows.join(asked.select("term").distinct(), "term", "left_semi")

        postings = self._live(of_terms(self._read("postings", numbers, buckets)), manifest)
        limits = of_terms(self._read("bounds", numbers, buckets))
        if any(r.kind == "deleted" for r in manifest):
            postings = cut(postings, "live")  # bounds of what is live, so that no term counts deleted documents
            limits = bounds(postings)
        return pruned_topk(postings, limits, asked, n, total / max(1, n), k)

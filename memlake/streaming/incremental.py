"""Streams: idempotent memorising, bounded buffers, windows, change logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from memlake.functions.ids import hash_id
from memlake.operators.vector_store import latest
from memlake.sources.tables import exists


def table_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def memorize(chunks: DataFrame, path: str, checkpoint: str, text_col: str = "text", prefix: str = "chunk-") -> StreamingQuery:
    """Appends each new text once, by content hash, however often a batch is tried again.

    The stream's state holds the hashes, so a batch costs what it brings, not what
    was stored before; a batch that is tried again writes its folder anew.  A
    folder belongs to its checkpoint: one that was filled under another is refused.
    """
    spark = chunks.sparkSession
    if exists(spark, path) and not exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{path} was filled under another checkpoint")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    new = chunks.withColumn("hash_id", hash_id(F.col(text_col), prefix)).dropDuplicates(["hash_id"])
    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of a folder's sub-folders; none where it does not exist."""
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())


def polled(df: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str, interval: str) -> StreamingQuery:
    """Looks for new rows every ``interval`` until it is stopped, and gives each batch to ``add``."""
    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def windows(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by tumbling or sliding window; ``late`` bounds how late an event may come."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the sink's table, which the driver holds; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_updates(df: DataFrame, path: str, checkpoint: str, keys: list[str] | None) -> DataFrame:
    """Runs a stream over what is there; returns the last update of each key.

    Each batch writes the groups that it changed, so nothing is gathered on the
    driver, and groups behind the watermark leave the state.  Session windows
    have no updates: without keys each batch writes all groups, and the last
    one's are returned.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.foreachBatch(add).outputMode("update" if keys else "complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    if not folders(spark, path):
        return spark.createDataFrame([], batch_schema(df))
    # One scan, however many batches there were; a broken try's folder was written anew.
    rows = spark.read.schema(batch_schema(df).add("batch", "long")).parquet(path)
    if keys:
        return latest(rows, keys, [F.desc("batch")]).drop("batch")
    return rows.where(F.col("batch") == max(int(f.rpartition("=")[2]) for f in folders(spark, path))).drop("batch")


def batch_schema(df: DataFrame) -> T.StructType:
    """The schema that a batch of the stream is read back with."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


BUFFER = "key string, evicted string, held int"


def bounded_buffer(chunks: DataFrame, key: str, order: str, text: str, keep: int) -> DataFrame:
    """Per key the last ``keep`` chunks; emits each chunk that leaves the buffer and how many are held."""

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        new = pd.concat(list(batches)).sort_values(order)
        for t in new[text]:
            held.append(t)
            if len(held) > keep:
                out.append((str(k[0]), held.pop(0)))
        state.update((held,))
        yield pd.DataFrame([(a, b, len(held)) for a, b in out] or [], columns=["key", "evicted", "held"])

    return chunks.groupBy(key).applyInPandasWithState(step, BUFFER, "held array<string>", "append", "NoTimeout")


def rate_limited(requests: DataFrame, limit: int, interval: str = "60 seconds", slide: str = "1 second", ts: str = "ts") -> DataFrame:
    """Sliding windows that hold more requests than allowed."""
    g = requests.groupBy(F.window(ts, interval, slide)).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > limit).select(F.col("window.start").alias("start"), "n")


def change_log(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends change events; ``operators.memory.current`` is the state."""
    return run_to_table(changes, path, checkpoint)


def task_chain(df: DataFrame, *tasks) -> DataFrame:
    """Tasks are functions from DataFrame to DataFrame, run as one plan."""
    for t in tasks:
        df = df.transform(t)
    return df


def batched(c: Column, n: int) -> Column:
    """Arrays of at most ``n`` elements of an array."""
    count = F.ceil(F.size(c) / F.lit(n)).cast("int")
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(c, k * n + 1, F.lit(n)))).otherwise(F.array())

"""Streams over the event and conversation tables, each held against its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.plans.catalog import query
from memlake.scratch import scratch_path
from memlake.sources.tables import table
from memlake.streaming import incremental as S
from memlake.streaming.groups import turn_stream


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema, one = table(spark, d, name).schema, _is_file(spark, d, name)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if one else "*.parquet").parquet(d if one else f"{d}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _is_file(spark: SparkSession, d: str, name: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("SELECT md5(text) AS hash, any_value(text) AS text FROM conversations GROUP BY 1")
def stream_memorize(spark: SparkSession, d: str) -> DataFrame:
    out, mark = scratch_path(spark, "memorize"), scratch_path(spark, "memorize-offsets")
    for _ in range(2):  # the second run finds nothing new
        S.memorize(_stream(spark, d, "conversations").select("text"), out, mark, prefix="").awaitTermination()
    return spark.read.parquet(out).select(F.col("hash_id").alias("hash"), "text")


@query("""SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    w = S.windows(_stream(spark, d, "events"), "1 day")
    return S.run_to_updates(w, scratch_path(spark, "windows"), scratch_path(spark, "windows-offsets"), ["start", "event_type"]).withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT ts, user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.run_to_updates(S.sessions(_stream(spark, d, "events"), "30 minutes"), scratch_path(spark, "sessions"), scratch_path(spark, "sessions-offsets"), None)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) + k * INTERVAL 1 HOUR - INTERVAL 1 HOUR AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL HAVING count(*) > 20")
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Two-hour windows every hour that hold over twenty events."""
    return S.rate_limited(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 20, "2 hours", "1 hour")


@query("SELECT CAST(conv_id AS VARCHAR) AS key, text AS evicted, 3 AS held FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3")
def stream_buffer(spark: SparkSession, d: str) -> DataFrame:
    out, mark = scratch_path(spark, "buffer"), scratch_path(spark, "buffer-offsets")
    S.run_to_table(S.bounded_buffer(_stream(spark, d, "conversations"), "conv_id", "turn", "text", 3), out, mark).awaitTermination()
    return spark.read.schema(S.BUFFER).parquet(out)


@query("""SELECT conv_id, lag(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS first, turn AS last, 3 AS messages, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no
    FROM conversations QUALIFY turn_no % 3 = 0""")
def stream_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every third message of a conversation triggers, with the three that came since the last; a second run finds nothing new."""
    out, mark = scratch_path(spark, "turns"), scratch_path(spark, "turns-offsets")
    for _ in range(2):
        S.run_to_table(turn_stream(_stream(spark, d, "conversations"), "conv_id", "turn", 3), out, mark).awaitTermination()
    return spark.read.schema("conv_id long, first long, last long, messages long, turn_no long").parquet(out)

"""Queries over rows with cursors, logs and states: listing, memories, blocks, messages, usage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators import listing as L, memory as M
from memlake.operators.graph import first_of
from memlake.operators.vector_store import latest
from memlake.plans.catalog import query
from memlake.sources.tables import table


@query("""SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
    WHERE o_orderstatus IN ('O', 'F') AND (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01', 0) ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def list_keyset(spark: SparkSession, d: str) -> DataFrame:
    spec = L.Listing(order=("o_orderdate", "o_orderkey"), filters={"o_orderstatus": ["O", "F"]}, after=(datetime(1995, 6, 1), 0), limit=50)
    return L.list_rows(table(spark, d, "orders"), spec).select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("""SELECT o_orderkey, o_orderdate FROM orders
    WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01', 1) AND o_orderdate >= TIMESTAMP '1994-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def list_keyset_descending(spark: SparkSession, d: str) -> DataFrame:
    spec = L.Listing(order=("o_orderdate", "o_orderkey"), after=(datetime(1996, 1, 1), 1), ascending=False, limit=20, date_col="o_orderdate", start=datetime(1994, 1, 1), inclusive=True)
    return L.list_rows(table(spark, d, "orders"), spec).select("o_orderkey", "o_orderdate")


@query("""
    WITH w AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders
               WHERE (o_orderdate > TIMESTAMP '1995-01-01' OR (o_orderdate = TIMESTAMP '1995-01-01' AND o_orderkey > 0)) AND (o_orderdate < TIMESTAMP '1995-02-01' OR (o_orderdate = TIMESTAMP '1995-02-01' AND o_orderkey < 0)) QUALIFY n <= 20),
    c AS (SELECT (count(*) - 10) // 2 AS skip FROM w)
    SELECT o_orderkey FROM w, c WHERE n > greatest(skip, 0) AND n <= greatest(skip, 0) + 10""")
def list_between(spark: SparkSession, d: str) -> DataFrame:
    spec = L.Listing(order=("o_orderdate", "o_orderkey"), after=(datetime(1995, 1, 1), 0), before=(datetime(1995, 2, 1), 0), limit=10)
    return L.list_rows(table(spark, d, "orders"), spec).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return L.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 25)


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' AND event_type = 'click'")
def list_date_range_exclusive(spark: SparkSession, d: str) -> DataFrame:
    spec = L.Listing(filters={"event_type": "click"}, date_col="ts", start=datetime(2024, 1, 5), end=datetime(2024, 1, 6))
    return L.matching(table(spark, d, "events"), spec).select("event_id", "ts")


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') AND role IN ('user', 'assistant')")
def list_text_search(spark: SparkSession, d: str) -> DataFrame:
    spec = L.Listing(filters={"role": ["user", "assistant"]}, text_col="text", text="The")
    return L.matching(table(spark, d, "conversations"), spec).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND text ILIKE '%and%'")
def list_content_parts(spark: SparkSession, d: str) -> DataFrame:
    """Messages as arrays of typed parts; any text part may hold the words."""
    parts = table(spark, d, "conversations").withColumn("content", F.array(F.struct(F.col("role").alias("type"), F.col("text")), F.struct(F.when(F.col("role") == "user", "text").otherwise("tool").alias("type"), F.col("text"))))
    return L.content_contains(parts, "content", "and").select("conv_id", "turn")


@query("SELECT conv_id FROM conversations WHERE role IN ('system', 'assistant') GROUP BY conv_id HAVING count(DISTINCT role) = 2")
def tags_match_all(spark: SparkSession, d: str) -> DataFrame:
    return L.having_all(table(spark, d, "conversations"), "conv_id", "role", ["system", "assistant"])


@query("SELECT DISTINCT conv_id FROM conversations WHERE role IN ('system', 'tool')")
def tags_match_any(spark: SparkSession, d: str) -> DataFrame:
    return L.having_any(table(spark, d, "conversations"), "conv_id", "role", ["system", "tool"])


@query("SELECT DISTINCT p_type FROM part WHERE p_type ILIKE '%a%' AND p_type > 'B' ORDER BY 1 LIMIT 20")
def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return L.distinct_values(table(spark, d, "part"), "p_type", like="a", after="B", limit=20)


@query("""SELECT DISTINCT ts AS created_at, CAST(user_id AS VARCHAR) AS user, event_type AS text FROM events WHERE event_type IN ('search', 'view', 'click', 'purchase')
    ORDER BY created_at, user, text LIMIT 100""")
def history_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("text"))
    return L.history(e.where(F.col("text").isin("search", "view")), e.where(F.col("text").isin("click", "purchase")), 100)


@query("""SELECT doc_id, NULL AS conv_id, text, source, 'source' AS kind FROM documents
    UNION ALL SELECT NULL, conv_id, text, NULL, 'agent' FROM conversations WHERE role <> 'system'""")
def passages_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", "text", "source", F.lit("source").alias("kind"))
    b = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "text", F.lit("agent").alias("kind"))
    return L.union_passages(a, b).select("doc_id", "conv_id", "text", "source", "kind")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT coalesce(sum(event_id % 97), 0)::BIGINT AS prompt_tokens, coalesce(sum(event_id % 31), 0)::BIGINT AS completion_tokens,
    coalesce(sum(event_id % 97 + event_id % 31), 0)::BIGINT AS total_tokens, count(*) AS steps FROM events WHERE event_type = 'click'""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 97).alias("prompt_tokens"), (F.col("event_id") % 31).alias("completion_tokens")).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return L.usage(e, event_type="click")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value >= 1.0 AND value <= 50.0")
def filtered_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(L.size(table(spark, d, "events"), {"event_type": "click", "value": {"gte": 1.0, "lte": 50.0}, "props": None}),)], "n long")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change log: a user's memory per event type is added, then updated, and deleted on every seventh event."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("memory_id"), F.col("props").alias("memory"), F.col("ts").alias("at"))
    n = F.row_number().over(W.partitionBy("memory_id").orderBy("seq"))
    return e.withColumn("event", F.when(n == 1, "ADD").when(n % 7 == 0, "DELETE").when(n % 7 == 1, "ADD").otherwise("UPDATE"))


_LOG = """l AS (SELECT event_id AS seq, user_id || '-' || event_type AS memory_id, props AS memory, ts AS "at", row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
    e AS (SELECT *, CASE WHEN n = 1 THEN 'ADD' WHEN n % 7 = 0 THEN 'DELETE' WHEN n % 7 = 1 THEN 'ADD' ELSE 'UPDATE' END AS event FROM l)"""


@query(f"""WITH {_LOG}, c AS (SELECT memory_id, min("at") FILTER (event = 'ADD') AS created_at FROM e GROUP BY 1),
    s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC) = 1)
    SELECT memory_id, seq, memory, created_at, CASE WHEN event = 'UPDATE' THEN "at" END AS updated_at FROM s JOIN c USING (memory_id) WHERE event <> 'DELETE'""")
def memory_current_state(spark: SparkSession, d: str) -> DataFrame:
    return M.current(_log(spark, d)).select("memory_id", "seq", "memory", "created_at", "updated_at")


@query(f"""WITH {_LOG} SELECT memory_id, seq, event, CASE WHEN event <> 'ADD' THEN lag(memory) OVER (PARTITION BY memory_id ORDER BY seq) END AS old_memory,
    CASE WHEN event <> 'DELETE' THEN memory END AS new_memory, event = 'DELETE' AS is_deleted FROM e""")
def memory_history(spark: SparkSession, d: str) -> DataFrame:
    return M.memory_history(_log(spark, d)).drop("at")


@query("SELECT conv_id || '-' || turn AS memory_id, text AS memory, md5(text) AS hash FROM conversations WHERE role <> 'system'")
def memory_add_raw(spark: SparkSession, d: str) -> DataFrame:
    return M.raw_memories(table(spark, d, "conversations")).select("memory_id", "memory", "hash")


@query("""SELECT user_id AS block_id, event_id AS seq, lag(event_id) OVER w AS undo_to, lead(event_id) OVER w AS redo_to
    FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def block_undo(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("block_id"), F.col("event_id").alias("seq"))
    return M.checkpoint_neighbours(e)


@query("""
    WITH RECURSIVE o AS (SELECT conv_id AS block_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN role = 'user' THEN 'checkpoint' WHEN turn % 4 = 1 THEN 'undo' ELSE 'redo' END AS op, text AS value FROM conversations),
    r(block_id, i, stack, pos) AS (
        SELECT DISTINCT block_id, 0::BIGINT, []::VARCHAR[], 0::BIGINT FROM o
        UNION ALL
        SELECT r.block_id, r.i + 1, CASE WHEN op = 'checkpoint' THEN list_append(stack[1:pos], value) ELSE stack END,
               CASE op WHEN 'checkpoint' THEN pos + 1 WHEN 'undo' THEN greatest(pos - 1, least(pos, 1)) ELSE least(pos + 1, len(stack)) END
        FROM r JOIN o ON o.block_id = r.block_id AND o.i = r.i + 1
    ), e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY i DESC) = 1)
    SELECT block_id, CAST(pos AS INT) AS position, CAST(len(stack) AS INT) AS depth, CASE WHEN pos > 0 THEN stack[pos] END AS value FROM e""")
def block_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a block: user turns checkpoint, the others undo and redo in turn."""
    op = F.when(F.col("role") == "user", "checkpoint").when(F.col("turn") % 4 == 1, "undo").otherwise("redo")
    return M.block_states(table(spark, d, "conversations").select(F.col("conv_id").alias("block_id"), F.col("turn").alias("seq"), op.alias("op"), F.col("text").alias("value")))


_MSG = r"m AS (SELECT conv_id, turn, role, len(regexp_split_to_array(trim(text), '\s+')) AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("tok", F.size(F.split(F.trim("text"), r"\s+")))


@query(f"""WITH {_MSG}, s AS (SELECT *, sum(CASE WHEN i > 0 THEN tok ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far, floor(sum(tok) OVER (PARTITION BY conv_id) * 0.7) AS want FROM m)
    SELECT conv_id, coalesce(min(i) FILTER (i > 0 AND ((role NOT IN ('user', 'tool', 'function') AND so_far >= want) OR n - i - 1 <= 1)), max(i)) + 1 AS cutoff FROM s GROUP BY conv_id""")
def summarizer_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return M.summarizer_cutoff(_tokens(spark, d), "conv_id", "turn", "tok", 0.7, 1).select("conv_id", F.col("cutoff").cast("long").alias("cutoff"))


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def fifo_buffer(spark: SparkSession, d: str) -> DataFrame:
    return M.fifo_buffer(table(spark, d, "conversations"), "conv_id", "turn", 4096, 3 * 4096).select("conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS query FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def tail_query(spark: SparkSession, d: str) -> DataFrame:
    return M.tail_query(table(spark, d, "conversations"), "conv_id", "turn", 6)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations QUALIFY turn_no % 3 = 0")
def turn_triggers(spark: SparkSession, d: str) -> DataFrame:
    return M.turn_triggers(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", F.col("turn_no").cast("long").alias("turn_no"))


@query(rf"WITH {_MSG} SELECT conv_id AS agent_id, role AS category, CAST(sum(tok) AS BIGINT) AS tokens FROM m GROUP BY ROLLUP (conv_id, role) HAVING conv_id IS NOT NULL")
def context_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return M.context_breakdown(_tokens(spark, d).select(F.col("conv_id").alias("agent_id"), F.col("role").alias("category"), F.col("tok").alias("tokens")))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def attached_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.attached(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", o_orderpriority="1-URGENT").select("c_custkey", "c_name")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) k USING (l_orderkey, l_linenumber)")
def composite_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return L.by_keys(li, li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber")), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    return first_of(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT conv_id, turn FROM conversations JOIN (SELECT conv_id, min(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1) USING (conv_id) WHERE turn > last
    UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant')""")
def unprocessed_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return M.unprocessed(c, c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("turn")), "conv_id", "turn").select("conv_id", "turn")

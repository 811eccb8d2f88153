"""Queries over memories and agents: inferred memories, scopes, histories, prompts, caches, permissions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators import listing as L, memory as M
from memlake.plans import pipelines as P
from memlake.plans.catalog import query
from memlake.plans.listing_queries import _LOG, _MSG, _log, _tokens
from memlake.plans.vector_queries import _COS
from memlake.providers import cached_calls, first_sentences, language, request_key
from memlake.sources.tables import table, texts
from memlake.streaming.incremental import batched, task_chain


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """A new fact per benchmark item: the vector of that number without its first components."""
    v, b = table(spark, d, "embeddings"), table(spark, d, "benchmark")
    cut = F.transform("embedding", lambda x, i: F.when(i < F.pmod(F.col("vec_id"), F.lit(4)) * 16, 0.0).otherwise(x.cast("double")))
    return v.join(b, v.vec_id == b.item_id).select(F.col("vec_id").alias("fact_id"), F.col("label").cast("string").alias("user_id"), cut.alias("vector"), (F.col("vec_id") % 8 == 1).alias("negates"))


@query(f"""
    WITH f AS (SELECT vec_id AS fact_id, label, list_transform(embedding, lambda x, i: CASE WHEN i <= (vec_id % 4) * 16 THEN 0.0 ELSE x::DOUBLE END) AS v FROM embeddings JOIN benchmark ON item_id = vec_id),
    s AS (SELECT fact_id, vec_id AS memory_id, round({_COS.format('e.embedding', 'f.v')}, 6) AS s FROM f JOIN embeddings e USING (label)),
    n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY s DESC, memory_id) = 1)
    SELECT fact_id, CASE WHEN s >= 0.7 AND fact_id % 8 = 1 THEN 'DELETE' WHEN s >= 0.95 THEN 'NONE' WHEN s >= 0.7 THEN 'UPDATE' ELSE 'ADD' END AS event, CASE WHEN s >= 0.7 THEN CAST(memory_id AS VARCHAR) END AS memory_id
    FROM f LEFT JOIN n USING (fact_id)""")
def memory_inferred(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each new fact, by the nearest of its user's five most similar memories."""
    memories = table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").cast("string").alias("user_id"), F.col("embedding").alias("vector"))
    facts = _facts(spark, d)
    return M.decide(facts, M.similar_memories(facts, memories, 5), negates=F.col("negates")).withColumn("memory_id", F.col("memory_id").cast("string"))


@query(f"""WITH {_LOG}, s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC) = 1)
    SELECT memory_id, memory FROM s WHERE event <> 'DELETE' AND memory_id NOT LIKE '8-%'""")
def memory_delete_all(spark: SparkSession, d: str) -> DataFrame:
    """A user's memories are deleted by events of their own; the log keeps its history."""
    log = _log(spark, d).withColumn("user_id", F.substring_index("memory_id", "-", 1))
    mine = M.scoped(M.current(log), user_id="8", agent_id=None).select(*log.columns)
    return M.current(log.unionByName(M.tombstones(mine, 1 << 40, datetime(2025, 1, 1)).select(*log.columns))).select("memory_id", "memory")


@query("SELECT event_id AS id, user_id || '' AS memory_id, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS old_memory, props AS new_memory, event_type AS event, ts AS created_at, CAST(event_type = 'error' AS INT) AS is_deleted FROM events")
def migrated_history(spark: SparkSession, d: str) -> DataFrame:
    """History rows of an older layout under today's names."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    prev = F.lag("props").over(W.partitionBy("user_id").orderBy("event_id"))
    old = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("memory_id"), prev.alias("prev_value"), F.col("props").alias("new_value"), F.col("event_type").alias("event"), F.col("ts").alias("timestamp"), (F.col("event_type") == "error").alias("is_deleted"))
    return M.migrated_history(old).select("id", "memory_id", "old_memory", "new_memory", "event", "created_at", "is_deleted")


_FIRST = r"regexp_split_to_array(trim(replace(t, chr(10), ' ')), '[.!?]\s+')[1]"


@query(r"""
    WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT 'agent-' || conv_id AS agent_id, 'ADD' AS event, md5('|' || regexp_extract(trim(t), '^((?s).*?[.!?])(?:\s|$)', 1)) AS memory_id FROM t WHERE regexp_matches(trim(t), '[.!?](\s|$)')""")
def procedural_memory(spark: SparkSession, d: str) -> DataFrame:
    """What an agent did, as one memory of the summary of its messages."""
    t = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    t = t.where(F.trim("t").rlike(r"[.!?](\s|$)"))
    facts = t.select(first_sentences(1)(F.col("t")).alias("memory"), F.lit(None).cast("string").alias("user_id"), F.concat(F.lit("agent-"), F.col("conv_id").cast("string")).alias("agent_id"))
    events = M.add_events(facts.select("memory", "user_id").distinct())
    return facts.join(events.select("memory", "event", "memory_id"), "memory").select("agent_id", "event", "memory_id")


@query(rf"""WITH {_MSG}, s AS (SELECT *, sum(CASE WHEN i > 0 THEN tok ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far, floor(sum(tok) OVER (PARTITION BY conv_id) * 0.7) AS want FROM m),
    c AS (SELECT conv_id, coalesce(min(i) FILTER (i > 0 AND ((role NOT IN ('user', 'tool', 'function') AND so_far >= want) OR n - i - 1 <= 1)), max(i)) + 1 AS cutoff FROM s GROUP BY conv_id)
    SELECT conv_id, turn, role, text FROM conversations JOIN m USING (conv_id, turn, role) JOIN c USING (conv_id) WHERE i = 0 OR i >= cutoff
    UNION ALL SELECT conv_id, turn, 'summary', 'about ' || conv_id FROM m WHERE i = 1""")
def messages_summarized(spark: SparkSession, d: str) -> DataFrame:
    """The evicted messages of each conversation give way to a summary."""
    t = _tokens(spark, d)
    cutoffs = M.summarizer_cutoff(t, "conv_id", "turn", "tok", 0.7, 1)
    summaries = t.select("conv_id").distinct().select("conv_id", F.concat(F.lit("about "), F.col("conv_id").cast("string")).alias("summary"))
    return M.summarized(table(spark, d, "conversations"), cutoffs, summaries, "conv_id", "turn")


@query("SELECT (SELECT count(*) FROM conversations) AS recall, (SELECT count(*) FROM documents) AS archival, (SELECT max(ts) FROM events) AS last_edit")
def memory_metadata(spark: SparkSession, d: str) -> DataFrame:
    return P.metadata_block(table(spark, d, "conversations"), table(spark, d, "documents"), table(spark, d, "events").select(F.col("ts").alias("updated_at")))


@query("""SELECT conv_id, 'You remember:' || chr(10) || string_agg('<' || role || '>' || chr(10) || n || chr(10) || '</' || role || '>', chr(10) ORDER BY role) || chr(10) || '{OTHER}' AS prompt
    FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled blocks put into a system prompt."""
    blocks = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").cast("string").alias("value")).withColumnRenamed("role", "label")
    return P.system_prompt(blocks, "conv_id", "You remember:\n{CORE_MEMORY}\n{OTHER}")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 2")
def last_messages(spark: SparkSession, d: str) -> DataFrame:
    return L.last_n(table(spark, d, "conversations"), ["conv_id", "role"], "turn", 2).select("conv_id", "turn", "role")


@query("""WITH l AS (SELECT conv_id, list(turn ORDER BY turn) AS ts FROM conversations WHERE role <> 'system' GROUP BY conv_id), k AS (SELECT conv_id, ts, unnest(range((len(ts) + 2) // 3)) AS k FROM l)
    SELECT conv_id, CAST(k AS INT) AS batch, array_to_string(ts[k * 3 + 1 : k * 3 + 3], ',') AS turns FROM k""")
def batched_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A chain of tasks as one plan: filter, gather, cut into batches."""
    return task_chain(
        table(spark, d, "conversations"),
        lambda df: df.where("role <> 'system'"),
        lambda df: df.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("ts")),
        lambda df: df.select("conv_id", F.posexplode(batched(F.col("ts"), 3)).alias("batch", "turns")),
        lambda df: df.withColumn("turns", F.array_join("turns", ",")),
    )


@query("""SELECT sha256('{"role":"' || role || '","turn":' || turn || '}') AS key, count(*) AS asked, upper(role) || turn AS response FROM conversations GROUP BY role, turn""")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each different request is answered once; what is cached is not asked for."""
    t = table(spark, d, "conversations").select("role", "turn", request_key(F.col("role"), F.col("turn")).alias("key"))
    call = lambda rows: rows.select("key", F.concat(F.upper("role"), F.col("turn").cast("string")).alias("response"))
    cache = call(t.where("role = 'user'").dropDuplicates(["key"]))
    return cached_calls(t, cache, call)[0].groupBy("key", "response").agg(F.count("*").alias("asked"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def permitted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a user may read; without a grant for each of them reading fails."""
    docs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    grants = table(spark, d, "orders").select(F.lit("u").alias("user_id"), F.col("o_orderkey").alias("document_id"), F.lit("read").alias("permission"))
    try:
        P.permitted(docs, grants, "u", "write")
    except PermissionError:
        return P.permitted(docs, grants, "u", "read").select(F.col("document_id").alias("o_orderkey"))
    raise AssertionError("no write was granted")


_MARKS = {"en": "the and of", "fr": "le la et", "de": "der und die", "es": "el los y"}


@query(
    "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, "
    + ", ".join("len(list_filter(ws, lambda x: x IN ({}))) AS {}".format(", ".join(f"'{m}'" for m in marks.split()), lang) for lang, marks in _MARKS.items())
    + " FROM w) SELECT doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS language FROM c"
)
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages by their frequent words, as an offline stand-in for a model."""
    return texts(spark, d, "documents").select("doc_id", language(F.col("text")).alias("language"))

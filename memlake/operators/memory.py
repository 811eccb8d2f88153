"""Memories as an append-only event log; the current state is a view of it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake.functions.ids import hash_id
from memlake.functions.vectors import dot, norm, normalized
from memlake.operators.bm25 import ranked
from memlake.operators.vector_store import latest

SCOPE = ("user_id", "agent_id", "run_id")
EVENT = "seq long, memory_id string, event string, memory string, user_id string, agent_id string, run_id string, at timestamp"


def scoped(df: DataFrame, **scope: str | None) -> DataFrame:
    """Rows of a scope; at least one of user, agent and run must be given."""
    given = {k: v for k, v in scope.items() if v is not None}
    if not given.keys() & set(SCOPE):
        raise ValueError(f"one of {', '.join(SCOPE)} is needed")
    for k, v in given.items():
        df = df.where(F.col(k) == v)
    return df


def raw_memories(messages: DataFrame) -> DataFrame:
    """One memory per message that is not the system's: ``(memory_id, memory, hash)`` beside the message's columns."""
    m = messages.where(F.col("role") != "system")
    return m.select("*", F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.col("text").alias("memory"), F.md5("text").alias("hash"))


def add_events(facts: DataFrame, start_seq: int = 0) -> DataFrame:
    """ADD events for ``(memory, user_id, ...)`` rows; equal texts of a user are one memory.

    Sequence numbers are unique and rising within a partition, so none has to
    see all rows.
    """
    one = facts.withColumn("memory_id", hash_id(F.concat_ws("|", F.coalesce("user_id", F.lit("")), "memory"))).dropDuplicates(["memory_id"])
    return one.withColumn("event", F.lit("ADD")).withColumn("seq", F.lit(start_seq) + 1 + F.monotonically_increasing_id())


def similar_memories(facts: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """``(fact_id, memory_id, similarity)``: the ``k`` most similar memories of each fact's user, each memory once."""
    asked = facts.where(norm("vector") > 0).select("fact_id", "user_id", normalized(F.col("vector")).alias("q"))
    known = memories.where(norm("vector") > 0).select("memory_id", "user_id", normalized(F.col("vector")).alias("v"))
    pairs = asked.join(known, "user_id").where(F.size("v") == F.size("q")).select("fact_id", "memory_id", dot(F.col("v"), F.col("q")).alias("similarity"))
    best = pairs.groupBy("fact_id", "memory_id").agg(F.max("similarity").alias("similarity"))
    return ranked(best, k, query="fact_id", score="similarity", tie="memory_id").drop("rank")


def decide(facts: DataFrame, similar: DataFrame, same: float = 0.95, close: float = 0.7, negates: Column | None = None) -> DataFrame:
    """Offline stand-in for the model's decision: ``(fact_id, event, memory_id)``.

    A fact is DELETE of the nearest close memory that it negates, NONE if a
    neighbour is almost the same, UPDATE of the nearest close one, else ADD.
    ``similar`` has ``(fact_id, memory_id, similarity)``; of equally similar
    memories the smallest counts.
    """
    nearest = F.min_by("memory_id", F.struct((-F.col("similarity")).alias("far"), "memory_id"))
    best = similar.groupBy("fact_id").agg(nearest.alias("memory_id"), F.max("similarity").alias("s"))
    out = facts.withColumn("__negates", F.lit(False) if negates is None else negates).join(best, "fact_id", "left")
    event = F.when((F.col("s") >= close) & F.col("__negates"), "DELETE").when(F.col("s") >= same, "NONE").when(F.col("s") >= close, "UPDATE").otherwise("ADD")
    return out.select("fact_id", event.alias("event"), F.when(event != "ADD", F.col("memory_id")).alias("memory_id"))


def current(events: DataFrame) -> DataFrame:
    """The latest state of each memory that is not deleted, with when it was created and updated."""
    created = events.groupBy("memory_id").agg(F.min(F.when(F.col("event") == "ADD", F.col("at"))).alias("created_at"))
    last = latest(events, ["memory_id"], [F.desc("seq")]).where("event <> 'DELETE'")
    return last.join(created, "memory_id").withColumn("updated_at", F.when(F.col("event") == "UPDATE", F.col("at")))


def memory_history(events: DataFrame) -> DataFrame:
    """Each event with the memory before it, in order of ``seq`` (update times are null for adds and deletes)."""
    w = W.partitionBy("memory_id").orderBy("seq")
    return events.select("memory_id", "seq", "event", F.when(F.col("event") != "ADD", F.lag("memory").over(w)).alias("old_memory"), F.when(F.col("event") != "DELETE", F.col("memory")).alias("new_memory"), "at", (F.col("event") == "DELETE").alias("is_deleted"))


def tombstones(state: DataFrame, start_seq: int, at) -> DataFrame:
    """DELETE events for all given memories."""
    return state.withColumn("event", F.lit("DELETE")).withColumn("seq", F.lit(start_seq) + 1 + F.monotonically_increasing_id()).withColumn("at", F.lit(at))


def migrated_history(old: DataFrame) -> DataFrame:
    """History rows of the older layout under today's names."""
    return old.select("id", "memory_id", F.col("prev_value").alias("old_memory"), F.col("new_value").alias("new_memory"), F.col("new_value"), "event", F.col("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("is_deleted").cast("int").alias("is_deleted"))


# --- blocks -----------------------------------------------------------------


def block_states(ops: DataFrame) -> DataFrame:
    """Checkpoints that survive: a new one drops what undo had left ahead of it.

    ``ops`` has ``(block_id, seq, op, value)`` with op ``checkpoint``, ``undo``
    or ``redo``; the fold runs over each block's short list of operations.
    Returns ``(block_id, position, depth, value)``: the pointer, the length of
    its stack, and the current value (null before the first checkpoint).
    """
    state = "struct<stack: array<string>, at: int>"
    start = F.from_json(F.lit('{"stack": [], "at": 0}'), state)

    def step(s, o):
        kept = F.slice(s["stack"], F.lit(1), s["at"])
        put = F.struct(F.concat(kept, F.array(o["value"])).alias("stack"), (s["at"] + 1).alias("at"))
        back = F.struct(s["stack"].alias("stack"), F.greatest(s["at"] - 1, F.least(s["at"], F.lit(1))).alias("at"))
        on = F.struct(s["stack"].alias("stack"), F.least(s["at"] + 1, F.size(s["stack"])).alias("at"))
        return F.when(o["op"] == "checkpoint", put).when(o["op"] == "undo", back).otherwise(on)

    listed = ops.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "value"))).alias("ops"))
    done = listed.select("block_id", F.aggregate("ops", start, step).alias("s"))
    return done.select("block_id", F.col("s.at").alias("position"), F.size("s.stack").alias("depth"), F.try_element_at("s.stack", F.when(F.col("s.at") > 0, F.col("s.at")).otherwise(F.lit(2147483647))).alias("value"))


def checkpoint_neighbours(checkpoints: DataFrame) -> DataFrame:
    """Each checkpoint with the one before and the one after it."""
    w = W.partitionBy("block_id").orderBy("seq")
    return checkpoints.select("block_id", "seq", F.lag("seq").over(w).alias("undo_to"), F.lead("seq").over(w).alias("redo_to"))


# --- messages ---------------------------------------------------------------


def summarizer_cutoff(messages: DataFrame, by: str, order: str, tokens: str, share: float = 0.7, keep_last: int = 0) -> DataFrame:
    """``(by, cutoff)``: how many messages a summary replaces.

    The first message is the system's and is passed over; from the second on,
    messages are taken until their tokens reach ``share`` of all and the role is
    neither user nor tool, or only ``keep_last`` would be left.  The share is taken
    in decimals: seven tenths of 90 are 63.
    """
    w = W.partitionBy(by).orderBy(order)
    whole = W.partitionBy(by)
    m = messages.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)).withColumn("want", F.floor(F.sum(tokens).over(whole) * F.lit(Decimal(str(share)))))
    m = m.withColumn("so_far", F.sum(F.when(F.col("i") > 0, F.col(tokens)).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    enough = ~F.col("role").isin("user", "tool", "function") & (F.col("so_far") >= F.col("want"))
    stop = F.when((F.col("i") > 0) & (enough | (F.col("n") - F.col("i") - 1 <= keep_last)), F.col("i"))
    return m.groupBy(by).agg((F.coalesce(F.min(stop), F.max("i")) + 1).alias("cutoff"))


def fifo_buffer(chunks: DataFrame, by: str, order: str, chunk_size: int, limit: int) -> DataFrame:
    """Chunks still held after all were added: the youngest whose nominal sizes fit the limit."""
    keep = max(1, limit // chunk_size)
    w = W.partitionBy(by).orderBy(F.desc(order))
    return chunks.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def summarized(messages: DataFrame, cutoffs: DataFrame, summaries: DataFrame, by: str, order: str) -> DataFrame:
    """Messages with each evicted run replaced by its summary, the system's kept."""
    m = messages.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).join(cutoffs, by)
    left = m.where("i = 0 or i >= cutoff").select(by, order, "role", "text")
    s = summaries.join(m.where("i = 1").select(by, order), by).select(by, order, F.lit("summary").alias("role"), F.col("summary").alias("text"))
    return left.unionByName(s)


def context_breakdown(parts: DataFrame) -> DataFrame:
    """``(agent_id, category, tokens)`` with a total row per agent."""
    return parts.rollup("agent_id", "category").agg(F.sum("tokens").alias("tokens")).where("agent_id is not null")


def tail_query(messages: DataFrame, by: str, order: str, n: int = 6) -> DataFrame:
    """The last ``n`` messages as one ``role: text`` query."""
    w = W.partitionBy(by).orderBy(F.desc(order))
    m = messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return m.groupBy(by).agg(F.array_join(lines, "\n").alias("query"))


def turn_triggers(messages: DataFrame, by: str, order: str, every: int) -> DataFrame:
    """Messages at which a group's turn counter starts over."""
    return messages.withColumn("turn_no", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("turn_no") % every == 0)


def unprocessed(messages: DataFrame, offsets: DataFrame, by: str, order: str) -> DataFrame:
    """Messages behind each group's last processed one."""
    o = offsets.select(by, F.col(order).alias("__last"))
    return messages.join(o, by, "left").where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")

"""Exact dedup by distributed MSD radix partitioning.

Documents start in one group.  Each level splits every group by its documents'
next bytes; a group is finished when it has one document or its documents have
ended.  The bytes themselves are the keys, so equality needs no digest.  The
number of bytes a level takes grows eightfold, so the levels grow with the
logarithm of the longest text, and only documents that still share their whole
prefix with another one go on to the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.llm.scratch import discard, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = 32, growth: int = 8) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]``
    becomes one space.  A null text counts as empty.  The smallest id of a group
    stays; a null id counts as larger than any other, and stays (as null) only
    where a group has no other.  Each row that bears the kept id is marked
    ``kept``, so rows that repeat both id and text all are; an id may stand for
    several texts, which are groups of their own.  An empty table gives an empty
    result.  Other columns are ignored.

    A group is named by its row in the written table of its level's groups, so
    no two groups share a name.  Its key is counted with map-side combine, and
    the counts are joined back by a merge join at every size, so adaptive
    execution can split a hot group.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"))
    rows = rows.select("id", F.lit(0).cast("long").alias("gid"), F.sha2("norm", 256).alias("sha"), F.encode("norm", "UTF-8").alias("rest"))

    done, width = [], first_width
    while True:
        keyed = rows.select("id", "gid", "sha", F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = keyed.groupBy("gid", "digit", "ended").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
        table = written(groups.withColumn("name", F.monotonically_increasing_id()), "radix-groups")
        groups = table.select(*(F.col(c).alias(f"g_{c}") for c in ("gid", "digit", "ended", "n", "low", "name")))
        split = keyed.join(groups.hint("merge"), (keyed.gid == groups.g_gid) & (keyed.digit == groups.g_digit) & (keyed.ended == groups.g_ended), "left")
        alone = F.col("g_n").isNull()
        over = F.col("ended") | alone
        level = written(
            split.select("id", "sha", F.col("g_name").alias("gid"), F.when(alone, F.col("id")).otherwise(F.col("g_low")).alias("low"), F.coalesce("g_n", F.lit(1)).alias("n"), over.alias("done"), F.when(~over, F.col("rest")).alias("rest")),
            "radix-level",
        )
        discard(table)
        done.append(level.where("done").select("id", "low", "n", "sha"))
        rows, width = level.where("not done").select("id", "gid", "sha", "rest"), width * growth
        if rows.isEmpty():
            break

    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.select(F.col("id").alias(id_col), F.col("low").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("low")).alias("kept"), F.col("sha").alias("text_sha256"))

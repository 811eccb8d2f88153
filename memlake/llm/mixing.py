"""Mixing sources to target weights with a low-discrepancy schedule.

Slot ``s`` of the mix draws the golden-ratio point ``frac(s * phi)``; the point
falls into one source's share of the cumulative targets.  Slots are ranked per
source, and rank ``r`` takes block ``r mod n`` of that source, whose documents
are shuffled and cut into blocks of equal token counts.  DataFrame functions
only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from memlake.llm.salting import NUMBER, SALT, salted
from memlake.llm.scratch import written

#: Fractional parts of the golden ratio and of 2**20 times it.
PHI, PHI_20 = 0.6180339887498949, 0.607787409740351


def word_count(text_col: str):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null and empty."""
    gaps = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(gaps).cast("long") - F.length(F.translate(gaps, "w", "")).cast("long")


def target_sizes(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """Targets of ``(source, source_size)`` rows: weights 1, 2, 3, repeating, by code point with null last.

    The targets share the total size by weight; none is above ``cap`` times its
    source's size, and what a capped source leaves is reshared by weight.  Done
    in closed form: in the order of size over weight, source ``k`` is capped if
    the level left by all smaller ones is above its own.  One row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    w = w.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    w = w.withColumn("nth", F.row_number().over(by_ratio))
    w = w.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    # The first source in this order that stays within its limit sets the level of itself and all after it.
    w = w.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("nth", "level"))).over(whole))
    capped = F.col("open").isNull() | (F.col("nth") < F.col("open.nth"))
    return w.select("source", "source_size", "weight", F.when(capped, F.col("limit")).otherwise(F.col("open.level") * F.col("weight")).alias("target"))


def mix_schedule(targets: DataFrame, block: int, bins: int = 4096) -> DataFrame:
    """``(slot, sid, rank, block, taken)``: which block of which source fills each slot.

    ``targets`` has ``sid``, ``source_size``, ``want`` (whole words) and the share
    bounds ``lo`` and ``hi``.  A source's ranks end where its target is reached,
    the last block being taken in part; ranks that the schedule's discrepancy
    left out (a few per source) follow at its end.
    """
    spark = targets.sparkSession
    size, want = F.col("source_size"), F.col("want")
    t = targets.where("want > 0").withColumn("n_blocks", F.ceil(size / F.lit(block)))
    quota = F.floor(want / size) * F.col("n_blocks") + F.ceil((want - F.floor(want / size) * size) / F.lit(block))
    t = written(t.withColumn("quota", quota.cast("long")), "mix-sources")
    slots = t.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    run = max(1024, math.isqrt(slots))
    s = spark.range(0, slots, 1, max(1, slots // 500_000)).withColumnRenamed("id", "slot")
    # In two parts, so that no product has more digits before the point than a double can spare.
    high, low = F.shiftright("slot", 20), F.col("slot").bitwiseAND(F.lit((1 << 20) - 1))
    s = s.withColumn("x", F.pmod(high * F.lit(PHI_20) + low * F.lit(PHI) + F.lit(0.5), F.lit(1.0))).withColumn("run", F.floor(F.col("slot") / run))
    # A point finds its source by its bin of the unit interval, then by the exact bounds.
    top = F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1))
    bounds = t.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.greatest(top, F.floor(F.col("lo") * bins)))).alias("bin"))
    drawn = s.withColumn("bin", F.floor(F.col("x") * bins)).join(bounds, "bin").where("x >= lo and x < hi").select("slot", "run", "sid")
    # Rank per source in two steps: within a run of slots, then over the runs' counts.
    counts = drawn.groupBy("sid", "run").agg(F.count("*").alias("c"))
    offsets = counts.select("sid", "run", (F.sum("c").over(W.partitionBy("sid").orderBy("run")) - F.col("c")).alias("offset"))
    ranked = drawn.withColumn("k", F.row_number().over(W.partitionBy("sid", "run").orderBy("slot"))).join(offsets, ["sid", "run"])
    ranked = ranked.select("slot", "sid", (F.col("offset") + F.col("k") - 1).alias("rank"))
    short = t.join(counts.groupBy("sid").agg(F.sum("c").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    tail = short.select(F.lit(slots).alias("slot"), "sid", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    full = ranked.unionByName(tail).join(t, "sid").where("rank < quota")
    b = F.pmod("rank", "n_blocks")
    before = F.floor(F.col("rank") / F.col("n_blocks")) * size + b * block
    return full.select("slot", "sid", "rank", b.alias("block"), F.least(F.lit(block), size - b * block, want - before).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 512, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts the words that the mix takes of the document, repeats
    included: at most ``cap`` times its size, and each source's sum is its target
    to the word.  Null and empty texts have size 0 and are never taken; a null
    source is a source of its own; rows that repeat an id are rows of their own;
    an empty table gives an empty result.  The shuffle is a hash of id, text
    size and seed, so reruns agree; rows that agree in id, source and size are
    told apart by their number, so they do not fall into one bucket, and may
    change places with each other.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    ids = written(ids.withColumn(NUMBER, F.monotonically_increasing_id()), "mix-sizes")
    sizes = written(ids.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-totals")
    targets = target_sizes(sizes.select("source", "source_size"), cap)
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0)
    t = targets.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))).withColumn("want", F.least(F.round("target").cast("long"), (F.col("source_size") * cap).cast("long")))
    t = t.withColumn("sum", F.sum("want").over(everything)).withColumn("hi", F.coalesce(F.sum("want").over(upto) / F.col("sum"), F.lit(0.0)))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0.0)))
    t = written(t, "mix-targets")

    keyed = salted(ids, ["id", "source", "size"]).withColumn("key", F.xxhash64("id", "size", SALT, F.lit(seed)))
    with_sid = keyed.join(t.select(F.col("source").alias("t_source"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", NUMBER)
    # Shuffled order within a source, and each document's first word there: sums over buckets of
    # the hash first, then within a bucket, so no task holds a whole source.
    n = ids.count()
    buckets = max(1, n // max(1000, math.isqrt(n)))
    with_sid = with_sid.withColumn("bucket", F.floor(F.shiftrightunsigned("key", 1) / F.lit(2.0**63) * buckets))
    per = with_sid.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    offsets = per.select("sid", "bucket", (F.sum("s").over(W.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("offset"))
    within = W.partitionBy("sid", "bucket").orderBy(F.shiftrightunsigned("key", 1), "key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = with_sid.withColumn("upto", F.sum("size").over(within)).withColumn("row", F.count("*").over(within))
    placed = placed.join(offsets, ["sid", "bucket"]).withColumn("end", F.col("offset") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    placed = written(placed.select("id", "source", "size", "sid", "bucket", "row", "source_size", "target", "start", "end"), "mix-placed")

    uses = mix_schedule(t, block).groupBy("sid", "block", "taken").agg(F.count("*").alias("times"))
    pieces = placed.where("size > 0").select("sid", "bucket", "row", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    hit = pieces.join(uses, ["sid", "block"])
    first = F.col("block") * block
    words = F.greatest(F.lit(0), F.least("end", first + F.col("taken")) - F.greatest("start", first))
    taken = hit.groupBy("sid", "bucket", "row").agg(F.sum(words * F.col("times")).alias("taken"))
    return placed.join(taken, ["sid", "bucket", "row"], "left").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

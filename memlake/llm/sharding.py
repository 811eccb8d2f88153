"""Sharding by a hypergeometric communication matrix.

A uniform shuffle sends a random number of a partition's rows to each shard.
Those numbers are drawn first, exactly as the shuffle would have them: a matrix
whose rows sum to the partitions' sizes and whose columns sum to the shards'.
Then each partition permutes its rows and cuts them by its row of the matrix,
rows are exchanged, and each shard permutes what it got.  Every order of all rows
is equally likely, and shard sizes are exact.

The matrix is never held anywhere.  Partitions are the leaves of a binary tree;
a node draws how much of each shard its left half gets, with a generator of its
own, so each partition finds its row alone, along its path from the root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from memlake.llm.salting import NUMBER, SALT, salted
from memlake.llm.scratch import discard, written

#: NumPy draws from populations below this.
POPULATION = 10**9
CARRY = "__carry"


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, population: int = POPULATION) -> int:
    """How many of ``sample`` draws without replacement are good, for populations of any size.

    Think of all items as uniform numbers of which the smallest are drawn.  For
    a large population, one order statistic of the good ones is drawn (beta), and
    how many bad ones lie below it (binomial); what is left to decide is the
    same question about a few items around there.
    """
    if good + bad < population:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    if 2 * sample > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - sample, population)
    if not good or not bad:
        return sample if good else 0
    if sample <= 64:
        got = 0
        for k in range(sample):
            got += int(rng.integers(good + bad - k)) < good - got
        return got
    nth = min(good, max(1, round(sample * good / (good + bad))))
    at = rng.beta(nth, good - nth + 1)
    below = int(rng.binomial(bad, at))
    if nth + below <= sample:
        return nth + hypergeometric(rng, good - nth, bad - below, sample - nth - below, population)
    return hypergeometric(rng, nth - 1, below, sample, population)


def split_draw(rng: np.random.Generator, room: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` draws without replacement come from each of the ``room``s."""
    out, left = np.zeros_like(room), int(room.sum())
    for k, r in enumerate(room.tolist()):
        left -= r
        out[k] = hypergeometric(rng, r, left, sample)
        sample -= int(out[k])
    return out


def matrix_row(part: int, upto: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """What partition ``part`` sends to each shard; ``upto`` has the partitions' cumulative sizes from 0."""
    low, high = 0, len(upto) - 1
    while high - low > 1:
        mid = (low + high) // 2
        first = split_draw(np.random.default_rng([seed, low, high]), room, int(upto[mid] - upto[low]))
        low, high, room = (low, mid, first) if part < mid else (mid, high, room - first)
    return room


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), seed: int = 12, rows_per_part: int = 250_000) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, and ``carried`` columns on demand.

    ``size`` is the UTF-8 bytes of the text plus one; a null text has none and a
    crc32 of 0.  The law that holds is ``rows``: shards have numbers of rows at
    most one apart, drawn so that each way of dealing is equally likely; copies
    of a text are dealt like any other rows.  ``slot`` is the row's place in its
    shard, without gaps from 0.  ``grown_shard`` is null: one more shard deals
    anew.  With fewer rows than shards, the last ones are empty; an empty table
    gives an empty result.  Null ids stay null.

    The dealing follows from ids, sizes, checksums and ``seed`` alone, whatever
    the input's partitions; rows that agree in all three may change places with
    each other.  They are dealt by their number too, so a third of all rows may
    be equal and no part grows with them.
    """
    text = F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias(NUMBER),
        *([F.struct(*carry).alias(CARRY)] if carry else []),
    )
    rows = written(rows, "shard-rows")
    more = [CARRY] if carry else []
    same = ["id", "size", "text_crc32"]
    n = rows.count()
    n_parts = max(16, -(-n // rows_per_part))
    key = F.xxhash64(*same, SALT, F.lit(seed))
    parts = written(salted(rows, same).select(*rows.columns, key.alias("key"), F.pmod(key, F.lit(n_parts)).cast("int").alias("part")), "shard-parts")
    sizes = np.zeros(n_parts, np.int64)
    for r in parts.groupBy("part").count().collect():  # one number a part
        sizes[r["part"]] = r["count"]
    upto, room = np.concatenate([[0], np.cumsum(sizes)]), shard_sizes(n, shards)

    def deal(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table = table.sort_by([(c, "ascending") for c in ("key", *same, NUMBER)])
        rng = np.random.default_rng([seed, part])
        shard = np.empty(table.num_rows, np.int32)
        shard[rng.permutation(table.num_rows)] = np.repeat(np.arange(shards), matrix_row(part, upto, room, seed))
        place = rng.integers(0, 1 << 62, table.num_rows)
        return table.select([*same, *more]).append_column("shard", pa.array(shard)).append_column("place", pa.array(place))

    schema = StructType([f for f in rows.schema if f.name != NUMBER]).add("shard", "integer").add("place", "long")
    dealt = written(parts.groupBy("part").applyInArrow(deal, schema), "shard-dealt")
    discard(rows, parts)
    # A shard's order of places, in buckets of a bounded size: their rows come after those of all lower buckets.
    buckets = max(1, int(room.max(initial=0)) // rows_per_part)
    bucketed = dealt.withColumn("bucket", F.floor(F.col("place") / F.lit(2.0**62) * buckets))
    counts = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = counts.select("shard", "bucket", (F.sum("c").over(W.partitionBy("shard").orderBy("bucket")) - F.col("c")).alias("before"))
    nth = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("place", *same))
    placed = bucketed.withColumn("nth", nth).join(before, ["shard", "bucket"])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *([F.col(CARRY).alias("carried")] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 12, files_per_shard: int = 1) -> None:
    """All columns of ``docs`` as Parquet folders ``shard=0`` … under ``path``, files of a shard one after the other, rows in slot order."""
    spark = docs.sparkSession
    dealt = written(shard_rows(docs, shards, carry=tuple(docs.columns), seed=seed), "shards")
    per_file = -(-max(1, dealt.count()) // (shards * files_per_shard))
    out = dealt.select("carried.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), F.floor(F.col("slot") / per_file).alias("__file"))
    out = out.repartitionByRange(max(1, shards * files_per_shard), "__shard", "__file").sortWithinPartitions("__shard", "__slot")
    out.drop("__slot", "__file").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)
    discard(dealt)

"""The closest name of a table by difflib's ratio, without comparing all with all.

Two texts of ratio ``c`` or more have ``c`` times half their length together in
matching characters, in few blocks, so they share a number of pairs of
neighbouring characters that their lengths imply.  By the prefix rule it is
enough to look at each text's rarest pairs, as many as leave that number out: two
such texts meet under one.  Lengths and counts of characters bound the ratio from
above; what is left is decided by the ratio itself.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from memlake.scratch import cut


@F.pandas_udf(T.DoubleType())
def _ratio(candidate: pd.Series, name: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio where it is ``least`` or more, else null; cheap bounds first.  What is known of a name is kept for its candidates."""
    out, matcher, last = [], difflib.SequenceMatcher(), None
    for c, n, at_least in zip(candidate, name, least):
        if n != last:
            matcher.set_seq2(n)
            last = n
        matcher.set_seq1(c)
        fits = matcher.real_quick_ratio() >= at_least and matcher.quick_ratio() >= at_least
        out.append(r if fits and (r := matcher.ratio()) >= at_least else None)
    return pd.Series(out, dtype=float)


def _pairs(text: Column) -> Column:
    """Each two neighbouring characters with the number of their occurrence."""
    two = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    number = lambda s, i: F.concat(s, F.size(F.filter(F.slice(two, 1, i + 1), lambda x: x == s)).cast("string"))
    return F.when(F.length(text) > 1, F.transform(two, number)).otherwise(F.array().cast("array<string>"))


def _shared(text: Column, cutoff: float) -> Column:
    """How many pairs of neighbours a text of this length shares at least with one of that ratio; 1 where none is sure.

    ``m`` matching characters lie in blocks that unmatched ones part, so there are
    no more than ``la + lb - 2 m + 1``, and each block of ``k`` has ``k - 1`` pairs.
    """
    rate = (1.5 * cutoff - 1) * 2 / (2 - cutoff)
    return F.greatest(F.ceil(F.length(text) * rate - 1 - 1e-9), F.lit(1))


def _keys(texts: DataFrame, rarity: DataFrame, cutoff: float) -> DataFrame:
    """``(text, key)``: the rarest pairs of each text, all but those that a partner shares besides one."""
    each = texts.select("text", F.size(_pairs(F.col("text"))).alias("n"), F.explode(_pairs(F.col("text"))).alias("key"))
    nth = F.row_number().over(W.partitionBy("text").orderBy(F.coalesce("times", F.lit(0)), "key"))
    return each.join(rarity, "key", "left").withColumn("nth", nth).where(F.col("nth") <= F.col("n") - _shared(F.col("text"), cutoff) + 1).select("text", "key")


def _by_length(texts: DataFrame, candidates: DataFrame, cutoff: float) -> DataFrame:
    """``(text, other)``: pairs of lengths that allow the ratio; lengths are keys of the join."""
    sized = candidates.select(F.col("text").alias("other"), F.length("text").alias("size"))
    sizes = sized.select("size").distinct()  # one row a length
    a, b = F.length("text"), F.col("size")
    reach = texts.select("text").join(F.broadcast(sizes), 2 * F.least(a, b) >= cutoff * (a + b) - 1e-9)
    return reach.join(sized, "size").select("text", "other")


def close_candidates(names: DataFrame, candidates: DataFrame, cutoff: float) -> DataFrame:
    """``(text, other)``: among them all pairs of a ratio of at least ``cutoff``."""
    rarity = cut(candidates.select(F.explode(_pairs(F.col("text"))).alias("key")).groupBy("key").agg(F.count("*").alias("times")), "rarity")
    rate = (1.5 * cutoff - 1) * 2 / (2 - cutoff)
    sure = F.length("text") * rate > 1 + 1e-9
    met = _keys(names.where(sure), rarity, cutoff).join(_keys(candidates, rarity, cutoff).toDF("other", "key"), "key").select("text", "other")
    a, b = F.length("text"), F.length("other")
    met = met.where(2 * F.least(a, b) >= cutoff * (a + b) - 1e-9)
    return met.unionByName(_by_length(names.where(~sure), candidates, cutoff)).distinct()


def closest_names(names: DataFrame, candidates: DataFrame, name: str = "name", candidate: str = "candidate", cutoff: float = 0.8, first: float = 0.8) -> DataFrame:
    """``(name, closest, ratio)`` of the different names that have a candidate of a ratio of at least ``cutoff``.

    The candidate of the highest ratio is taken, of equal ones the largest text; a
    name that is a candidate is its own.  Null names and candidates have none.
    Below the cutoff ``first``, names are looked for with that one first, and only
    those that are still open are compared with all candidates that their lengths
    allow.
    """
    n = cut(names.select(F.col(name).alias("text")).where("text is not null").distinct(), "names")
    c = cut(candidates.select(F.col(candidate).alias("text")).where("text is not null").distinct(), "candidates")
    out = n.join(c, "text", "left_semi").select("text", F.col("text").alias("closest"), F.lit(1.0).alias("ratio"))
    for least in [cutoff] if cutoff >= first else [first, cutoff]:
        todo = n.join(out.select("text"), "text", "left_anti")
        pairs = cut(close_candidates(todo, c, least), "close")
        scored = pairs.repartition("text").sortWithinPartitions("text").select("text", "other", _ratio("other", "text", F.lit(float(least))).alias("ratio")).where("ratio is not null")
        best = scored.groupBy("text").agg(F.max(F.struct("ratio", "other")).alias("s")).select("text", F.col("s.other").alias("closest"), F.col("s.ratio").alias("ratio"))
        out = cut(out.unionByName(best), "closest")
    return out.withColumnRenamed("text", name)

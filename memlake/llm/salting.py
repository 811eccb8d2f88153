"""Salts for rows that agree in all that they are dealt by."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from memlake.llm.scratch import written

SALT, NUMBER = "__salt", "__number"


def salted(rows: DataFrame, same: list[str]) -> DataFrame:
    """``rows`` with ``__salt``: the row's number where another one agrees with it in all columns of ``same``, null elsewhere.

    So a hash of these columns and the salt deals equal rows to many places, and
    all others alike in every run.  Which keys are repeated is counted with
    map-side combine; there mostly are none, and then rows are not joined.
    ``rows`` may have a ``__number`` of its own, else rows are numbered in the
    order of their scan, which has to be the same whenever it is read.
    """
    repeated = written(rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    none = repeated.isEmpty()
    if none:
        return rows.withColumn(SALT, F.lit(None).cast("long"))
    numbered = rows if NUMBER in rows.columns else rows.withColumn(NUMBER, F.monotonically_increasing_id())
    r = repeated.select(*(F.col(c).alias(f"__same_{c}") for c in same), F.lit(True).alias("__again"))
    met = reduce(and_, (numbered[c].eqNullSafe(r[f"__same_{c}"]) for c in same))
    return numbered.join(r, met, "left").select(*rows.columns, F.when(F.col("__again"), F.col(NUMBER)).alias(SALT))

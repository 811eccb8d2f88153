"""Filtered, cursor-style listing over any table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memlake.operators.vector_store import predicate


@dataclass
class Listing:
    """What a listing asks for.

    ``order`` are the sort columns, the last of them unique.  ``after`` and
    ``before`` are rows' sort values: rows strictly behind or ahead of them in
    the listing's direction.  ``start`` and ``end`` bound ``date_col``, both
    ends left out unless ``inclusive``.
    """

    order: tuple[str, ...] = ("created_at", "id")
    filters: Mapping[str, Any] = field(default_factory=dict)
    after: tuple | None = None
    before: tuple | None = None
    limit: int | None = 50
    ascending: bool = True
    date_col: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    inclusive: bool = False
    text_col: str | None = None
    text: str | None = None
    scope: Mapping[str, Any] = field(default_factory=dict)


def key_after(order: tuple[str, ...], values: tuple, ascending: bool = True) -> Column:
    """Keyset condition: the sort columns, as a tuple, lie behind ``values``."""
    out = F.lit(False)
    same = F.lit(True)
    for c, v in zip(order, values, strict=True):
        out |= same & ((F.col(c) > F.lit(v)) if ascending else (F.col(c) < F.lit(v)))
        same &= F.col(c) == F.lit(v)
    return out


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in df.columns else df


def date_range(df: DataFrame, c: str, start=None, end=None, inclusive: bool = False) -> DataFrame:
    if start is not None and end is not None and start > end:
        raise ValueError("the start is after the end")
    if start is not None:
        df = df.where(F.col(c) >= F.lit(start) if inclusive else F.col(c) > F.lit(start))
    if end is not None:
        df = df.where(F.col(c) <= F.lit(end) if inclusive else F.col(c) < F.lit(end))
    return df


def matching(df: DataFrame, spec: Listing) -> DataFrame:
    """The listing's rows before cursors and limit; its count is the listing's size."""
    df = live(df).where(predicate(spec.filters)).where(predicate(spec.scope))
    if spec.date_col:
        df = date_range(df, spec.date_col, spec.start, spec.end, spec.inclusive)
    if spec.text_col and spec.text:
        df = df.where(F.lower(spec.text_col).contains(spec.text.lower()))
    return df


def list_rows(df: DataFrame, spec: Listing) -> DataFrame:
    """Rows in order; with both cursors and a limit, the middle of what lies between them."""
    df = matching(df, spec)
    if spec.after is not None:
        df = df.where(key_after(spec.order, spec.after, spec.ascending))
    if spec.before is not None:
        df = df.where(key_after(spec.order, spec.before, not spec.ascending))
    order = [F.asc(c) if spec.ascending else F.desc(c) for c in spec.order]
    if spec.after is not None and spec.before is not None and spec.limit:
        # Between two cursors as many rows again as asked for are looked at, and the middle is kept.
        got = df.orderBy(*order).limit(2 * spec.limit)
        n = got.count()
        skip = max(0, (n - spec.limit) // 2)
        return got.orderBy(*order).offset(skip).limit(spec.limit)
    df = df.orderBy(*order)
    return df.limit(spec.limit) if spec.limit else df


def page(df: DataFrame, order: list[Column], start: int, count: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(count)


def size(df: DataFrame, filters: Mapping[str, Any] | None = None) -> int:
    """Count with filters; only None is no condition."""
    return live(df).where(predicate(filters)).count()


def having_all(bridge: DataFrame, owner: str, tag: str, tags: list[str]) -> DataFrame:
    """Owners of all tags."""
    return bridge.where(F.col(tag).isin(tags)).groupBy(owner).agg(F.countDistinct(tag).alias("__n")).where(F.col("__n") == len(set(tags))).select(owner)


def having_any(bridge: DataFrame, owner: str, tag: str, tags: list[str]) -> DataFrame:
    return bridge.where(F.col(tag).isin(tags)).select(owner).distinct()


def distinct_values(df: DataFrame, c: str, like: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """Sorted distinct values with a case-insensitive search and a cursor."""
    out = df.select(c).distinct()
    if like:
        out = out.where(F.lower(c).contains(like.lower()))
    if after is not None:
        out = out.where(F.col(c) > after)
    out = out.orderBy(c)
    return out.limit(limit) if limit else out


def content_contains(df: DataFrame, content_col: str, text: str) -> DataFrame:
    """Rows with a text part that holds ``text``; ``content_col`` is an array of ``(type, text)``."""
    return df.where(F.exists(content_col, lambda p: (p["type"] == "text") & p["text"].ilike(f"%{text}%")))


def by_keys(df: DataFrame, keys: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """Rows of the asked composite keys; ``strict`` fails if one is missing."""
    if strict and not keys.join(df, on, "left_anti").isEmpty():
        raise KeyError("some keys are missing")
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def in_order(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows in the order of an array column ``ids``."""
    asked = ids.select(F.posexplode("ids").alias("pos", id_col))
    return asked.join(df, id_col).orderBy("pos").drop("pos")


def attached(rows: DataFrame, bridge: DataFrame, row_key: str, bridge_key: str, **owner: Any) -> DataFrame:
    """Rows that a bridge table links to an owner."""
    b = bridge.where(predicate(owner)).select(F.col(bridge_key).alias(row_key)).distinct()
    return rows.join(b, row_key, "left_semi")


def usage(steps: DataFrame, **where: Any) -> DataFrame:
    """One row of token sums and the number of steps; zeros if there are none."""
    s = steps.where(predicate(where))
    return s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.count("*").alias("steps"))


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def union_passages(source: DataFrame, agent: DataFrame) -> DataFrame:
    """Source and agent passages in one table, missing columns null."""
    return source.unionByName(agent, allowMissingColumns=True)


def history(queries: DataFrame, results: DataFrame, limit: int) -> DataFrame:
    """Distinct queries and results, oldest first."""
    cols = ["created_at", "user", "text"]
    return queries.select(*cols).union(results.select(*cols)).distinct().orderBy(*cols).limit(limit)

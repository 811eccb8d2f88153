"""Vector expressions, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for null vectors, unequal lengths and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null, so sorted last, where the cosine is."""
    return 1 - cosine(a, b)


def normalized(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def mean_vector(a: Column, b: Column) -> Column:
    """Mean of two halves' embeddings of an oversize text."""
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """One vector of a text's token vectors: the mean of those whose mask is set (null without any), or the first, ``cls``."""
    if how == "cls":
        return F.try_element_at(tokens, F.lit(1))
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["t"])

    def mean(vs: Column) -> Column:
        return F.when(F.size(vs) > 0, F.transform(vs[0], lambda _, i: F.aggregate(vs, F.lit(0.0), lambda s, v: s + F.element_at(v, i + 1).cast("double")) / F.size(vs)))

    return let(kept, mean)


METRICS = {"ip": (dot, True), "cosine": (cosine, True), "l2": (l2, False)}

"""Model calls behind small protocols, with deterministic offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import text as X


class Embedder(Protocol):
    dims: int

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    """Stand-in: a word adds +1 or -1 to one of ``dims`` places, by its hash."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, text: Column) -> Column:
        w = X.words(F.lower(text))
        at = F.transform(w, lambda t: F.pmod(F.xxhash64(t), F.lit(self.dims)))
        sign = F.transform(w, lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        both = F.arrays_zip(at.alias("a"), sign.alias("s"))
        return F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.aggregate(F.filter(both, lambda z: z["a"] == i), F.lit(0.0), lambda t, z: t + z["s"]).cast("float"))


#: Embedders by name; a model's own class is added to it.
EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"hash": HashEmbedder}


def embedder(name: str = "hash", dims: int = 64) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name}")
    return EMBEDDERS[name](dims)


class PatternExtractor:
    """Stand-in for entity extraction: typed patterns."""

    def __init__(self, kinds: tuple[str, ...] = tuple(X.ENTITY_PATTERNS)):
        self.kinds = kinds

    def extract(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``(id, type, name, description)`` of all hits, repeats included."""

        def described(kind: str) -> Column:
            template = F.lit(X.ENTITY_PATTERNS[kind][1])
            return F.transform(X.entities(text_col, kind), lambda e: F.struct(F.lit(kind).alias("type"), e.alias("name"), F.replace(template, F.lit("{}"), e).alias("description")))

        hits = F.concat(*map(described, self.kinds))
        return df.select(id_col, F.explode(hits).alias("e")).select(id_col, "e.*")


def first_sentences(n: int = 1) -> Callable[[Column], Column]:
    """Stand-in for a summary: the first sentences."""
    return lambda t: F.array_join(F.slice(F.split(F.trim(t), r"(?<=[.!?])\s+"), 1, n), " ")


#: Frequent words that tell languages apart, for the stand-in; ties go to the first.
LANGUAGES = {"en": ["the", "and", "of"], "fr": ["le", "la", "et"], "de": ["der", "und", "die"], "es": ["el", "los", "y"]}


def language(text: Column) -> Column:
    """Stand-in for language detection: the language whose frequent words occur most; ``unknown`` without any."""

    def count(ws: Column, marks: list[str]) -> Column:
        return F.size(F.filter(ws, lambda w: w.isin(marks)))

    def most(ws: Column) -> Column:
        counts = F.array(*[F.struct(count(ws, marks).alias("n"), F.lit(-k).alias("first"), F.lit(name).alias("name")) for k, (name, marks) in enumerate(LANGUAGES.items())])
        return X.let(F.array_max(counts), lambda best: F.when(best["n"] > 0, best["name"]).otherwise("unknown"))

    return X.let(X.words(F.lower(text)), most)


def title(text: Column, top: Column, first: int = 7) -> Column:
    """First words of a text and its most frequent ones in brackets."""
    return F.concat(F.array_join(F.slice(X.words(text), 1, first), " "), F.lit("... ["), top, F.lit("]"))


def request_key(*cols: Column) -> Column:
    """SHA-256 key of a request, for a response cache table."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def cached_calls(requests: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers ``(key, response)`` for requests with ``key``, and the cache rows to add: only unknown keys are called, once each."""
    new = call(requests.dropDuplicates(["key"]).join(cache, "key", "left_anti")).select("key", "response")
    return requests.join(cache.unionByName(new), "key"), new

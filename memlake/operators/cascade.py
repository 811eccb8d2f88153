"""Cascaded extraction: rounds that find nodes, then names of relations, then triplets, each told what is known."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memlake.scratch import cut

#: A call of a model: gets chunks with what is known and the number of the round, gives rows with the chunk's id.
Ask = Callable[[DataFrame, int], DataFrame]


def fixpoint(ask: Callable[[DataFrame | None, int], DataFrame], keys: Callable[[], list[Column]], rounds: int, known: DataFrame | None = None) -> DataFrame:
    """All that ``rounds`` of ``ask(known, round)`` find, each key once, with the round that brought it; ``known`` is not returned.

    Of the spellings that one round has for a key the smallest stays, and the
    first round's over all.  A round that adds nothing is the last: the next
    would ask the same.  Rows with a null are left out.
    """
    new: list[DataFrame] = []
    for r in range(1, rounds + 1):
        all_ = new if known is None else [known, *new]
        before = reduce(DataFrame.unionByName, [t.drop("round") for t in all_]) if all_ else None
        found = ask(before, r).dropna()
        cols, names = found.columns, [f"__k{i}" for i in range(len(keys()))]
        keyed = lambda t: t.withColumns(dict(zip(names, keys(), strict=True)))
        each = keyed(found).groupBy(*names).agg(F.min(F.struct(*cols)).alias("x")).select(*names, "x.*")
        if before is not None:
            each = each.join(keyed(before).select(*names), names, "left_anti")
        came = cut(each.select(*cols, F.lit(r).alias("round")), "round")
        new.append(came)
        if came.isEmpty():
            break
    return reduce(DataFrame.unionByName, new)


def _told(chunks: DataFrame, id_col: str, **known: DataFrame | None) -> DataFrame:
    """Chunks with a sorted array a kind of what is known in each; an array holds one chunk's findings."""
    for name, t in known.items():
        if t is None:
            chunks = chunks.withColumn(name, F.array().cast("array<string>"))
        else:
            cols = [c for c in t.columns if c not in (id_col, "round")]
            one = F.col(cols[0]) if len(cols) == 1 else F.concat_ws("\t", *cols)
            each = t.groupBy(id_col).agg(F.array_sort(F.collect_set(one)).alias(name))
            chunks = chunks.join(each, id_col, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return chunks


def cascade(chunks: DataFrame, nodes: Ask, relations: Ask, triplets: Ask, rounds: int = 2, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, name, round)`` of nodes, the same of relation names, and ``(id, source, rel, target, round)``.

    ``nodes`` sees ``known_nodes`` and gives ``(id, name)``.  ``relations`` sees
    ``known_nodes`` and ``known_relations`` and gives ``(id, name, is_node)``; what
    nodes it adds count on from round ``rounds + 1``.  ``triplets`` sees both and
    ``known_triplets`` (tab-separated), and gives ``(id, source, rel, target)``; ends that
    are no nodes of the chunk are left out.  Names are the same in any case.
    """
    low = lambda: [F.col(id_col), F.lower("name")]
    first = fixpoint(lambda k, r: nodes(_told(chunks, id_col, known_nodes=k), r).select(id_col, "name"), low, rounds)

    def named(k: DataFrame | None, r: int) -> DataFrame:
        return relations(_told(chunks, id_col, known_nodes=k.where("is_node").drop("is_node"), known_relations=k.where("not is_node").drop("is_node")), r).select(id_col, "name", "is_node")

    both = cut(fixpoint(named, lambda: [*low(), F.col("is_node")], rounds, first.drop("round").withColumn("is_node", F.lit(True))))
    all_nodes = cut(first.unionByName(both.where("is_node").drop("is_node").withColumn("round", F.col("round") + rounds)), "nodes")
    names = both.where("not is_node").drop("is_node")
    inside = cut(all_nodes.select(id_col, F.lower("name").alias("end")))

    def linked(k: DataFrame | None, r: int) -> DataFrame:
        found = triplets(_told(chunks, id_col, known_nodes=all_nodes, known_relations=names, known_triplets=k), r).select(id_col, "source", "rel", "target")
        for end in ("source", "target"):
            found = found.withColumn("end", F.lower(end)).join(inside, [id_col, "end"], "left_semi").drop("end")
        return found

    edges = fixpoint(linked, lambda: [F.col(id_col), F.lower("source"), F.lower("rel"), F.lower("target")], rounds)
    return all_nodes, names, edges


#: ``A in B`` as the offline reader below takes it.
STATEMENT = r"^(.+?) (in|of) (.+)$"


def statement_reader(text: str = "text", id_col: str = "chunk_id") -> tuple[Ask, Ask, Ask]:
    """An offline stand-in for a model: texts of statements ``A in B; …``.  It sees one step further each round, as a model told of its last answer does."""
    part = lambda i: F.regexp_extract("s", STATEMENT, i)

    def read(chunks: DataFrame) -> DataFrame:
        s = chunks.select("*", F.posexplode(F.split(text, "; ")).alias("pos", "s")).where(F.col("s").rlike(STATEMENT))
        known = F.transform("known_nodes", F.lower)
        return s.select("*", part(1).alias("source"), part(2).alias("rel"), part(3).alias("target")).withColumn("from_known", F.array_contains(known, F.lower("source")))

    def nodes(chunks: DataFrame, r: int) -> DataFrame:
        s = read(chunks)
        begin = s.where((F.size("known_nodes") == 0) & (F.col("pos") == 0)).select(id_col, F.col("source").alias("name"))
        return begin.unionByName(s.where("from_known").select(id_col, F.col("target").alias("name")))

    def relations(chunks: DataFrame, r: int) -> DataFrame:
        s = read(chunks).where("from_known")
        return s.select(id_col, F.explode(F.array(F.struct(F.col("rel").alias("name"), F.lit(False).alias("is_node")), F.struct(F.col("target").alias("name"), F.lit(True).alias("is_node")))).alias("x")).select(id_col, "x.*")

    def triplets(chunks: DataFrame, r: int) -> DataFrame:
        s = read(chunks)
        return s.where(F.array_contains("known_relations", F.col("rel"))).select(id_col, "source", "rel", "target")

    return nodes, relations, triplets

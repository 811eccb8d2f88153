"""Answer scoring and its aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import text as X
from memlake.functions.arrow import rouge_l
from memlake.scratch import cut

SCALED = r"_len|_time"


def flat_golds(c: str) -> Column:
    """Golds as one array of strings."""
    return F.filter(F.col(c), lambda g: g.isNotNull())


def answer_metrics(df: DataFrame, pred: str = "output", golds: str = "answers") -> DataFrame:
    """Exact match, token F1 and substring match, each the best over the golds."""
    g, p = flat_golds(golds), F.col(pred)
    return df.select(
        "*",
        X.best_over(g, lambda x: X.exact_match(p, x).cast("int")).alias("exact_match"),
        X.best_over(g, lambda x: X.token_f1(p, x)).alias("f1"),
        X.best_over(g, lambda x: X.substring_match(p, x).cast("int")).alias("substring_exact_match"),
    )


def default_scores(df: DataFrame, pred: str = "output", golds: str = "answers") -> DataFrame:
    """The better of the raw and the parsed output for each metric; rows without output are left out."""
    d = df.where(F.col(pred).isNotNull()).withColumn("parsed_output", X.parse_output(pred))
    raw = answer_metrics(d, pred, golds)
    both = answer_metrics(raw.withColumnsRenamed({m: f"raw_{m}" for m in ("exact_match", "f1", "substring_exact_match")}), "parsed_output", golds)
    return both.select(*d.columns, *[F.greatest(m, f"raw_{m}").alias(m) for m in ("exact_match", "f1", "substring_exact_match")])


def event_recall(pred: Column, answers: Column) -> Column:
    """1 if every answer is in the raw output, whatever the case."""
    return F.forall(answers, lambda a: F.contains(F.lower(pred), F.lower(a))).cast("int")


def needle_recall(pred: Column, answers: Column) -> Column:
    """Share of the answers found in the output."""
    return F.size(F.filter(answers, lambda a: F.contains(F.lower(pred), F.lower(a)))) / F.size(answers)


def choice_scores(df: DataFrame, pred: str = "output", golds: str = "answers") -> DataFrame:
    """Multiple choice: the second gold in the raw output is a match, and then an exact one."""
    d = default_scores(df, pred, golds)
    hit = F.contains(F.lower(pred), F.lower(F.element_at(golds, 2)))
    return d.withColumn("exact_match", F.when(hit, 1).otherwise(F.col("exact_match"))).withColumn("substring_exact_match", hit.cast("int"))


def scored(df: DataFrame, kind: str = "sub_dataset", pred: str = "output", golds: str = "answers") -> DataFrame:
    """``(…, metric, value)`` routed by the data set's name."""
    icl, event, choice, needle = (F.col(kind).contains(x) for x in ("icl", "eventqa", "choice_eng", "ruler_niah"))
    own = [c for c in df.columns]
    pairs = lambda d, *ms: d.select(*own, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ms])).alias("m")).select(*own, "m.*")
    base = ("exact_match", "f1", "substring_exact_match")
    parts = [
        pairs(answer_metrics(df.where(icl).withColumn("parsed_output", X.parse_output(pred)), "parsed_output", golds), *base),
        pairs(answer_metrics(df.where(event).withColumn("parsed_output", X.parse_output(pred)), "parsed_output", golds).withColumn("eventqa_recall", event_recall(F.col(pred), F.col(golds))), *base, "eventqa_recall"),
        pairs(choice_scores(df.where(choice), pred, golds), *base),
        pairs(df.where(needle).withColumn("ruler_recall", needle_recall(F.col(pred), F.col(golds))), "ruler_recall"),
        pairs(default_scores(df.where(~(icl | event | choice | needle)), pred, golds), *base),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_means(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean per metric, in percent unless it is a length or a time."""
    return long.groupBy(*by, "metric").agg((F.avg("value") * F.when(F.first("metric").rlike(SCALED), 1).otherwise(100)).alias("value"))


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(keys, metrics, "metric", "value").where("value is not null")


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """``(k, recall)``: mean share of each query's distinct golds among its first ``k``; 0 without golds."""
    g = gold.groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    r = ranked.where(F.col("rank") <= max(ks)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("hits"))
    j = g.join(r, "query_id", "left").withColumn("hits", F.coalesce(F.transform("hits", lambda h: h["doc_id"]), F.array().cast("array<long>")))
    each = j.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.size(F.array_intersect(F.slice("hits", 1, k), "gold")) / F.nullif(F.size("gold"), F.lit(0)), F.lit(0.0)).alias("recall")) for k in ks])).alias("x"))
    return each.groupBy("x.k").agg(F.round(F.avg("x.recall"), 4).alias("recall"))


def accuracy_by_type(df: DataFrame, correct: str, kind: str) -> DataFrame:
    """Accuracy and count per type, and overall under ``all``."""
    return df.rollup(kind).agg(F.round(F.avg(correct), 4).alias("accuracy"), F.count("*").alias("n")).withColumn(kind, F.coalesce(kind, F.lit("all")))


def judged_yes(response: Column) -> Column:
    return F.lower(response).contains("yes")


def summary_scores(df: DataFrame) -> DataFrame:
    """Recall, precision and fluency-weighted F1 of judged summaries; zero-safe.

    Reads ``found``, ``total``, ``supported``, ``sentences`` and ``fluency``.
    """
    recall = F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(0.0)
    precision = F.when(F.col("sentences") > 0, F.col("supported") / F.col("sentences")).otherwise(0.0)
    f1 = F.when(recall + precision > 0, F.col("fluency") * 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return df.select("*", recall.alias("recall"), precision.alias("precision"), f1.alias("judged_f1"))


#: Distances up to which titles are looked up by their segments; a longer reach leaves segments too short to tell titles apart.
REACHES = (1, 2, 4)


def nearest_titles(names: DataFrame, titles: DataFrame, name: str = "name", title: str = "title", reaches: tuple[int, ...] = REACHES) -> DataFrame:
    """``(name, nearest, distance)`` by edit distance in lower case; ties go to the smallest title.

    Names look within reach first: a title cut into ``d + 1`` segments has one of
    them whole in every text within ``d`` edits, at most ``d`` places off, so length,
    number and content of a segment are the key of a join.  What has no title in
    reach tries the next.  What is left meets titles by length: one title of each
    length gives a first distance, and none is followed beyond it.
    """
    size = lambda c: F.length(F.lower(c))
    t = cut(titles.select(F.col(title).alias("t")).where("t is not null").distinct().withColumn("size", size("t")))
    open_ = cut(names.select(F.col(name).alias("n")).where("n is not null").distinct())
    done = []
    for d in reaches:
        # A distance over ``d`` comes back as -1.
        near = _sharing_segments(open_, t, d).withColumn("d", F.levenshtein(F.lower("n"), F.lower("t"), d)).where("d >= 0")
        done.append(cut(near.groupBy("n").agg(F.min(F.struct("d", "t")).alias("x"))))
        open_ = cut(open_.join(done[-1], "n", "left_anti"))
        if open_.isEmpty():
            break
    else:
        done.append(_by_size(open_, t))
    best = reduce(DataFrame.unionByName, done)
    return best.select(F.col("n").alias(name), F.col("x.t").alias("nearest"), F.col("x.d").alias("distance"))


def _sharing_segments(names: DataFrame, titles: DataFrame, d: int) -> DataFrame:
    """``(n, t)``, each once: all pairs within ``d`` edits, and few others.  Titles of up to ``d`` characters are their own key: their length."""
    first = lambda m, p: F.floor(m * p / (d + 1)).cast("int")
    parts = lambda m: F.when(m > d, F.sequence(F.lit(0), F.lit(d))).otherwise(F.array(F.lit(-1)))
    m, p = F.col("m"), F.col("p")
    start, long_ = first(m, p), first(m, p + 1) - first(m, p)
    piece = lambda c, at: F.when(p < 0, "").otherwise(F.substring(F.lower(c), at + 1, long_))
    t = titles.select("t", F.col("size").alias("m")).withColumn("p", F.explode(parts(m))).select("t", "m", "p", piece("t", start).alias("seg"))
    l = F.length(F.lower("n"))
    n = names.withColumn("m", F.explode(F.sequence(F.greatest(l - d, F.lit(0)), l + d))).withColumn("p", F.explode(parts(m)))
    low, high = F.greatest(start - d, F.lit(0)), F.least(start + d, l - long_)
    n = n.withColumn("at", F.explode(F.when(p < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high))))
    return n.select("n", "m", "p", piece("n", F.col("at")).alias("seg")).distinct().join(t, ["m", "p", "seg"]).select("n", "t").distinct()


def _by_size(names: DataFrame, t: DataFrame) -> DataFrame:
    """``(n, x)``: the nearest title of names that may be far from all."""
    size = F.length(F.lower("n"))
    some = t.groupBy("size").agg(F.min("t").alias("t"))  # one row a length
    first = cut(names.join(F.broadcast(some)).groupBy("n").agg(F.min(F.levenshtein(F.lower("n"), F.lower("t"))).alias("most")))
    reach = first.withColumn("size", F.explode(F.sequence(F.greatest(size - F.col("most"), F.lit(0)), size + F.col("most"))))
    d = reach.join(t, "size").withColumn("d", F.levenshtein(F.lower("n"), F.lower("t")))
    return d.where("d <= most").groupBy("n").agg(F.min(F.struct("d", "t")).alias("x"))


def recommendation_recall(df: DataFrame, titles: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall of the true titles among the first ``k`` recommended ones, matched to the nearest title."""
    items = df.select("query_id", F.posexplode(X.recommendation_items("output")).alias("pos", "item")).where("item <> ''")
    near = nearest_titles(items, titles, name="item")
    listed = items.join(near, "item").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "nearest"))), lambda x: x["nearest"]).alias("got"))
    j = df.join(listed, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    part = lambda k: F.size(F.filter("titles", lambda t: F.array_contains(F.slice(F.col("got"), 1, k), t))) / F.size("titles")
    return j.select("query_id", *[part(k).alias(f"recall_{k}") for k in ks])


def bootstrap_interval(scores: DataFrame, col: str = "score", samples: int = 10_000, seed: int = 42, level: float = 0.95, blocks: int = 512) -> DataFrame:
    """``(mean, low, high)``: seeded bootstrap of the mean; runs agree, nulls are left out, no rows give nulls.

    Scores lie in at most ``blocks`` sorted blocks, each value in its own if there
    are no more.  A sample deals its draws to the blocks, one binomial after the
    other, and adds a block's mean as often, with the deviation that as many draws
    from it have.  So the work is samples times blocks, whatever the rows.
    """
    v = F.col("v")
    values = cut(scores.select(F.col(col).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c")))
    ends = values.agg(F.array_sort(F.array_distinct(F.percentile_approx(v, F.array(*[F.lit((i + 1) / blocks) for i in range(blocks)]), blocks * 20))).alias("ends"))  # one row

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("v", "c"))
            at = np.searchsorted(b.column("ends")[0].values.to_numpy(), x)
            sums = [np.bincount(at, w, blocks + 1) for w in (c, c * x)]
            mean = sums[1] / np.maximum(sums[0], 1)
            apart = np.bincount(at, c * (x - mean[at]) ** 2, blocks + 1)
            some = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (np.arange(blocks + 1), sums[0], mean, apart)], names=["b", "c", "mean", "apart"])

    parts = values.join(F.broadcast(ends)).mapInArrow(placed, "b long, c double, mean double, apart double")
    parts = cut(parts)
    whole = parts.groupBy("b").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("mean")) / F.sum("c")).alias("m"))  # at most blocks + 1 rows
    # Deviations are taken from the block's mean, not from sums of squares, which lose digits.
    apart = F.sum(F.col("apart") + F.col("c") * (F.col("mean") - F.col("m")) ** 2)
    dev = parts.join(F.broadcast(whole), "b").groupBy("b").agg(F.first("n").alias("c"), F.first("m").alias("mean"), apart.alias("apart"))
    table = dev.withColumn("dev", F.sqrt(F.col("apart") / F.col("c"))).agg(F.sort_array(F.collect_list(F.struct("b", "c", "mean", "dev"))).alias("t"))  # one row

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("t")[0].values
            if not len(known):
                continue
            c, mean, dev = (known.field(k).to_numpy(zero_copy_only=False) for k in ("c", "mean", "dev"))
            n, means = int(c.sum()), []
            for k in b.column("k").to_pylist():
                rng = np.random.default_rng([seed, k])
                drawn = rng.multinomial(n, c / c.sum())
                means.append(float((drawn * mean + np.sqrt(drawn) * dev * rng.standard_normal(len(c))).sum() / n))
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64())], names=["m"])

    means = scores.sparkSession.range(samples).withColumnRenamed("id", "k").join(F.broadcast(table)).mapInArrow(draw, "m double")
    tail = (1 - level) / 2
    out = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return scores.agg(F.avg(col).alias("mean")).join(F.broadcast(out))


def rouge_best(df: DataFrame, pred: str = "output", golds: str = "answers") -> DataFrame:
    """ROUGE-L F1 and recall, each the best over the golds."""
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    each = keyed.select("__row", F.col(pred).alias("p"), F.explode(golds).alias("g")).select("__row", rouge_l("p", "g").alias("r"))
    best = each.groupBy("__row").agg(F.max("r.f1").alias("rougeL_f1"), F.max("r.recall").alias("rougeL_recall"))
    return keyed.join(best, "__row").drop("__row")


def needs_judging(rows: DataFrame, done: DataFrame, key: str = "qa_pair_id") -> DataFrame:
    return rows.join(done, key, "left_anti")


def unpack_references(df: DataFrame) -> DataFrame:
    """One row per reference of parallel arrays; rows whose arrays differ in length are left out."""
    cols = ["question_ids", "questions", "answers"]
    same = F.size(cols[0]).eqNullSafe(F.size(cols[1])) & F.size(cols[0]).eqNullSafe(F.size(cols[2]))
    return df.where(same).select(F.posexplode(F.arrays_zip(*cols)).alias("pos", "r")).select("pos", "r.*")

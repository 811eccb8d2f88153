"""Queries that score answers: metric tables, judged summaries, references, recommendations, whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions.arrow import rouge_lsum
from memlake.operators import evaluation as ev
from memlake.plans import pipelines as P
from memlake.plans.catalog import query
from memlake.plans.text_queries import _DOCS_ASKED, _asked, _turns
from memlake.sources.tables import table, texts


@query("""SELECT c_custkey, unnest(['acct_len', 'nation']) AS metric, unnest([c_acctbal, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS DOUBLE) END]) AS value FROM customer WHERE c_nationkey > 3
    UNION ALL SELECT c_custkey, 'acct_len', c_acctbal FROM customer WHERE c_nationkey <= 3""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each answer as rows; those that are missing are left out."""
    wide = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acct_len"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).alias("nation"))
    return ev.long_metrics(wide, ["c_custkey"], ["acct_len", "nation"])


@query("""SELECT c_mktsegment, 'acct_len' AS metric, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'nation', round(100 * avg(c_nationkey), 4) FROM customer GROUP BY 1""")
def metric_averages(spark: SparkSession, d: str) -> DataFrame:
    """Means per group, in percent unless the metric is a length."""
    wide = table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.col("c_acctbal").alias("acct_len"), F.col("c_nationkey").cast("double").alias("nation"))
    return ev.metric_means(ev.long_metrics(wide, ["c_mktsegment", "c_custkey"], ["acct_len", "nation"]), ("c_mktsegment",)).withColumn("value", F.round("value", 4))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN least(p_partkey % 5, p_size % 7) / (p_size % 7) ELSE 0.0 END AS recall, CASE WHEN p_size % 4 > 0 THEN least(p_partkey % 3, p_size % 4) / (p_size % 4) ELSE 0.0 END AS precision, CAST(p_partkey % 2 AS DOUBLE) AS fluency FROM part)
    SELECT p_partkey, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN fluency * 2 * recall * precision / (recall + precision) ELSE 0.0 END, 6) AS judged_f1 FROM r""")
def summary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Judged summaries: recall of key points, precision of sentences, F1 weighted by fluency."""
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.least(p.p_partkey % 5, p.p_size % 7).alias("found"), (p.p_size % 7).alias("total"), F.least(p.p_partkey % 3, p.p_size % 4).alias("supported"), (p.p_size % 4).alias("sentences"), (p.p_partkey % 2).cast("double").alias("fluency"))
    return ev.summary_scores(rows).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "judged_f1")])


@query("SELECT conv_id, turn, contains(lower(text), 'yes') AS correct FROM conversations")
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", ev.judged_yes(F.col("text")).alias("correct"))


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (role = 'user') AS us, list(turn ORDER BY turn) FILTER (role = 'assistant') AS ans FROM conversations GROUP BY conv_id), k AS (SELECT *, unnest(range(len(us))) AS k FROM c WHERE len(us) = len(ans))
    SELECT CAST(k AS INT) AS pos, 'q' || conv_id || '-' || us[k + 1] AS question_ids, us[k + 1] AS questions, ans[k + 1] AS answers FROM k""")
def unpacked_references(spark: SparkSession, d: str) -> DataFrame:
    """References of parallel lists; lists of unequal lengths are left out."""
    t = table(spark, d, "conversations")
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("turn"))))
    rows = t.groupBy("conv_id").agg(of("user").alias("questions"), of("assistant").alias("answers"))
    ids = F.transform("questions", lambda x: F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.lit("-"), x.cast("string")))
    return ev.unpack_references(rows.withColumn("question_ids", ids))


@query(r"""
    WITH t AS (SELECT DISTINCT n_name AS title FROM nation), o AS (SELECT s_suppkey, s_nationkey, [lower(s1.n_name) || 'x', 'Nation ' || (s_nationkey + 1) % 25, n2.n_name] AS items, [s1.n_name, n2.n_name] AS gold FROM supplier JOIN nation s1 ON s1.n_nationkey = s_nationkey JOIN nation n2 ON n2.n_nationkey = (s_nationkey + 7) % 25),
    u AS (SELECT s_suppkey, gold, unnest(items) AS item, unnest(range(3)) AS pos FROM o),
    near AS (SELECT item, min((levenshtein(lower(item), lower(title)), title))[2] AS nearest FROM (SELECT DISTINCT item FROM u) CROSS JOIN t GROUP BY item),
    g AS (SELECT s_suppkey, any_value(gold) AS gold, list(nearest ORDER BY pos) AS got FROM u JOIN near USING (item) GROUP BY s_suppkey)
    SELECT s_suppkey AS query_id, len(list_filter(gold, lambda x: list_contains(got[1:1], x))) / len(gold) AS recall_1, len(list_filter(gold, lambda x: list_contains(got[1:2], x))) / len(gold) AS recall_2, len(list_filter(gold, lambda x: list_contains(got[1:3], x))) / len(gold) AS recall_3 FROM g""")
def recommendation_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recommended items are matched to the nearest title and looked for among the true ones."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("a")), "s_nationkey").withColumn("k", ((F.col("s_nationkey") + 7) % 25).cast("int"))
    j = j.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b")), "k")
    output = F.concat(F.lit("1. "), F.lower("a"), F.lit("x\n2. Nation "), ((F.col("s_nationkey") + 1) % 25).cast("string"), F.lit("\n3. "), "b")
    rows = j.select(F.col("s_suppkey").alias("query_id"), output.alias("output"), F.array("a", "b").alias("titles"))
    return ev.recommendation_recall(rows, n.select(F.col("n_name").alias("title")), (1, 2, 3))


@query(rf"""WITH {_DOCS_ASKED}, c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id)
    SELECT query_id, md5('Answer: ' || CASE WHEN regexp_matches(trim(context), '[.!?]\s') THEN regexp_extract(trim(context), '^((?s).*?[.!?])\s', 1) ELSE trim(context) END) AS output FROM c""")
def retrieved_answers(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of what was retrieved, as an offline stand-in for an answer."""
    out = P.retrieve_and_answer(texts(spark, d, "documents"), _asked(spark, d), P.first_sentence_answer, 3)
    return out.select("query_id", F.md5("output").alias("output"))


@query("""WITH o AS (SELECT n_nationkey AS k, n_nationkey % 3 AS m FROM nation)
    SELECT 'exact_match' AS metric, 100.0 * avg(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS value FROM o UNION ALL SELECT 'f1', 100.0 * avg(CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 ELSE 0 END) FROM o UNION ALL SELECT 'substring_exact_match', 100.0 * avg(CASE WHEN m < 2 THEN 1 ELSE 0 END) FROM o""")
def evaluated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Right, long and wrong answers, a third each, evaluated against their golds."""
    n = table(spark, d, "nation")
    m = F.col("n_nationkey") % 3
    gold = F.regexp_replace("n_name", "_", "x")
    output = F.when(m == 0, F.concat(F.lit("Answer: The "), gold, F.lit("."))).when(m == 1, F.concat(F.lit("answer: "), gold, F.lit(" surely"))).otherwise("nothing")
    q = F.col("n_nationkey").alias("query_id")
    out = P.evaluate(n.select(q, output.alias("output")), n.select(q, F.array(gold, F.lit("something else")).alias("answers")))
    # 'answer: x surely' has two words of which one is the gold's single one.
    return out


@query()
def rouge_lsum_turns(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-Lsum of each message against the one after it."""
    return _turns(spark, d).select("conv_id", "turn", rouge_lsum("text", "gold").alias("r")).select("conv_id", "turn", F.round("r.f1", 6).alias("f1"), F.round("r.recall", 6).alias("recall"))

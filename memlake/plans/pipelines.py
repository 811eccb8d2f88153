"""Composed plans: building a knowledge graph, answering questions over it, evaluating a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import text as X
from memlake.functions.ids import uuid5
from memlake.operators import bm25, chunking, evaluation as ev, graph as G
from memlake.providers import HashEmbedder, PatternExtractor, first_sentences

#: Prompt texts by name; ``{key}`` is replaced.
TEMPLATES = {
    "memorize": "Keep this part of the conversation for later questions.\n{context}",
    "query": "{context}\nNow Answer the Question: {question}\nAnswer:",
    "system": "You answer from what you were given before.",
    "judge": "Question: {question}\nReference: {answer}\nResponse: {response}\nIs the response correct? Answer yes or no.",
    "judge_abstention": "Question: {question}\nExplanation: {answer}\nResponse: {response}\nDoes the response say that the question cannot be answered? Answer yes or no.",
    "judge_temporal": "Question: {question}\nReference: {answer}\nResponse: {response}\nAn error of one day, week or month is no error. Is the response correct? Answer yes or no.",
    "judge_preference": "Question: {question}\nRubric: {answer}\nResponse: {response}\nDoes the response use the user's preferences as the rubric says? Answer yes or no.",
}


def template(name: str) -> str:
    """The template whose name is the longest beginning of ``name``."""
    fits = [k for k in TEMPLATES if name.startswith(k)]
    if not fits:
        raise KeyError(name)
    return TEMPLATES[max(fits, key=len)]


def judge_prompts(rows: DataFrame) -> DataFrame:
    """Each row's judge prompt, by question type and whether it should be abstained from."""
    fields = {k: F.col(k) for k in ("question", "answer", "response")}
    kind = F.when(F.col("abstention"), X.fill_template(template("judge_abstention"), fields)).when(F.col("question_type").contains("temporal"), X.fill_template(template("judge_temporal"), fields)).when(F.col("question_type").contains("preference"), X.fill_template(template("judge_preference"), fields))
    return rows.withColumn("prompt", kind.otherwise(X.fill_template(template("judge"), fields)))


def knowledge_graph(docs: DataFrame, limit: int = 128, kinds: tuple[str, ...] = ("PERSON", "EMAIL", "URL", "HASHTAG"), summarize: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Documents to ``chunks``, ``nodes``, ``edges``, ``index`` (texts to embed) and ``totals`` (tokens per document)."""
    summarize = summarize or first_sentences(1)
    chunks = chunking.paragraph_chunks(docs, limit).withColumn("chunk_id", uuid5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string"))))
    hits = PatternExtractor(kinds).extract(chunks, "chunk_id", "text").dropDuplicates(["chunk_id", "type", "name"])
    e = hits.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("name", "type"))).alias("nodes")).withColumn("edges", F.array().cast("array<struct<source:string,target:string,rel:string>>"))
    nodes, edges = G.integrate(e)
    doc = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    parts = chunks.select(F.col("chunk_id").alias("id"), "text").withColumn("type", F.lit("DocumentChunk"))
    summaries = chunks.select(uuid5(F.lit("TextSummary"), F.col("chunk_id")).alias("id"), summarize(F.col("text")).alias("text"), F.lit("TextSummary").alias("type"), F.col("chunk_id"))
    nodes = nodes.select("id", "name", "type").unionByName(parts.select("id", F.lit(None).cast("string").alias("name"), "type")).unionByName(summaries.select("id", F.lit(None).cast("string").alias("name"), "type")).unionByName(chunks.select(doc.alias("id"), F.lit(None).cast("string").alias("name"), F.lit("TextDocument").alias("type")).distinct())
    edges = edges.unionByName(chunks.select(F.col("chunk_id").alias("src"), doc.alias("dst"), F.lit("is_part_of").alias("rel"))).unionByName(summaries.select(F.col("id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("made_from").alias("rel")))
    texts = parts.select("id", "type", "text").unionByName(summaries.select("id", "type", "text"))
    index = G.index_fields(texts, {"DocumentChunk": ["text"], "TextSummary": ["text"]})
    return {"chunks": chunks, "nodes": nodes, "edges": edges, "index": index, "totals": chunks.groupBy("doc_id").agg(F.sum("size").alias("tokens"))}


def embedded(index: DataFrame, embedder: HashEmbedder | None = None) -> DataFrame:
    return index.withColumn("vector", (embedder or HashEmbedder()).embed(F.col("text")))


def retrieve_and_answer(chunks: DataFrame, questions: DataFrame, answer: Callable[[Column, Column], Column], k: int = 5) -> DataFrame:
    """``(query_id, query, output)``: the top passages as context, and what the model makes of them."""
    hits = bm25.bm25_topk(chunks, questions, k)
    ctx = hits.join(chunks.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    q = questions.join(ctx, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return q.select("query_id", "query", answer(F.col("context"), F.col("query")).alias("output"))


def first_sentence_answer(context: Column, question: Column) -> Column:
    """Offline stand-in for a model: the first sentence of the context."""
    return F.concat(F.lit("Answer: "), first_sentences(1)(context))


def evaluate(outputs: DataFrame, golds: DataFrame) -> DataFrame:
    """``(metric, value)`` in percent of ``outputs (query_id, output)`` against ``golds (query_id, answers)``."""
    scored = ev.default_scores(outputs.join(golds, "query_id"))
    return ev.metric_means(ev.long_metrics(scored.select("query_id", *[F.col(m).cast("double").alias(m) for m in ("exact_match", "f1", "substring_exact_match")]), ["query_id"], ["exact_match", "f1", "substring_exact_match"]))


def merged_first_lines(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Passages with the same first line become one: that line, and their bodies in order."""
    r = rows.withColumn("__head", X.first_line("text")).withColumn("__body", F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit("")))
    g = r.groupBy(by, "__head").agg(F.sort_array(F.collect_list(F.struct(order, "__body"))).alias("b"))
    return g.select(by, F.concat_ws("\n", "__head", F.array_join(F.transform("b", lambda x: x["__body"]), "\n")).alias("text"))


def dataset_names(files: DataFrame, root: str) -> DataFrame:
    """``(path, dataset)``: folders below the root, joined by dots, name the data sets."""
    below = F.regexp_replace(F.expr(f"substring_index(path, '{root.rstrip('/')}/', -1)"), r"/?[^/]*$", "")
    return files.select("path", F.when(below == "", "main_dataset").otherwise(F.translate(below, "/", ".")).alias("dataset"))


def matched_datasets(names: DataFrame, wanted: str) -> DataFrame:
    """Data sets of that name and below it."""
    return names.where((F.col("dataset") == wanted) | F.col("dataset").startswith(wanted + "."))


def permitted(documents: DataFrame, grants: DataFrame, user: str, permission: str) -> DataFrame:
    """The documents, unless one of them lacks the grant: then reading fails."""
    mine = grants.where((F.col("user_id") == user) & (F.col("permission") == permission)).select("document_id")
    if not documents.join(mine, "document_id", "left_anti").isEmpty():
        raise PermissionError(f"{user} may not {permission} all of the documents")
    return documents


def metadata_block(messages: DataFrame, passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: messages outside the context, passages, and the last block edit."""
    return messages.agg(F.count("*").alias("recall")).join(F.broadcast(passages.agg(F.count("*").alias("archival")))).join(F.broadcast(blocks.agg(F.max("updated_at").alias("last_edit"))))


def system_prompt(blocks: DataFrame, by: str, base: str) -> DataFrame:
    """``base`` with ``{CORE_MEMORY}`` replaced by the labelled blocks in order."""
    part = lambda b: F.concat(F.lit("<"), b["label"], F.lit(">\n"), b["value"], F.lit("\n</"), b["label"], F.lit(">"))
    g = blocks.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "value"))), part), "\n").alias("core"))
    return g.select(by, X.fill_template(base, {"CORE_MEMORY": F.col("core")}).alias("prompt"))

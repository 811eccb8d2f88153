"""A training corpus from raw documents: filter, dedup, mix, tokenize.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; other columns are left out.  Every
stage takes an empty table, and gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm.line_dedup import dedup_lines
from memlake.llm.mixing import mix_sources
from memlake.llm.quality import keep_quality
from memlake.llm.queries import TOKENIZERS, table
from memlake.llm.scratch import written
from memlake.llm.sentencepiece import encode_documents, model_bytes
from memlake.llm.simhash import near_copy_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, row by row.

    Null and empty texts have a score like any other; a null id is never learnt from.
    """
    return keep_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common long lines stay in the document of the largest id that holds them; ``n_chars`` follows the text.

    No row goes.  A null text stays null, with a null ``n_chars``; a null id is
    larger than any other; rows that repeat an id are documents of their own.
    """
    kept = dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), one row with the smallest id stays.

    Null and empty texts are one group; a null id is larger than any other; of
    repeated rows one stays.
    """
    return near_copy_dedup(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time.

    Texts without words are never taken; a null source is a source of its own;
    rows that repeat an id are taken equally often, by the sum of their words.
    """
    taken = mix_sources(docs).where("size > 0").groupBy(F.col("doc_id").alias("mix_id")).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times"))
    taken = written(taken.where("times > 0"), "mix-times")
    return docs.join(taken.hint("merge"), docs.doc_id.eqNullSafe(taken.mix_id)).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text; a null text has none."""
    return encode_documents(docs, model_bytes(spark, f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

#: A trained classifier and a tokenizer are not in reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; every stage but it is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

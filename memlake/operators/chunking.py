"""Chunking: words by expression; reset-dependent packing as linear Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memlake.functions.ids import uuid5
from memlake.functions.text import let

#: The marks that end a sentence.
MARKS = ".;!?…。！？"
WORD = rf"[^ {MARKS}]*(?: |[{MARKS}] *)|[^ {MARKS}]+"
#: A sentence ends at . ! ? before white space.
SENTENCE_END = r"(?<=[.!?])\s+"

CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("paragraph", T.IntegerType())])


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), SENTENCE_END), lambda s: s != "")


def word_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outer: bool = False) -> DataFrame:
    """``(id, pos, word, kind)``: words with their trailing spaces; joined, they give the text back.

    ``kind`` is ``sentence_end`` for a word that ends with a sentence mark,
    ``paragraph_end`` if a line end follows it, else ``word``.  With ``outer``, a
    null or empty text is one row, of kind ``word``, without place and word.
    """
    w = docs.select(F.col(id_col), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("ws"))
    w = w.select(id_col, (F.posexplode_outer if outer else F.posexplode)(F.arrays_zip(F.col("ws").alias("word"), F.slice("ws", 2, 1 << 30).alias("next"))).alias("pos", "p"))
    ends = F.rtrim(F.col("p.word")).rlike(f"[{MARKS}]$")
    line = F.coalesce(F.col("p.next").rlike("^[\n\r]"), F.lit(False))
    return w.select(id_col, "pos", F.col("p.word").alias("word"), F.when(ends & line, "paragraph_end").when(ends, "sentence_end").otherwise("word").alias("kind"))


def _words(text: str) -> list[tuple[str, str]]:
    found = re.findall(WORD, text)
    out = []
    for k, w in enumerate(found):
        if w.rstrip(" ")[-1:] in MARKS and w.strip(" "):
            out.append((w, "paragraph_end" if k + 1 < len(found) and found[k + 1][0] in "\n\r" else "sentence_end"))
        else:
            out.append((w, "word"))
    return out


def split_sentences(text: str, limit: int | None, size: Callable[[str], int]) -> list[tuple[str, int, str, int]]:
    """Sentences of at most ``limit``: text, size, how they were cut, and their paragraph's number.

    Joined, they give the text back.  A word longer than the limit is an error if it is left last.
    """
    out: list[tuple[str, int, str, int]] = []
    buffer, total, state, paragraph, kind = [], 0, None, 0, None
    for word, kind in _words(text):
        n = size(word)
        if kind != "word" or any(c.isalpha() for c in word):
            state = kind
        if limit and total + n > limit:
            out.append(("".join(buffer), total, state, paragraph))
            buffer, total = [word], n
            continue
        buffer.append(word)
        total += n
        if kind != "word":
            paragraph += kind == "paragraph_end"
            out.append(("".join(buffer), total, state, paragraph))
            buffer, total = [], 0
    if any(buffer):
        if limit and total > limit:
            raise ValueError(f"a word is longer than the chunk size {limit}")
        out.append(("".join(buffer), total, "sentence_cut" if state == "word" else state, paragraph))
    return out


def split_paragraphs(text: str, limit: int, size: Callable[[str], int], batch: bool = True) -> list[tuple[str, int, str, int]]:
    """Sentences packed up to ``limit``; without ``batch`` each paragraph is closed at its end."""
    out: list[tuple[str, int, str, int]] = []
    parts, total, cut = [], 0, None

    def close(how: str | None) -> None:
        nonlocal parts, total
        out.append(("".join(parts), total, how, len(out)))
        parts, total = [], 0

    for sentence, n, end, _ in split_sentences(text, limit, size):
        if total and total + n > limit:
            close(cut)
        parts.append(sentence)
        total += n
        if end in ("paragraph_end", "sentence_cut") and not batch:
            close(end)
        cut = end
    if any(parts):
        close("sentence_cut" if cut == "word" else cut)
    return out


def word_size(text: str) -> int:
    return len(text.split())


def pack_sentences(parts: list[str], limit: int, keep_empty: bool = True, size: Callable[[str], int] = word_size) -> list[str]:
    """Sentences joined by one space, greedily, up to ``limit`` tokens; joining spaces are not counted.

    With ``keep_empty`` a first sentence over the limit leaves an empty chunk before it.
    """
    out, held, total = [], [], 0
    for s in parts:
        n = size(s)
        if total + n > limit and (held or keep_empty):
            out.append(" ".join(held))
            held, total = [], 0
        held.append(s)
        total += n
    return [*out, " ".join(held)] if held else out


def one_per_word(_: str) -> int:
    return 1


#: Chunks that are sent from a Python worker at once, and bytes that are sent to it.
SENT, BATCH_BYTES = 8192, "spark.sql.execution.arrow.maxBytesPerBatch"


def _chunked(docs: DataFrame, split: Callable[[Any], list[tuple]], id_col: str, of_col: str) -> DataFrame:
    """``(id, pos, text, size, cut, paragraph)`` of the chunks that ``split`` makes of a column's values.

    Workers get rows in batches of 8 MB, unless the session says otherwise, and
    hold no more chunks than ``SENT`` and one row's.
    """
    kind = docs.schema[id_col]
    schema = T.StructType([kind, T.StructField("pos", T.IntegerType()), *CHUNK])
    types = [pa.string(), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(ids: pa.Array, rows: list[int], pos: list[int], chunks: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([c[k] for c in chunks], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(pos, pa.int32()), *columns], names=schema.names)

        for b in batches:
            rows, pos, chunks = [], [], []
            for i, value in enumerate(b.column(1)):
                new = split(value.as_py())
                for k in range(0, len(new), SENT):
                    some = new[k : k + SENT]
                    rows += [i] * len(some)
                    pos += range(k, k + len(some))
                    chunks += some
                    if len(chunks) >= SENT:
                        yield sent(b.column(0), rows, pos, chunks)
                        rows, pos, chunks = [], [], []
            if chunks:
                yield sent(b.column(0), rows, pos, chunks)

    conf = docs.sparkSession.conf
    if conf.get(BATCH_BYTES, None) in (None, "-1"):
        conf.set(BATCH_BYTES, str(8 << 20))
    return docs.select(id_col, F.col(of_col).alias("__of")).mapInArrow(run, schema)


def sentence_chunks(docs: DataFrame, limit: int | None = None, size: Callable[[str], int] = one_per_word, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, text, size, cut, paragraph)``; paragraphs are numbered, not random."""
    return _chunked(docs, lambda t: split_sentences(t or "", limit, size), id_col, text_col)


def paragraph_chunks(docs: DataFrame, limit: int, batch: bool = True, size: Callable[[str], int] = one_per_word, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, text, size, cut, chunk_id)`` with the chunk's id from its text."""
    out = _chunked(docs, lambda t: split_paragraphs(t or "", limit, size, batch), id_col, text_col)
    return out.select(id_col, "pos", "text", "size", "cut").withColumn("chunk_id", uuid5(F.col("text")))


def document_chunks(parts: DataFrame, limit: int, size: Callable[[str], int] = one_per_word, id_col: str = "doc_id", order_col: str = "part", text_col: str = "text") -> DataFrame:
    """Paragraph chunks of a document's parts packed across parts; ids from document and index.

    A paragraph chunk that does not fit and follows nothing stands alone, with its text's id.
    """

    def pack(texts: list[str]) -> list[tuple]:
        out, held, total = [], [], 0
        for text in texts:
            for c in split_paragraphs(text or "", limit, size):
                if total + c[1] <= limit:
                    held.append(c)
                    total += c[1]
                    continue
                if held:
                    out.append((" ".join(x[0] for x in held), total, held[-1][2], 0))
                    held, total = [c], c[1]
                else:
                    out.append((c[0], c[1], c[2], 1))
        if held:
            out.append((" ".join(x[0] for x in held), total, held[-1][2], 0))
        return out

    docs = parts.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col]).alias("texts"))
    out = _chunked(docs, pack, id_col, "texts")
    own = uuid5(F.concat(F.col(id_col).cast("string"), F.lit("-"), F.col("pos").cast("string")))
    return out.select(id_col, "pos", "text", "size", "cut", F.when(F.col("paragraph") == 1, uuid5(F.col("text"))).otherwise(own).alias("chunk_id"))


def packed(parts: Column, sizes: Column, limit: int, keep_empty: bool = True) -> Column:
    """``pack_sentences`` as a fold: the state holds where chunks end, the open chunk's size, and the place; an array of texts."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("at"))

    def step(state: Column, n: Column) -> Column:
        over = (state["total"] + n > limit) & ((state["at"] > 0) | F.lit(keep_empty))
        ends = F.when(over, F.concat(state["ends"], F.array(state["at"]))).otherwise(state["ends"])
        return F.struct(ends.alias("ends"), F.when(over, n).otherwise(state["total"] + n).alias("total"), (state["at"] + 1).alias("at"))

    def cut(z: Column) -> Column:
        first = F.concat(F.array(F.lit(0)), z["ends"])
        last = F.concat(z["ends"], F.array(F.size(z["parts"])))
        return F.zip_with(first, last, lambda a, b: F.array_join(F.slice(z["parts"], a + 1, b - a), " "))

    return F.when(F.size(parts) > 0, let(F.struct(parts.alias("parts"), F.aggregate(sizes, start, step)["ends"].alias("ends")), cut)).otherwise(F.array().cast("array<string>"))


def packed_chunks(docs: DataFrame, limit: int = 4096, keep_empty: bool = True, id_col: str = "doc_id", text_col: str = "text", size: Callable[[str], int] = word_size) -> DataFrame:
    """``(id, pos, text, n_tokens)``: whole sentences packed greedily by ``size``; ``n_tokens`` counts words.

    Packing by words is a fold in the JVM; other sizes, as a tokenizer's, go through Arrow.
    """
    if size is word_size:
        words = lambda t: F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")).cast("long")
        chunks = let(sentences(F.coalesce(F.col(text_col), F.lit(""))), lambda parts: packed(parts, F.transform(parts, words), limit, keep_empty))
    else:
        chunks = F.pandas_udf(lambda s: s.map(lambda parts: pack_sentences(list(parts), limit, keep_empty, size)), "array<string>")(sentences(F.col(text_col)))
    out = docs.select(id_col, F.posexplode(chunks).alias("pos", "text"))
    return out.withColumn("n_tokens", F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")))


def token_chunks(docs: DataFrame, limit: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of ``limit`` white-space tokens; an expression, so it stays in the JVM."""
    def cut(w: Column) -> Column:
        n = F.ceil(F.size(w) / limit)
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(w, (k * limit + 1).cast("int"), F.lit(limit)), " ")))

    parts = let(F.filter(F.split(F.col(text_col), r"\s+"), lambda x: x != ""), cut)
    return docs.select(id_col, F.posexplode(parts).alias("pos", "text"))


def obsolete_chunks(chunks: DataFrame, next_links: DataFrame, components: DataFrame) -> DataFrame:
    """Chunks that nothing leads to, and those outside the largest component.

    ``next_links`` has ``(src, dst)``, ``components`` has ``(node, component)``.
    """
    largest = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = components.join(largest, "component", "left_semi").select(F.col("node").alias("chunk_id"))
    led = next_links.select(F.col("dst").alias("chunk_id"))
    return chunks.join(led, "chunk_id", "left_anti").select("chunk_id").union(chunks.join(inside, "chunk_id", "left_anti").select("chunk_id")).distinct()


def checked_chunks(chunks: DataFrame) -> DataFrame:
    """Fails on an empty chunk when read."""
    return chunks.where(F.assert_true(F.length("text") > 0, "empty chunk").isNull())

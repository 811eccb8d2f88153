"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas.  A
batch of inserts, deletes and revised counts is pre-aggregated into a folder of
its own, and is committed by one small file that names the folder; a batch that
is already committed is left as it is, so a retry changes nothing.  After every
few batches a snapshot takes the totals on: it names its own folder and the
batches that are in it, so totals are one snapshot and the few batches after it.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm.scratch import bounded_batches, create_file, drop_path, list_files, read_file

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"
#: Words between white space of any kind, and between ``[\x20\x09-\x0D]``.
OLD_WORDS, WORDS = "words-0", "words-1"
UNICODE = "unicode"
#: Longest word whose count is kept, and the bytes of words that are kept.
SHORT, CACHE_BYTES = 128, 48 << 20


@lru_cache(maxsize=4)
def _encoding(name: str, ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


#: A piece of the pattern always starts at the space before a word, whatever stands before it.
_CUT = re.compile(r" (?=\S)")


class PieceCounter:
    """Tokens of a text under a byte-level BPE whose pattern lets a piece take one leading space.

    Texts are cut before each word's space, and each different short word is
    counted once while it is among the ``cache_bytes`` that are kept.
    """

    def __init__(self, name: str, ranks: bytes, pattern: str, cache_bytes: int = CACHE_BYTES):
        self.encode = _encoding(name, ranks, pattern).encode_ordinary
        self.cache: dict[str, int] = {}
        self.free = self.cache_bytes = cache_bytes

    def _new(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= SHORT:
            self.free -= 120 + 4 * len(word)
            if self.free < 0:
                self.cache.clear()
                self.free = self.cache_bytes
            self.cache[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.cache.get
        first, *rest = _CUT.split(text)
        total = len(self.encode(first))
        for w in rest:
            n = get(w)
            total += self._new(w) if n is None else n
        return total


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[bytes, str] | str | None], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, one row per tokenizer version, with ``tokenizer`` and ``tokens``.

    ``tokenizers`` maps a version to its ranks and pattern, to None for
    ``[^\\x20\\x09-\\x0D]+`` words, or to ``UNICODE`` for words between any white
    space.  Null and empty texts have no tokens; repeated rows are counted one by
    one; an empty table gives an empty result.  Columns of ``docs`` that are
    named ``tokenizer`` or ``tokens`` give way to the new ones.
    """
    bounded_batches(docs.sparkSession)
    text = "__text"
    while text in docs.columns:
        text += "_"
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "tokenizer", "tokens")), F.col(text_col).alias(text))
    names = [c for c in rows.columns if c != text]
    held = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {v: PieceCounter(v, *spec) if isinstance(spec, tuple) else spec for v, spec in held.value.items()}
        for b in batches:
            texts = b.column(text).to_pylist()
            for version, counter in counters.items():
                if isinstance(counter, PieceCounter):
                    n = [counter.count(t) for t in texts]
                elif counter == UNICODE:
                    n = [len(t.split()) if t else 0 for t in texts]
                else:
                    n = [len(t.encode().split()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=[*names, "tokenizer", "tokens"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(run, ", ".join(x for x in (ddl, "tokenizer string, tokens long") if x))


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that are new."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that are gone, with the counts they had."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce("tokens", F.lit(0))).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows of documents whose count, source, language or tokenizer version changed."""
    return deleted(before).unionByName(inserted(after))


def _file_name(batch_id: str) -> str:
    """A name that any store takes and no other batch has; bytes but letters, digits, ``_``, ``.`` and ``-`` are written as ``~`` and two hex digits."""
    raw = batch_id.encode()
    if not 0 < len(raw) <= 80:
        raise ValueError("a batch id has 1 to 80 bytes")
    return "batch=" + "".join(chr(c) if chr(c).isalnum() and c < 128 or c in b"_.-" else f"~{c:02X}" for c in raw)


def _batch_id(name: str) -> str:
    return re.sub(rb"~([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), name.removeprefix("batch=").encode()).decode()


class TokenRollup:
    """Totals under ``path``, a folder that the driver and all executors share.

    Batch ids are texts of 1 to 80 bytes.  Null sources, languages and versions
    are groups of their own; rows that repeat count as often as they come, and
    sums do not depend on their order.  Two writers of one batch id write folders
    of their own, and only the first one's file counts.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 8):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(_batch_id(n) for n in list_files(self.spark, f"{self.path}/commits"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed rows; False, and no change, if it is committed already."""
        name = _file_name(batch_id)
        if name in list_files(self.spark, f"{self.path}/commits"):
            return False
        folder = self._write(deltas)
        if not create_file(self.spark, f"{self.path}/commits/{name}", folder):
            drop_path(self.spark, f"{self.path}/{folder}")
            return False
        if len(self._state()[2]) >= self.every:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` of what all batches leave; groups at zero are left out."""
        _, taken, newer = self._state()
        return self._summed([*taken[:1], *(self._folder(n) for n in newer)])

    def compact(self) -> None:
        """Takes the batches since the last snapshot into a new one; of two at once, the first counts.

        Folders that the snapshot before the last one had taken in are deleted.
        """
        number, taken, newer = self._state()
        if not newer:
            return
        folder = self._write(self.totals())
        if not create_file(self.spark, f"{self.path}/snapshots/{number + 1:012d}", "\n".join([folder, *taken[1:], *newer])):
            drop_path(self.spark, f"{self.path}/{folder}")
            return
        if number > 1:
            before = read_file(self.spark, f"{self.path}/snapshots/{number - 1:012d}").split("\n")
            earlier = read_file(self.spark, f"{self.path}/snapshots/{number - 2:012d}").split("\n")[1:] if number > 2 else []
            for old in [before[0], *(self._folder(n) for n in before[1:] if n not in set(earlier))]:
                drop_path(self.spark, f"{self.path}/{old}")

    def _state(self) -> tuple[int, list[str], list[str]]:
        """The last snapshot's number, its lines (folder, then batches), and the batches that are not in it."""
        snapshots = list_files(self.spark, f"{self.path}/snapshots")
        taken = read_file(self.spark, f"{self.path}/snapshots/{snapshots[-1]}").split("\n") if snapshots else []
        known = set(taken[1:])
        return int(snapshots[-1]) if snapshots else 0, taken, [n for n in list_files(self.spark, f"{self.path}/commits") if n not in known]

    def _folder(self, name: str) -> str:
        return read_file(self.spark, f"{self.path}/commits/{name}")

    def _write(self, deltas: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 or tokens <> 0").coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder

    def _summed(self, folders: list[str]) -> DataFrame:
        deltas = self.spark.read.schema(DELTAS).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], DELTAS)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

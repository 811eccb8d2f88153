"""Arrow-batched functions for what no expression covers: LCS, fuzzy matching, broken JSON, splitters."""

from __future__ import annotations

import base64
import difflib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

ROUGE = T.StructType([T.StructField("f1", T.DoubleType()), T.StructField("recall", T.DoubleType()), T.StructField("precision", T.DoubleType())])


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one bit a token of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        same = row & where.get(t, 0)
        row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(ROUGE)
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """ROUGE-L on lower-cased alphanumeric tokens, without stemming."""
    out = np.zeros((len(prediction), 3))
    for k, (p, g) in enumerate(zip(prediction, gold)):
        a, b = _tokens(p), _tokens(g)
        n = lcs_length(a, b)
        if n:
            pr, re_ = n / len(a), n / len(b)
            out[k] = (2 * pr * re_ / (pr + re_), re_, pr)
    return pd.DataFrame(out, columns=["f1", "recall", "precision"])


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


class BpeSize:
    """Number of tokens of a byte-level BPE: a ``size`` for the chunkers.  ``ranks`` is the vocabulary file's content."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def __call__(self, text: str) -> int:
        return len(_encoding(self.ranks, self.pattern).encode_ordinary(text))


def lcs_places(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``; where two ways are as long, the one that leaves out a token of ``b``.

    One row of bits a token of ``a``: a bit of ``b`` is clear where the length
    steps up.  Rows are kept and walked back, a bit a pair of tokens.
    """
    where: dict[str, int] = {}
    for j, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for t in a:
        same = rows[-1] & where.get(t, 0)
        rows.append(((rows[-1] + same) | (rows[-1] - same)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = set(), len(a), len(b)
    here = length(i, j)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j, here = i - 1, j - 1, here - 1
            out.add(i)
        elif (above := length(i - 1, j)) > here - (rows[i] >> (j - 1) & 1 ^ 1):
            i, here = i - 1, above
        else:
            j, here = j - 1, here - (rows[i] >> (j - 1) & 1 ^ 1)
    return out


def summary_hits(prediction: str, gold: str) -> tuple[int, int, int]:
    """Tokens of the gold's lines that longest common subsequences with any line of the prediction cover, each as often as both texts have it; and both lengths."""
    said, asked = ([t for line in (x or "").split("\n") if (t := _tokens(line))] for x in (prediction, gold))
    left_said, left_asked = (Counter(t for line in lines for t in line) for lines in (said, asked))
    hits = 0
    for line in asked:
        for i in sorted(set().union(*(lcs_places(line, s) for s in said))):
            t = line[i]
            if left_said[t] > 0 and left_asked[t] > 0:
                hits += 1
                left_said[t] -= 1
                left_asked[t] -= 1
    return hits, sum(map(len, said)), sum(map(len, asked))


@F.pandas_udf(ROUGE)
def rouge_lsum(prediction: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """ROUGE-Lsum: lines are sentences; tokens as in ``rouge_l``."""
    out = np.zeros((len(prediction), 3))
    for k, (p, g) in enumerate(zip(prediction, gold)):
        n, a, b = summary_hits(p, g)
        if n:
            pr, re_ = n / a, n / b
            out[k] = (2 * pr * re_ / (pr + re_), re_, pr)
    return pd.DataFrame(out, columns=["f1", "recall", "precision"])


def closest_match(candidates: list[str], cutoff: float = 0.8):
    """Column function: the candidate with the highest Ratcliff-Obershelp ratio of at least ``cutoff``, else null."""

    @F.pandas_udf("string")
    def match(names: pd.Series) -> pd.Series:
        known = set(candidates)
        best = {n: n if n in known else next(iter(difflib.get_close_matches(n, candidates, 1, cutoff)), None) for n in names.dropna().unique()}
        return pd.Series([best.get(n) for n in names], dtype=object)

    return match


def close_json(text: str | None) -> str | None:
    """``text`` up to its last complete element, with its open strings and brackets closed; null if still no JSON.

    One pass notes what is open at each place where an element may end.
    """
    if text is None:
        return None
    ends, open_, quoted, skip = [], "", False, False
    for at, c in enumerate(text):
        if at and c in ",]}":
            ends.append((at, quoted, open_))
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            open_ += "]" if c == "[" else "}"
        elif c in "]}":
            open_ = open_[:-1]
    ends.append((len(text), quoted, open_))
    for at, inside, closing in reversed(ends):
        fixed = text[:at] + '"' * inside + closing[::-1]
        try:
            json.loads(fixed)
            return fixed
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return pd.Series([close_json(t) if isinstance(t, str) else None for t in text], dtype=object)


def char_splitter(size: int = 4096, overlap: int = 200):
    """Column function: pieces of at most ``size`` characters, cut at the last blank line, line end or space that fits."""

    def split(text: str | None) -> list[str]:
        out, at = [], 0
        text = text or ""
        while at < len(text):
            end = min(len(text), at + size)
            if end < len(text):
                for mark in ("\n\n", "\n", " "):
                    cut = text.rfind(mark, at + overlap + 1, end)
                    if cut > 0:
                        end = cut + len(mark)
                        break
            out.append(text[at:end])
            if end >= len(text):
                break
            at = max(at + 1, end - overlap)
        return out

    return F.pandas_udf(lambda s: s.map(split), "array<string>")

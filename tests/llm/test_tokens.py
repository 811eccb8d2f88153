import hashlib
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memlake.llm.queries import BPE_PATTERN, TOKENIZERS
from memlake.llm.sentencepiece import BPE as BPE_MODEL, BYTE, CONTROL, MARK, NORMAL, UNIGRAM, UNKNOWN, USER, Encoder, encode_documents, encoder_of, model_bytes, parse_model, verify_parity
from memlake.llm.token_counts import WORDS, PieceCounter, TokenRollup, _encoding, count_tokens, deleted, inserted, revised

MODEL = model_bytes(None, f"{TOKENIZERS}/piece_bpe_32k.model")
RANKS = model_bytes(None, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("  \n\t▁abteho.,'1é \u0085\u001c\r")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_parity_with_sentencepiece(text):
    assert verify_parity(MODEL, [text]) == []
    if MARK not in text:
        assert encoder_of(MODEL).decode(encoder_of(MODEL).encode([text])) == [text]


def message(*fields):
    out = b""
    for n, v in fields:
        if isinstance(v, int):
            out += bytes([*varint(n << 3), *varint(v)])
        elif isinstance(v, float):
            out += bytes(varint(n << 3 | 5)) + struct.pack("<f", v)
        else:
            out += bytes([*varint(n << 3 | 2), *varint(len(v))]) + v
    return out


def varint(n):
    while n > 127:
        yield n & 127 | 128
        n >>= 7
    yield n


def small_model(kind, user=(), suffix=0, escape=1, prefix=1, squeeze=1):
    """A model with every byte, a few pieces with the marker at the side where it belongs, and user-defined ones."""
    mark = MARK if escape else " "
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), *((f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)), *((u, 0.0, USER) for u in user)]
    marked = ["a" + mark, "ab" + mark, "b" + mark] if suffix else [mark + "a", mark + "ab", mark + "b"]
    pieces += [(p, -1.0 - 0.37 * k - 0.0131 * (k * k % 7), NORMAL) for k, p in enumerate([mark, "a", "b", "ab", "ba", "bab", "c", "<", "x", ">", *marked])]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return data + message((2, message((3, kind), (24, suffix), (35, 1)))) + message((3, message((3, prefix), (4, squeeze), (5, escape))))


SMALL = ["abab", "babab ab", "", " ", "  a  b ", "cabxé", "a\nb", "bbab aab", "<x>ab<x>", "ab <x> ba", "<x", "a<x>  <x> b", "  <x>", "<x><xx>", "a <x", "b\n\n<x> "]


@pytest.mark.parametrize("kind", [UNIGRAM, BPE_MODEL])
@pytest.mark.parametrize("user", [(), ("<x>",), ("<x>", "<x", "b<x>")])
@pytest.mark.parametrize(("suffix", "escape"), [(0, 1), (1, 1), (0, 0), (1, 0)])
def test_parity_of_small_models(kind, user, suffix, escape):
    """Unigram and BPE, user-defined pieces, white space before or behind words, escaped or not, with and without dummy and squeezed spaces."""
    for prefix in (0, 1):
        for squeeze in (0, 1):
            data = small_model(kind, user, suffix, escape, prefix, squeeze)
            assert parse_model(data).kind == kind
            assert verify_parity(data, SMALL) == [], (prefix, squeeze)


def test_documents_round_trip(documents, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for df in (documents, odd_docs, no_docs):
        text = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in df.collect()}
        rows = encode_documents(df, MODEL).collect()
        assert len(rows) == df.count()
        for r in rows:
            t = text[r.doc_id, r.decoded_sha256]
            assert r.round_trip and r.ids == sp.encode(t) and r.n_tokens == len(r.ids)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_piece_counts_match_tiktoken(text):
    assert PieceCounter("t", RANKS, BPE_PATTERN).count(text) == len(_encoding("t", RANKS, BPE_PATTERN).encode_ordinary(text))


def brute(rows):
    enc = _encoding("t", RANKS, BPE_PATTERN)
    sums = {}
    for r in rows:
        for v, n in ((WORDS, len((r.text or "").encode().split())), ("t", len(enc.encode_ordinary(r.text or "")))):
            d, t = sums.get((r.source, r.lang, v), (0, 0))
            sums[r.source, r.lang, v] = d + 1, t + n
    return sums


def as_sums(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_decoding_matches_both_libraries(texts):
    t = encoder_of(MODEL)
    assert t.decode(t.encode(texts)) == t.decode_by_library(t.encode(texts))


def test_caches_are_bounded_by_bytes():
    texts = ["x" * 100_000, " ".join(f"word{i}" for i in range(5000)), "one two"]
    t, c = Encoder(MODEL, cache_bytes=10_000), PieceCounter("t", RANKS, BPE_PATTERN, cache_bytes=10_000)
    for _ in range(3):
        for k, x in enumerate(texts):
            assert t.encode([x]) == encoder_of(MODEL).encode([x])
            assert c.count(x) == len(_encoding("t", RANKS, BPE_PATTERN).encode_ordinary(x))
            assert t.held < 2_000_000 and len(c.cache) < 100 and all(len(w) <= 128 for w in [*t.cache, *c.cache])


def test_batch_ids(spark, documents, tmp_path):
    """Any text is an id; a writer that comes second with an id changes nothing."""
    counts = inserted(count_tokens(documents, {WORDS: None}))
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    names = ["2026/11/27", "2026~11", "a b=c%2F", "é", "..", "_x", "~", "A", "a"]
    for k, name in enumerate(names, 1):
        assert rollup.commit(name, counts) and not rollup.commit(name, counts)
        assert rollup.batches() == sorted(names[:k])
    once = as_sums(counts.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
    assert as_sums(rollup.totals()) == {key: (len(names) * d, len(names) * t) for key, (d, t) in once.items()}
    for bad in ("", "x" * 81):
        with pytest.raises(ValueError):
            rollup.commit(bad, counts)

    class Slow(TokenRollup):
        """Another writer commits the same id while this one writes."""

        def _write(self, deltas):
            folder = super()._write(deltas)
            other.commit("same", counts.limit(1))
            return folder

    other, slow = TokenRollup(spark, str(tmp_path / "s")), Slow(spark, str(tmp_path / "s"))
    assert not slow.commit("same", counts)
    assert sum(d for d, _ in as_sums(slow.totals()).values()) == 1


def test_snapshots_keep_the_totals(spark, documents, tmp_path):
    counts = inserted(count_tokens(documents, {WORDS: None})).cache()
    rollup = TokenRollup(spark, str(tmp_path / "r"), every=2)
    want = as_sums(counts.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
    for k in range(1, 10):
        assert rollup.commit(f"b{k}", counts)
        assert as_sums(rollup.totals()) == {key: (k * d, k * t) for key, (d, t) in want.items()}
    assert len(list((tmp_path / "r" / "snapshots").glob("0*"))) == 4 and len(list((tmp_path / "r" / "data").iterdir())) < 9
    assert len(rollup.batches()) == 9


def test_columns_that_clash(spark):
    df = spark.createDataFrame([("a b", "x", "y", 1)], "text string, `__text` string, tokenizer string, tokens int")
    assert [tuple(r) for r in count_tokens(df, {WORDS: None}).collect()] == [("x", WORDS, 2)]


def test_rollup(spark, documents, odd_docs, no_docs, tmp_path):
    spec = {WORDS: None, "t": (RANKS, BPE_PATTERN)}
    for n, df in enumerate((documents, odd_docs, no_docs)):
        counts = count_tokens(df.drop("size", "id"), spec)
        rollup = TokenRollup(spark, f"{tmp_path}/r{n}")
        assert as_sums(rollup.totals()) == {}
        assert rollup.commit("one", inserted(counts))
        assert not rollup.commit("one", inserted(counts))
        assert as_sums(rollup.totals()) == brute(df.collect())
        gone, stays = df.where("doc_id % 3 = 0"), df.where("doc_id % 3 <> 0 or doc_id is null")
        rollup.commit("two", deleted(count_tokens(gone, spec)))
        assert as_sums(rollup.totals()) == brute(stays.collect())
        new = stays.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" more words"))).withColumn("source", F.lit("moved"))
        rollup.commit("three", revised(count_tokens(stays, spec), count_tokens(new, spec)))
        assert as_sums(rollup.totals()) == brute(new.collect())
        assert rollup.batches() == ["one", "three", "two"]


def test_a_broken_commit_is_made_again(spark, documents, tmp_path):
    """A batch without its commit file, as a lost driver leaves it, does not count."""
    counts = count_tokens(documents, {WORDS: None})
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    inserted(counts).limit(3).write.parquet(str(tmp_path / "r" / "data" / "lost"))
    (tmp_path / "r" / "commits").mkdir()
    (tmp_path / "r" / "commits" / ".lost").write_text("data/lost")
    assert as_sums(rollup.totals()) == {} and rollup.batches() == []
    assert rollup.commit("one", inserted(counts))
    assert as_sums(rollup.totals()) == as_sums(inserted(counts).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))


def test_query_counts_all_documents(spark, sf_dir, documents):
    from memlake.llm.queries import BPE, op9_token_counts

    got = as_sums(op9_token_counts(spark, sf_dir))
    assert got == {(s, l, BPE if v == "t" else v): x for (s, l, v), x in brute(documents.collect()).items()}

"""The queries ``opN_<name>``: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm.exact_dedup import exact_dedup
from memlake.llm.line_dedup import dedup_lines
from memlake.llm.mixing import mix_sources
from memlake.llm.periodic_runs import periodic_runs
from memlake.llm.quality import classify_quality
from memlake.llm.resampling import resample
from memlake.llm.scratch import discard, scratch_path, written
from memlake.llm.sentencepiece import encode_documents, model_bytes
from memlake.llm.sharding import shard_rows
from memlake.llm.simhash import simhash_dedup
from memlake.llm.substring_dedup import dedup_substrings
from memlake.llm.token_counts import OLD_WORDS, UNICODE, WORDS, TokenRollup, count_tokens, inserted, revised
from memlake.llm.url_filter import Rule, filter_urls
from memlake.llm.vector_search import nearest

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
BPE = "byte-bpe-50k-1"
#: Fixed: the pattern that the byte-level vocabulary was made with.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_bytes(spark, model), with_ids=False)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """All documents' counts of two tokenizer versions.

    Three batches: the BPE's inserts, an older word count's inserts, and its
    revision by today's, which deletes each old count and inserts the new one.
    The first one is sent again, as after a lost answer.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counts = written(count_tokens(docs, {OLD_WORDS: UNICODE, WORDS: None, BPE: (model_bytes(spark, ranks), BPE_PATTERN)}), "token-counts")
    of = lambda version: counts.where(counts.tokenizer == version)
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit(f"insert/{BPE}", inserted(of(BPE)))
    rollup.commit(f"insert/{OLD_WORDS}", inserted(of(OLD_WORDS)))
    rollup.commit(f"revise/{OLD_WORDS}/{WORDS}", revised(of(OLD_WORDS), of(WORDS)))
    rollup.commit(f"insert/{BPE}", inserted(of(BPE)))
    discard(counts)
    return rollup.totals()


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, those whose ``crc32(doc_id)`` ends in 0, go on periodically from some word on.

    With ``g`` a tenth of that number and ``n`` words, word ``i >= a`` is that at
    ``a + (i - a) % p``, where ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``.
    A null id or text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rule = lambda w: F.struct(w.alias("w"), (F.floor(h / 10) % F.size(w)).cast("int").alias("a"))
    period = lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((F.size(s["w"]) - s["a"]) / (3 + F.floor(h / 10) % 8))).cast("int").alias("p"))
    again = lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))), " ")
    # Each step is a lambda over an array of one, so that its value is computed once.
    text = F.transform(F.transform(F.transform(F.array(words), rule), period), again)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(planted_runs(table(spark, sf_dir, "documents")), with_text=False)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OPS = (op1_substring_dedup, op2_url_filter, op3_quality_classifier, op4_line_dedup, op5_vector_search, op6_simhash_dedup, op7_sentencepiece, op8_mixing, op9_token_counts, op10_exact_dedup, op11_periodic_runs, op12_sharding, op13_importance_resampling)


#: CRC-32 in SQL: the table of its bytes by its rule, and the checksum of a word given in hexadecimal.
_DIGIT = """digit AS (
                SELECT list_transform(range(256), lambda v: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v::BIGINT)) AS t
            )"""


def _crc32(hexed: str) -> str:
    return f"xor(list_reduce(list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": r"""
            WITH w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
            ), p AS (
                SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w
            ), k AS (
                SELECT *, string_agg(word, ' ') OVER n AS key, count(*) OVER n = 13 AS whole FROM p WINDOW n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
            ), l AS (
                SELECT key, min(doc_id) AS low FROM k WHERE whole GROUP BY key
            ), h AS (
                SELECT k.doc_id, pos, word, coalesce(whole AND low < k.doc_id, false) AS hit FROM k LEFT JOIN l ON k.key = l.key AND whole
            ), g AS (
                SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h
            ), s AS (
                SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id
            )
            SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
        "op2_url_filter": r"""
            WITH u AS (
                SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
            ), p AS (
                SELECT page_id,
                       translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                FROM u
            ), r(r_host, r_path, r_verdict) AS (
                VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
            ), f AS (
                SELECT page_id, host, path, r_host || r_path AS rule, r_verdict AS verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS n
                FROM p LEFT JOIN r ON ends_with('.' || host, '.' || r_host) AND starts_with(path, r_path)
            )
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1""",
        "op4_line_dedup": r"""
            WITH l AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
            ), k AS (
                SELECT doc_id, pos, line,
                       translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM l
            ), s AS (
                SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
            ), j AS (
                SELECT k.*, s.top IS NOT NULL AND s.top <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key
            )
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM j GROUP BY doc_id""",
        "op10_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM n""",
        "op11_periodic_runs": rf"""
            WITH {_DIGIT}, w AS (
                SELECT doc_id, {_crc32('hex(doc_id::VARCHAR)')} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents, digit
            ), a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w
            ), q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a
            ), d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM q
            ), id AS (SELECT word, row_number() OVER ()::INT AS k FROM (SELECT DISTINCT unnest(ws) AS word FROM d)
            ), num AS (SELECT doc_id, list(k ORDER BY i) AS ks FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM d) JOIN id USING (word) GROUP BY doc_id
            ), lag AS (SELECT doc_id, ks, unnest(range(1, len(ks) // 4 + 1)) AS p FROM num
            ), eq AS (SELECT doc_id, p, unnest(list_filter(range(len(ks) - p), lambda i: ks[i + 1] = ks[i + p + 1])) AS i FROM lag
            ), run AS (
                SELECT doc_id, s AS start, len, min(p) AS period FROM (
                    SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS grp FROM eq) GROUP BY doc_id, p, grp
                ) WHERE len >= greatest(6, 4 * p) GROUP BY doc_id, s, len
            ), best AS (
                SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || len || ',' || period || chr(10), '' ORDER BY start, period)) AS runs FROM run GROUP BY doc_id
            ), top AS (SELECT DISTINCT ON (doc_id) doc_id, start, len, period FROM run ORDER BY doc_id, len::DOUBLE / period DESC, start, period
            ), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + len)) AS i FROM run
            ), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM d) x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, len AS length, period, 1000 * len // period AS exponent_milli, coalesce(runs, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
            FROM d LEFT JOIN best USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)""",
        "op13_importance_resampling": rf"""
            WITH {_DIGIT}, w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
            ), b AS (
                SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark
            ), p AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL
            ), k AS (SELECT word, {_crc32('hex(word)')} % 10000 AS bucket FROM (SELECT word FROM p UNION SELECT word FROM b), digit
            ), s AS (SELECT bucket, sum(n) AS s FROM p JOIN k USING (word) GROUP BY bucket
            ), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket
            ), g AS (
                SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)
            ), x AS (SELECT doc_id, sum(n * gain) AS weight FROM p JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id
            ), r AS (
                SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN x USING (doc_id)
            ), c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r
            ), o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
            SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM c LEFT JOIN o USING (doc_id)""",
    }

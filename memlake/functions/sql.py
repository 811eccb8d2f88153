"""SQL functions for use in query text."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"
FUNCTIONS = {
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _DOT.format("a", "b")),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size(a) = size(b) AND {_DOT.format('a', 'a')} > 0 AND {_DOT.format('b', 'b')} > 0 THEN 1 - {_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')}) END"),
    "node_key": ("name STRING", "STRING", "translate(lower(name), ' \\'', '_')"),
    "hash_id": ("prefix STRING, content STRING", "STRING", "concat(prefix, md5(content))"),
}


def register(spark: SparkSession) -> None:
    """Registers them as temporary SQL functions; their bodies are inlined by the optimizer."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")

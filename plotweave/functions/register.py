"""Scalar functions for Spark SQL. They are SQL functions, so Catalyst inlines them; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .words import SIMILARITY_STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in SIMILARITY_STOP_WORDS)

FUNCTIONS = {
    "strip_verb_sense(v STRING)": ("STRING", r"regexp_replace(v, r'_-?[0-9]+$', '')"),
    "content_words(t STRING)": ("ARRAY<STRING>", rf"array_distinct(filter(split(lower(t), r'[ \t\n\x0B\f\r]+', -1), w -> length(w) > 1 AND NOT array_contains(array({_STOP}), w)))"),
    "jaccard_words(a STRING, b STRING)": ("DOUBLE", "CASE WHEN size(array_union(content_words(a), content_words(b))) = 0 THEN 0D ELSE size(array_intersect(content_words(a), content_words(b))) / size(array_union(content_words(a), content_words(b))) END"),
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "CASE WHEN dot(a, a) * dot(b, b) > 0 THEN dot(a, b) / sqrt(dot(a, a) * dot(b, b)) ELSE 0D END"),
    "rbo(a ARRAY<STRING>, b ARRAY<STRING>)": ("DOUBLE", "CASE WHEN least(size(a), size(b)) = 0 THEN 0D ELSE aggregate(transform(sequence(1, least(size(a), size(b))), d -> size(array_intersect(slice(a, 1, d), slice(b, 1, d))) / d), 0D, (s, x) -> s + x) / least(size(a), size(b)) END"),
    "salience(tf BIGINT, gf BIGINT)": ("DOUBLE", "CASE WHEN gf IS NULL THEN -1D ELSE (1 + pow(log10(tf), 2)) * log10(1e8 / gf) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session for spark.sql and F.expr; their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]

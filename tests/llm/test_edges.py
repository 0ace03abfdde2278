"""Nulls, repeated rows, empty tables and extra columns with the operators' own names."""

import pytest
from pyspark.sql import functions as F

from plotweave.llm import exact_dedup, fingerprints, html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, token_counts

OPERATORS = {
    "mixing": mixing.mix_sources, "exact": exact_dedup.exact_dedup, "fingerprints": fingerprints.fingerprints, "near": near_dedup.near_dedup, "licenses": licenses.scan_licenses,
    "lines": line_dedup.dedup_lines, "tokens": token_counts.count_tokens, "packing": packing.pack_documents, "quality": lambda d: quality.score_quality(d, quality.fit([], __import__("numpy").zeros(0, "f4"))),
}
CLASHING = ["size", "row", "key", "name", "bucket", "part", "guest", "shard", "ids", "a", "b", "n", "id", "text_sha256", "block", "row_id", "gone", "level", "content", "label", "score", "passes", "its_id", "t1", "bands", "start"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert OPERATORS[name](docs).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    long = "word " * 3000
    rows = [(None, None, None), (None, "x y z", "s"), (3, "x y z", None), (3, "x y z", None), (4, "", "s"), (4, None, "s"), (5, long, "s"), (6, long, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", F.lit(None).cast("string").alias("lang"), F.lit(1).cast("long").alias("n_chars"))
    plain = OPERATORS[name](docs)
    mixed = OPERATORS[name](docs.select(*[F.lit("clash").alias(c) for c in CLASHING], "*"))
    show = lambda df: sorted(str([r[c] for c in df.columns if c not in ("position", "passes", "sequence_id", "offset")]) for r in df.collect())
    if name in ("packing",):
        whole = lambda df: sorted(str((r.doc_id, r.doc_tokens)) for r in df.select("doc_id", "doc_tokens").distinct().collect())
        assert whole(plain) == whole(mixed)
    else:
        assert show(plain) == show(mixed)
        assert plain.count() == len(rows)


def test_pages_without_rows(spark):
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_near_dedup_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "d e f"), (None, "d e f"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (7, 7, True), (None, 7, False), (8, 8, True)], key=str)


def test_registered_queries():
    from plotweave.llm.queries import ORACLES, QUERIES

    assert [n for k in range(1, 11) for n in QUERIES if n.startswith(f"op{k}_")] and len(QUERIES) >= 10
    assert set(ORACLES) <= set(QUERIES)

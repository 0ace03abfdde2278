"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, hard_negatives, html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, token_counts, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_fingerprints": fingerprints.op3,
    "op4_quality": quality.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_packing": packing.op6,
    "op7_licenses": licenses.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_token_counts": token_counts.op9,
    "op10_html_text": html_text.op10,
    "op11_url_filter": url_filter.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}

"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import (
    centroid_heaps, code_bounds, inverted_multi_index, language_fusion, length_histogram, license_scan, line_frequency, piece_lattice, run_index, source_mix, token_groups, url_rules,
    vector_approx,
)

_QUERIES = {
    "op1_url_rules": url_rules,
    "op2_exact_top_k": vector_approx,
    "op3_run_index": run_index,
    "op4_license_scan": license_scan,
    "op5_length_histogram": length_histogram,
    "op6_language_fusion": language_fusion,
    "op7_piece_lattice": piece_lattice,
    "op8_quality_rules": line_frequency,
    "op9_source_mix": source_mix,
    "op10_token_groups": token_groups,
    "op11_inverted_multi_index": inverted_multi_index,
    "op12_centroid_heaps": centroid_heaps,
    "op13_code_bounds": code_bounds,
}


def queries() -> dict:
    return {name: module.query for name, module in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in _QUERIES.items() if getattr(module, "SQL", None)}

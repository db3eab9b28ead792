"""Operators of a training-data pipeline and the queries that run them.

``QUERIES`` and ``ORACLES`` hold what each operator's module registers.
"""

from __future__ import annotations

from claimsift.llm import bpe, curves, importance, language, linedup, merkle, minmax, mixing, offsets, pivots, quality, tokenfile, warc

QUERIES = {
    "op1_curve_neighbours": curves.query,
    "op2_warc_archive": warc.query,
    "op3_quality_attention": quality.query,
    "op4_line_dedup": linedup.query,
    "op5_source_schedule": mixing.query,
    "op6_token_attribution": offsets.query,
    "op7_minmax_duplicates": minmax.query,
    "op8_pivot_topk": pivots.query,
    "op9_token_files": tokenfile.query,
    "op10_tree_bpe": bpe.query,
    "op11_importance_sample": importance.query,
    "op12_language_kernel": language.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLES = {
    "op2_warc_archive": warc.ORACLE,
    "op5_source_schedule": mixing.ORACLE,
    "op7_minmax_duplicates": minmax.ORACLE,
    "op8_pivot_topk": pivots.ORACLE,
    "op11_importance_sample": importance.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}

"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from lodestone.llm import centroids, ctw, fingerprints, language, line_dedup, media, mixing, near_dedup, packing, token_files, toxicity, url_filters

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_language": language.op2_language,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_ctw": ctw.op6_ctw,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_ogg": media.op8_ogg,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_token_files": token_files.op11_token_files,
    "op12_centroids": centroids.op12_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op12_centroids": centroids.OP12_SQL,
}

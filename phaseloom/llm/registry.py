"""Registered queries of the text operators."""

from __future__ import annotations

from phaseloom.llm import bpe, clustering, decontaminate, html_extract, lang_id, line_dedup, lm_score, near_dedup, quality, ranked_search, token_counts, toxicity, warc

_MODULES = {
    "op6_bpe": bpe,
    "op1_html_extract": html_extract,
    "op9_lm_score": lm_score,
    "op2_quality_rules": quality,
    "op3_toxicity": toxicity,
    "op4_warc": warc,
    "op7_token_counts": token_counts,
    "op5_decontaminate": decontaminate,
    "op8_line_dedup": line_dedup,
    "op10_near_dedup": near_dedup,
    "op11_ranked_search": ranked_search,
    "op12_centroid_clusters": clustering,
    "op13_language_id": lang_id,
}


def queries() -> dict:
    import corpus_pipeline

    return {name: m.query for name, m in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}

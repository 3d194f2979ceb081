"""The subpackage's queries, by the name they are registered under, and their SQL."""

from __future__ import annotations

from . import ctw, embedding_dedup, fingerprints, html_extract, langid, line_dedup, mixing, pieces, simhash_dedup, token_output


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_token_shards": token_output.op4_token_shards,
        "op5_html_extract": html_extract.op5_html_extract,
        "op6_language_id": langid.op6_language_id,
        "op7_lm_scores": ctw.op7_lm_scores,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE}

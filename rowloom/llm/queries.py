"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from rowloom.llm import bpe, exact_dedup, html_text, lm_scores, media, mixing, near_dedup, secrets, token_files, toxicity


def queries():
    return {
        "op1_media": media.op1_media,
        "op2_bpe": bpe.op2_bpe,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_token_files": token_files.op4_token_files,
        "op5_html_text": html_text.op5_html_text,
        "op6_lm_scores": lm_scores.op6_lm_scores,
        "op7_secrets": secrets.op7_secrets,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_minhash": near_dedup.op9_minhash,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    out = {"op3_exact_dedup": exact_dedup.ORACLE, "op8_mix_sources": mixing.ORACLE}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import (
    attention_lm,
    collocations,
    decontaminate,
    embedding_dedup,
    jaccard_join,
    license_scan,
    line_dedup,
    line_quality,
    mixing,
    token_alignment,
    token_counts,
    toxicity,
    url_filter,
)


def queries() -> dict:
    """opN_<name>: a function of (spark, sf_dir)."""
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_lm_score": attention_lm.op2_lm_score,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_mixing": mixing.op4_mixing,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_line_quality": line_quality.op12_line_quality,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can express."""
    return {
        "op1_embedding_dedup": embedding_dedup.OP1_SQL,
        "op3_jaccard_join": jaccard_join.OP3_SQL,
        "op6_url_filter": url_filter.OP6_SQL,
        "op9_decontamination": decontaminate.OP9_SQL,
        "op12_line_quality": line_quality.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }

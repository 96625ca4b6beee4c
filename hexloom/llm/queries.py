"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from hexloom.llm import chat_format, decontaminate, jaccard_join, language_id, line_dedup, lm_scoring, quality, sentencepiece_codec, toxicity, vector_search


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepiece_codec.query,
        "op2_chat_format": chat_format.query,
        "op3_language_id": language_id.query,
        "op4_decontaminate": decontaminate.query,
        "op5_line_dedup": line_dedup.query,
        "op6_quality": quality.query,
        "op7_vector_search": vector_search.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_toxicity": toxicity.query,
        "op10_lm_scoring": lm_scoring.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.SQL, "op5_line_dedup": line_dedup.SQL, "op7_vector_search": vector_search.SQL, "op8_jaccard_join": jaccard_join.SQL}

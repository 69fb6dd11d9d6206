"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import conversations, decontam, licenses, lm, media, neardup, packing, quality, simhash, spelling, tokens, toxicity, urls


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_lm_scores": lm.op5_lm_scores,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_url_filter": urls.op8_url_filter,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_media_columns": media.op10_media_columns,
        "op11_simhash_duplicates": simhash.op11_simhash_duplicates,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_conversation_repair": conversations.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.SQL, "op2_near_duplicates": neardup.SQL, "op7_decontamination": decontam.SQL, "op8_url_filter": urls.SQL}

"""The operators' named queries, and SQL where it can say what they return."""

from . import (decontamination, hard_negatives, language_id, near_dedup, preference_quality, quality_rules, recompression, sentencepiece_bpe, sharding, suffix_dedup,
               token_codes, toxicity, whitening)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_token_codes": token_codes.op3_token_codes,
    "op4_recompression_dedup": recompression.op4_recompression_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_sampled_splitters": sharding.op6_sampled_splitters,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_sentencepiece": sentencepiece_bpe.op8_sentencepiece,
    "op9_preference_quality": preference_quality.op9_preference_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_whitening": whitening.op11_whitening,
    "op12_language_id": language_id.op12_language_id,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL: dict[str, str] = {"op5_quality_rules": quality_rules.OP5_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}

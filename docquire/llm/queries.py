"""The registered queries of this subpackage and their SQL."""

from . import decontam, mixing, near_dup, pii, quality, substring_dedup, suffix_dedup, tokens, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_near_duplicates": near_dup.op5_near_duplicates,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_personal_data": pii.op8_personal_data,
    "op9_warc": warc.op9_warc,
    "op10_tokens": tokens.op10_tokens,
}
ORACLES = {"op1_mixing": mixing.SQL, "op2_quality": quality.SQL, "op4_substring_dedup": substring_dedup.SQL, "op7_decontamination": decontam.SQL, "op9_warc": warc.SQL}

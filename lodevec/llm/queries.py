"""The queries of this subpackage and, where SQL can express them, their SQL."""

from lodevec.llm import ann, fingerprint, linededup, mixing, neardup, packing, pii, quality, repeats, toxicity

QUERIES = {
    "op10_ngram_jaccard": neardup.op10_ngram_jaccard,
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_collision_knn": ann.op2_collision_knn,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeated_substrings": repeats.op4_repeated_substrings,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_quality": quality.op6_quality,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op9_pii": pii.op9_pii,
    "op8_source_mix": mixing.op8_source_mix,
}

ORACLES = {
    "op5_line_dedup": linededup.OP5_SQL,
    "op8_source_mix": mixing.OP8_SQL,
}

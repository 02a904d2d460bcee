"""Registered queries of the training-data operators."""

from . import decontaminate, linededup, lmscore, mixing, neardup, periodic, pii, ranking, resampling, suffixdedup, tokens, topk, toxicity

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_repeats": suffixdedup.op5_repeats,
    "op6_topk": topk.op6_topk,
    "op7_neardup": neardup.op7_neardup,
    "op8_pii": pii.op8_pii,
    "op9_lm_score": lmscore.op9_lm_score,
    "op10_tokens": tokens.op10_tokens,
    "op11_resample": resampling.op11_resample,
    "op12_runs": periodic.op12_runs,
    "op13_quality": ranking.op13_quality,
}

ORACLES = {
    "op1_mix": mixing.ORACLE,
    "op6_topk": topk.ORACLE,
    "op11_resample": resampling.ORACLE,
}

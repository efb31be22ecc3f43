"""One registered query per operator, each over the whole of its table, and their SQL where SQL can express them."""

from assayframe.llm import (
    decontaminate, exact_dedup, html, langid, lmscore, mixing, quality, sharding, simhash, tokenalign, tokencounts, toxicity, whitening,
)

QUERIES = {
    "op1_html": html.op1_html,
    "op2_mixing": mixing.op2_mixing,
    "op3_language": langid.op3_language,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_counts": tokencounts.op10_token_counts,
    "op11_lm_score": lmscore.op11_lm_score,
    "op12_whitening": whitening.op12_whitening,
    "op13_token_alignment": tokenalign.op13_token_alignment,
}
#: The sharding query returns a CRC-32 of each text, for which DuckDB has no function.
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}

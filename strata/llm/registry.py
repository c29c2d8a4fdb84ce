"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import conversations, decontaminate, exact_dedup, licenses, lm_score, mixing, quality, secrets, simhash, spelling, surrogates, token_counts, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
    "op11_repair_conversations": conversations.op11_repair_conversations,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_spelling": spelling.op13_spelling,
}
SQL = {"op5_decontaminate": decontaminate.OP5_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op12_license_scan": licenses.OP12_SQL}

"""The registered queries of the text operators and their SQL, for the entry module."""

from __future__ import annotations

from . import op1_quality_rules, op2_substring, op6_decontaminate, op13_ranked_search, textkit
from .op1_quality_rules import op1_quality_rules as op1
from .op2_substring import op2_substring_dedup
from .op3_simhash import op3_simhash_near_dedup
from .op4_toxicity import op4_toxicity
from .op5_quality import op5_quality_classifier
from .op6_decontaminate import op6_decontamination
from .op7_tokens import op7_token_binary
from .op8_language import op8_language_id
from .op9_packing import op9_best_fit_packing
from .op10_lm import op10_lm_scoring
from .op11_alignment import op11_token_alignment
from .op12_counts import op12_token_counts


def _bounded(query):
    def run(spark, sf_dir):
        textkit.bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_quality_rules": op1,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_token_binary": op7_token_binary,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_search": op13_ranked_search.op13_ranked_search,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_quality_rules": op1_quality_rules.ORACLE,
    "op2_substring_dedup": op2_substring.ORACLE,
    "op6_decontamination": op6_decontaminate.ORACLE,
    "op13_ranked_search": op13_ranked_search.ORACLE,
}

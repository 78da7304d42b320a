"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from codequarry.llm import bpe, hard_negatives, jaccard_join, merkle, mixing, nearest_neighbours, pii, quality_classifier, quality_rules, substring_dedup, suffix_dedup, suffix_tree_lm, token_counts


def queries() -> dict:
    found = [
        substring_dedup.op1_substring_dedup,
        quality_rules.op2_quality_rules,
        token_counts.op3_token_counts,
        quality_classifier.op4_quality_classifier,
        pii.op5_pii,
        suffix_dedup.op6_suffix_dedup,
        jaccard_join.op7_jaccard_join,
        nearest_neighbours.op8_nearest_neighbours,
        bpe.op9_bpe,
        mixing.op10_mixing,
        suffix_tree_lm.op11_suffix_tree_lm,
        hard_negatives.op12_hard_negatives,
        merkle.op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_merkle_manifest": merkle.SQL}

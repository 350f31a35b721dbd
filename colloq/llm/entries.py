"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bayes_dedup, bin_packing, block_names, entropy_mix, fuzzy_lines, html_blocks, robust_rules, token_spans, toxicity, warc


def queries() -> dict:
    return {
        "op1_token_counts": token_spans.op1_token_counts,
        "op2_fuzzy_lines": fuzzy_lines.op2_fuzzy_lines,
        "op3_exact_dedup": block_names.op3_exact_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html_extraction": html_blocks.op5_html_extraction,
        "op6_quality_rules": robust_rules.op6_quality_rules,
        "op7_warc": warc.op7_warc,
        "op8_minhash_near_dedup": bayes_dedup.op8_minhash_near_dedup,
        "op9_bin_packing": bin_packing.op9_bin_packing,
        "op10_entropy_mixing": entropy_mix.op10_entropy_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": block_names.ORACLE}

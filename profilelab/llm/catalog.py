"""Registered queries of this package and their SQL."""

from __future__ import annotations

from profilelab.llm import (decontaminate, fill_in_middle, html_extract, line_dedup, near_dups, packing, quality_rules, secrets, suffix_dedup, toxicity,
                            vector_dups, warc, whitening)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_minhash_near_dedup": near_dups.op4_minhash_near_dedup,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_warc_bundles": warc.op6_warc_bundles,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_pivot_permutation": vector_dups.op11_pivot_permutation,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_minhash_near_dedup": near_dups.ORACLE,
    "op6_warc_bundles": warc.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}

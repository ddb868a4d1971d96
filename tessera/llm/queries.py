"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import curve_neighbours, decontamination, exact_dedup, filter_audit, html_text, license_scan, lm_scores, mixing, near_dedup, secrets, spelling, substring_dedup, toxicity

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_lm_scores": lm_scores.op4_lm_scores,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_entropy_balancing": mixing.op10_entropy_balancing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_curve_neighbours": curve_neighbours.op12_curve_neighbours,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op1_minhash_near_dedup": near_dedup.SQL,
    "op4_lm_scores": lm_scores.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
}

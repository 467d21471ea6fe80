"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, html_template, licenses, near_dedup, packing, quality, quotes, secrets, toxicity

QUERIES = {
    "op1_quality_ratio": quality.op1_quality_ratio,
    "op2_quote_linking": quotes.op2_quote_linking,
    "op3_pack_power_of_two": packing.op3_pack_power_of_two,
    "op4_html_template": html_template.op4_html_template,
    "op5_bpe_transducer": bpe.op5_bpe_transducer,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
}

#: The others can't be said in SQL over whole tables; tests/llm compares them with brute force.
SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
}

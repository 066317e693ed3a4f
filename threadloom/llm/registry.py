"""The subpackage's queries by name, and their DuckDB counterparts."""

from __future__ import annotations

from . import decontaminate, gated_lm, jaccard, mixing, periodic, pii, quality, repeats, spelling, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_pii_spans": pii.query,
    "op2_string_tiling": decontaminate.query,
    "op3_url_rules": url_filter.query,
    "op4_jaccard_join": jaccard.query,
    "op5_gated_lm": gated_lm.query,
    "op6_quality_lines": quality.query,
    "op7_repeated_bytes": repeats.query,
    "op8_toxicity_ftrl": toxicity.query,
    "op9_source_mixing": mixing.query,
    "op10_warc_revisits": warc.query,
    "op11_spelling_variants": spelling.query,
    "op12_periodic_runs": periodic.query,
    "op13_token_counts": token_counts.query,
}
ORACLES = {
    "op10_warc_revisits": warc.ORACLE,
}

"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pressmill.llm import op1_gif, op2_sharding, op10_lines, op11_language, op12_clusters, op13_prefixes, op3_minhash, op4_toxicity, op5_licenses, op6_packing, op7_html, op8_warc, op9_decontaminate

QUERIES = {
    "op1_gif": op1_gif.query,
    "op2_minimax_shards": op2_sharding.query,
    "op3_minhash_dedup": op3_minhash.query,
    "op4_toxicity_mil": op4_toxicity.query,
    "op5_license_scan": op5_licenses.query,
    "op6_harmonic_packing": op6_packing.query,
    "op7_html_bp": op7_html.query,
    "op8_seekable_warc": op8_warc.query,
    "op9_lsa_decontamination": op9_decontaminate.query,
    "op10_fuzzy_lines": op10_lines.query,
    "op11_cross_parsing": op11_language.query,
    "op12_delta_lloyd": op12_clusters.query,
    "op13_prefix_trie": op13_prefixes.query,
}
ORACLE_SQL: dict[str, str] = {"op8_seekable_warc": op8_warc.ORACLE_SQL, "op12_delta_lloyd": op12_clusters.ORACLE_SQL, "op13_prefix_trie": op13_prefixes.ORACLE_SQL}

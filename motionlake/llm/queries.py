"""The operators' registered queries and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprints, html_text, language, merkle, mixing, prefix_trie, quality_cnn, quality_rules, simhash, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_toxicity": toxicity.query,
    "op3_quality_cnn": quality_cnn.query,
    "op4_simhash": simhash.query,
    "op5_quality_rules": quality_rules.query,
    "op6_language": language.query,
    "op7_decontaminate": decontaminate.query,
    "op8_html_text": html_text.query,
    "op9_mixing": mixing.query,
    "op10_token_output": token_output.query,
    "op11_fingerprints": fingerprints.query,
    "op12_merkle_manifest": merkle.query,
    "op13_prefix_trie": prefix_trie.query,
}

SQL = {
    "op5_quality_rules": quality_rules.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}

"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from . import (
    byte_bpe,
    graph_search,
    license_scan,
    merkle_manifest,
    ngram_join,
    packing,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    target_sampling,
    token_counts,
    toxicity,
    warc,
)

_MODULES = {
    "op1_substring_dedup": substring_dedup,
    "op2_graph_search": graph_search,
    "op3_token_counts": token_counts,
    "op4_warc": warc,
    "op5_packing": packing,
    "op6_byte_bpe": byte_bpe,
    "op7_quality_rules": quality_rules,
    "op8_ngram_join": ngram_join,
    "op9_toxicity": toxicity,
    "op10_license_scan": license_scan,
    "op11_merkle_manifest": merkle_manifest,
    "op12_suffix_dedup": suffix_dedup,
    "op13_target_sampling": target_sampling,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
SQL = {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}

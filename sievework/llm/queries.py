"""The corpus operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from sievework.llm import bagminhash, divergence, filter_audit, huffman, licenses, mixing, preference, quality, setjoin, sharding, substrings, templates, warc

QUERIES = {
    "op1_warc_zstd": warc.query,
    "op2_preference_pairs": preference.query,
    "op3_bagminhash_near_dups": bagminhash.query,
    "op4_repeated_substrings": substrings.query,
    "op5_template_decontamination": templates.query,
    "op6_quality_rules": quality.query,
    "op7_hash_tree_sharding": sharding.query,
    "op8_license_scan": licenses.query,
    "op9_source_mixing": mixing.query,
    "op10_huffman_token_ids": huffman.query,
    "op11_filter_audit": filter_audit.query,
    "op12_set_join": setjoin.query,
    "op13_source_divergence": divergence.query,
}
ORACLES = {
    "op1_warc_zstd": warc.ORACLE,
    "op2_preference_pairs": preference.ORACLE,
    "op5_template_decontamination": templates.oracle(),
    "op6_quality_rules": quality.oracle(),
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}

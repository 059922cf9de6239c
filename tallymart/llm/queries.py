"""The queries of this subpackage by name, and SQL for those that have it."""

from __future__ import annotations

from tallymart.llm import (
    byte_bpe,
    chat_format,
    fill_in_middle,
    jaccard_join,
    katz,
    language_id,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    substring_dedup,
    vector_search,
)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op10_vector_search": vector_search.op10_vector_search,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_katz": katz.op5_katz,
    "op6_language_id": language_id.op6_language_id,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_chat_format": chat_format.op8_chat_format,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op10_vector_search": vector_search.OP10_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
}

"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import conversation_trie, decontaminate, exact_dedup, html_text, language_id, mix_sources, quality, simhash, substring_dedup, suffix_dedup, token_counts, topk_search, whitening

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_source_mixing": mix_sources.op5_source_mixing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_cotraining": quality.op7_quality_cotraining,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_topk": topk_search.op9_exact_topk,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
#: Where SQL can express the query.
ORACLES = {
    "op1_benchmark_decontamination": decontaminate.OP1_SQL,
    "op3_suffix_array_dedup": suffix_dedup.OP3_SQL,
    "op5_source_mixing": mix_sources.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op9_exact_topk": topk_search.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
}

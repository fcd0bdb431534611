"""The opN queries and their SQL, gathered from the operator modules."""

from __future__ import annotations

from quillstone.llm import chat_format, decontaminate, language_id, pieces, pseudonyms, quality_classifier, quality_rules, ranked_search, simhash, source_mix, suffix_dedup, token_counts, vector_codes

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op6_pseudonyms": pseudonyms.op6_pseudonyms,
    "op8_token_counts": token_counts.op8_token_counts,
    "op10_pieces": pieces.op10_pieces,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op7_chat_format": chat_format.op7_chat_format,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_source_mix": source_mix.op12_source_mix,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE_SQL = {"op7_chat_format": chat_format.OP7_SQL, "op11_ranked_search": ranked_search.OP11_SQL, "op12_source_mix": source_mix.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}

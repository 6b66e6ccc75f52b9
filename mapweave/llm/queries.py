"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, hard_negatives, knn_quality, mixing, page_text, pieces, pii, quality_rules, simhash, suffix_dedup, token_files, vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        quality_rules.op1_quality_rules,
        pieces.op2_sentence_pieces,
        exact_dedup.op3_exact_dedup,
        token_files.op4_token_files,
        knn_quality.op5_quality_classifier,
        suffix_dedup.op6_suffix_dedup,
        mixing.op7_source_mixing,
        pii.op8_pii,
        chat.op9_chat_formatting,
        simhash.op10_simhash_near_dedup,
        hard_negatives.op11_hard_negatives,
        page_text.op12_page_text,
        vector_codes.op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op9_chat_formatting": chat.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}

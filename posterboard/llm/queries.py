"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, hard_negatives, katz, ngram_join, packing, pieces, quality_classifier, quality_rules, spotsigs, token_counts, url_reputation, vector_codes, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_url_reputation": url_reputation.op2_url_reputation,
    "op3_katz": katz.op3_katz,
    "op4_warc": warc.op4_warc,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "spotsigs_classes": spotsigs.spotsigs_classes,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {
    "op2_url_reputation": url_reputation.OP2_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}

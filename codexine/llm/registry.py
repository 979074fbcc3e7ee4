"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, conversation_repair, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secret_scan, simhash, token_alignment, toxicity, vector_topk

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_packing": packing.op2_packing,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_vector_topk": vector_topk.op5_vector_topk,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_simhash": simhash.op12_simhash,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLE_SQL = {"op5_vector_topk": vector_topk.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL}

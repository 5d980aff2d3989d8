"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, fingerprints, lexical, licenses, mixing, multiindex, pieces, quality, simhash, substrings, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": tokens.op1_token_ids,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_chat_format": chat.op3_chat_format,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_simhash_dedup": simhash.op10_simhash_dedup,
        "op11_rank_documents": lexical.op11_rank_documents,
        "op12_nearest_vectors": multiindex.op12_nearest_vectors,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.OP2_SQL, "op3_chat_format": chat.OP3_SQL, "op4_license_scan": licenses.OP4_SQL, "op9_substring_dedup": substrings.OP9_SQL, "op11_rank_documents": lexical.OP11_SQL, "op12_nearest_vectors": multiindex.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}

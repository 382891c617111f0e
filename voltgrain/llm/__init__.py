"""Operations of a training-data pipeline. queries() and oracle_sql() are what the entry file adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltgrain.llm import bpe, chat, jaccard, line_dedup, lm, merkle, mixing, phrases, quality, topk, toxicity, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_warc": warc.op2_warc,
        "op3_topk": topk.op3_topk,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_bpe_encoding": bpe.op5_bpe_encoding,
        "op6_lm_scoring": lm.op6_lm_scoring,
        "op7_source_mixing": mixing.op7_source_mixing,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_url_filter": urls.op9_url_filter,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
        "op11_chat_formatting": chat.op11_chat_formatting,
        "op12_phrase_mining": phrases.op12_phrase_mining,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    """op1 and op4 to op10 are beyond SQL; tests compare them with brute force."""
    return {
        "op2_warc": warc.OP2_SQL,
        "op3_topk": topk.OP3_SQL,
        "op11_chat_formatting": chat.OP11_SQL,
        "op12_phrase_mining": phrases.OP12_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }

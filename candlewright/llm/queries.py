"""The corpus operators as queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm import decontaminate, importance, jaccard, mixing, oracles, packing, phrases, secrets, substrings, token_counts, toxicity, urls, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_secrets": secrets.op4_secrets,
        "op5_embedding_neardup": vectors.op5_embedding_neardup,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_url_filter": urls.op7_url_filter,
        "op8_warc": warc.op8_warc,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
        "op11_phrases": phrases.op11_phrases,
        "op12_packing": packing.op12_packing,
        "op13_importance": importance.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracles.DECONTAMINATION,
        "op5_embedding_neardup": vectors.ORACLE_SQL,
        "op6_substring_dedup": oracles.SUBSTRINGS,
        "op7_url_filter": urls.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op10_jaccard_join": oracles.JACCARD,
        "op11_phrases": phrases.ORACLE_SQL,
    }

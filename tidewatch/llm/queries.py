"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, decontaminate, filter_audit, lines, mixing, oracle, quality, sharding, simhash, token_counts, toxicity, vectors, warc
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
        "op2_decontamination": lambda s, d: decontaminate.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_embedding_dedup": lambda s, d: vectors.query(table(s, d, "embeddings")),
        "op4_sharding": lambda s, d: sharding.query(table(s, d, "documents")),
        "op5_chat_format": lambda s, d: chat.query(table(s, d, "conversations")),
        "op6_simhash_dedup": lambda s, d: simhash.query(table(s, d, "documents")),
        "op7_mixing": lambda s, d: mixing.query(table(s, d, "documents")),
        "op8_quality": lambda s, d: quality.query(table(s, d, "documents"), table(s, d, "labels")),
        "op9_warc": lambda s, d: warc.query(table(s, d, "pages")),
        "op10_token_counts": lambda s, d: token_counts.query(table(s, d, "documents")),
        "op11_line_dedup": lambda s, d: lines.query(table(s, d, "documents")),
        "op12_vector_codes": lambda s, d: codes.query(table(s, d, "embeddings")),
        "op13_filter_audit": lambda s, d: filter_audit.query(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)

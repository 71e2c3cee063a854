"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cellkpi.llm.byte_dedup import remove_repeated_bytes
from cellkpi.llm.byte_pairs import encode_decode
from cellkpi.llm.common import table
from cellkpi.llm.hard_negatives import hard_negative_query
from cellkpi.llm.license_scan import license_query
from cellkpi.llm.line_quality import quality_report
from cellkpi.llm.mixture import mixing_report
from cellkpi.llm.neighbours import neighbours_query
from cellkpi.llm.oracle import oracle_sql
from cellkpi.llm.phrase_dedup import remove_repeated_phrases
from cellkpi.llm.private_data import find_private
from cellkpi.llm.simhash_dedup import near_duplicates
from cellkpi.llm.token_counts import count_tokens
from cellkpi.llm.transcripts import render_transcripts
from cellkpi.llm.whitening import whitening_query

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_quality": lambda s, d: quality_report(table(s, d, "documents")),
        "op2_token_counts": lambda s, d: count_tokens(table(s, d, "documents")),
        "op3_neighbours": lambda s, d: neighbours_query(table(s, d, "embeddings")),
        "op4_transcripts": lambda s, d: render_transcripts(table(s, d, "conversations")),
        "op5_simhash_dedup": lambda s, d: near_duplicates(table(s, d, "documents")),
        "op6_byte_pairs": lambda s, d: encode_decode(table(s, d, "documents")),
        "op7_private_data": lambda s, d: find_private(table(s, d, "documents")).drop("found"),
        "op8_source_mixture": lambda s, d: mixing_report(table(s, d, "documents")),
        "op9_phrase_dedup": lambda s, d: remove_repeated_phrases(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
        "op10_byte_dedup": lambda s, d: remove_repeated_bytes(table(s, d, "documents")),
        "op11_whitening": lambda s, d: whitening_query(table(s, d, "embeddings")),
        "op12_hard_negatives": lambda s, d: hard_negative_query(table(s, d, "embeddings")),
        "op13_license_scan": lambda s, d: license_query(table(s, d, "documents")),
    }

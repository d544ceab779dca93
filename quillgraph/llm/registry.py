"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import ann, bpe, decontaminate, filter_audit, jaccard_join, langid, licences, mixing, periods, repeats, secrets, sharding, tokenfile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_prefix_doubling": repeats.op1_prefix_doubling,
        "op2_language_kernels": langid.op2_language_kernels,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_adaptive_scan": ann.op4_adaptive_scan,
        "op5_wavelet_tokens": tokenfile.op5_wavelet_tokens,
        "op6_minimax_shards": sharding.op6_minimax_shards,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_licence_rules": licences.op9_licence_rules,
        "op10_secret_models": secrets.op10_secret_models,
        "op11_block_periods": periods.op11_block_periods,
        "op12_byte_bpe": bpe.op12_byte_bpe,
        "op13_filter_audit": filter_audit.op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.OP3_SQL, "op8_jaccard_join": jaccard_join.OP8_SQL, "op9_licence_rules": licences.OP9_SQL, "op13_filter_audit": filter_audit.OP13_SQL}

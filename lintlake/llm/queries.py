"""One query per operator, with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import (
    decontamination, hard_negatives, line_dedup, lm_scoring, near_dedup, pii_crf, secret_scan,
    source_mixing, substring_dedup, token_count, topk_search, toxicity, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_exact_topk": topk_search.op1_exact_topk,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_source_mixing": source_mixing.op4_source_mixing,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_token_count": token_count.op6_token_count,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_pii_crf": pii_crf.op11_pii_crf,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_exact_topk": topk_search.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_source_mixing": source_mixing.OP4_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}

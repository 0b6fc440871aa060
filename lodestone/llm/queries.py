"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, licenses, lines, minhash, mtree, substrings, tokencounts, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_minhash": minhash.op2_minhash,
    "op3_bpe": bpe.op3_bpe,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_token_counts": tokencounts.op5_token_counts,
    "op6_url_filters": urls.op6_url_filters,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_licenses": licenses.op9_licenses,
    "op10_mtree": mtree.op10_mtree,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.SQL,
    "op4_substring_dedup": substrings.SQL,
    "op6_url_filters": urls.SQL,
    "op9_licenses": licenses.SQL,
    "op10_mtree": mtree.SQL,
}

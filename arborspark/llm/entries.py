"""The queries of this subpackage and their DuckDB forms, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, kdtree, language_id, minhash, packing, sharding, simhash, substring_dedup, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": simhash.op1_fingerprints,
    "op2_language_id": language_id.op2_language_id,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_near_duplicates": minhash.op5_near_duplicates,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_top_k": kdtree.op10_top_k,
}

#: Those whose rows SQL can give on whole tables.
ORACLES: dict[str, str | None] = {}

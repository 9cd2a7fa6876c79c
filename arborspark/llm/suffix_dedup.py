"""Exact removal of repeated byte strings by distributed prefix doubling.

Ranks of the 8 bytes from each position are the bytes themselves; a rank of 2h
bytes is that of the pair (rank of h bytes here, rank of h bytes at offset h).
Offsets grow 8, 16, then 18, which reaches the 50 bytes of the threshold.  A
pair's rank is a 64-bit hash of it, so equal strings get equal ranks everywhere
without a global sort of all positions per round; the sorts happen where ranks
decide: the ranks of sampled positions meet by value (:mod:`.repeats`), the ones
that are unique drop out, and only what is left is ranked at the next offset.
Each 50-byte string holds a sampled position, chosen by its own bytes.

Defined cases: a null text is empty; repeated rows of one doc_id do not remove
one another; a null doc_id counts as 2**63 - 1;
an empty table gives no rows.
Matches may begin within a character; the kept bytes are hashed as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import covered, keyed, with_runs
from .shared import column_of, documents, over_texts


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        gone = covered(batch, at)
        before = np.concatenate([[0], np.cumsum(gone)])
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = at[:-1][np.diff(at) > 0]
        starts[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(starts)])
        digests = [hashlib.sha256(raw[a:b][~gone[a:b]] if before[a] != before[b] else raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.record_batch([column_of(batch, "given"), pa.array(np.diff(at)), pa.array(np.diff(before[at])), pa.array(np.diff(spans[at])), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return over_texts(with_runs(keyed(docs, F.col("doc_id").cast("long").alias("given")), "bytes"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))

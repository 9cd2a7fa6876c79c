"""Removal of repeated passages of 50 words by recompression.

Rounds of recompression (:mod:`.recompression`) name runs and pairs of words
alike in all documents, so equal passages have equal symbols inside.  The symbol
of the highest level that a window's own words determine is the window's
anchor; shared symbols reveal candidates, whose windows are then verified one
by one (:mod:`.repeats`).

Defined cases: a null text has no words; repeated rows of one doc_id do not
remove one another; a null doc_id counts as 2**63 - 1;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .repeats import covered, keyed, with_runs
from .shared import column_of, documents, over_texts, words


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        _, _, of = words(raw, at)
        gone = covered(batch, of)
        before = np.concatenate([[0], np.cumsum(gone)])
        text, digests = raw.tobytes(), []
        for row in range(len(at) - 1):
            own = text[at[row] : at[row + 1]].split()
            if before[of[row]] != before[of[row + 1]]:
                own = [w for w, x in zip(own, gone[of[row] : of[row + 1]].tolist(), strict=True) if not x]
            digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.record_batch([column_of(batch, "given"), pa.array(np.diff(of)), pa.array(np.diff(before[of])), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return over_texts(with_runs(keyed(docs, F.col("doc_id").cast("long").alias("given")), "words"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, any columns, with repeated words cut out of their texts, each up to the next kept word.

    Texts without repeats stay as they are, a null one too; rows of which every word is a repeat go.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != "text")).alias("others"), "doc_id", "text", F.col("text").isNull().alias("bare"))
    whole = keyed(whole, "others", "bare")

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        start, _, of = words(raw, at)
        gone = covered(batch, of)
        before = np.concatenate([[0], np.cumsum(gone)])
        texts = []
        for row in range(len(at) - 1):
            a, b, p, q = at[row], at[row + 1], of[row], of[row + 1]
            own = raw[a:b]
            if before[p] != before[q]:
                # a byte goes with the word that it belongs to or follows; leading space stays
                word = np.searchsorted(start[p:q], np.arange(a, b), "right") - 1
                own = own[~(gone[p:q][np.maximum(word, 0)] & (word >= 0))]
            texts.append(own.tobytes().decode("utf-8"))
        whole = pa.array((np.diff(before[of]) < np.diff(of)) | (np.diff(of) == 0))
        return pa.record_batch([column_of(batch, "others"), column_of(batch, "bare"), pa.array(texts, pa.string())], names=["others", "bare", "text"]).filter(whole)

    made = over_texts(with_runs(whole, "words"), run, StructType([whole.schema["others"], whole.schema["bare"], StructField("text", StringType())]))
    return made.select(*(F.col(f"others.`{c}`") if c != "text" else F.when(~F.col("bare"), F.col("text")).alias("text") for c in columns))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(documents(spark, sf_dir))

"""From documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.

Defined cases: rows with a null or letterless text are rejected by the first
stage; the second stage compares all rows, whatever their doc_id, even a null
one, and of rows with one doc_id and one text the least stays; a text from which
passages are cut has its n_chars counted anew; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.language_id import fit, identify
from arborspark.llm.minhash import near_duplicates
from arborspark.llm.packing import pack_documents
from arborspark.llm.shared import BROADCAST_IDS, cut, stored
from arborspark.llm.substring_dedup import without_repeats


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the models recognise."""
    told = identify(docs, fit(docs, F.lit(True)))
    return told.where(F.col(told.columns[-1])).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id: similarity 0.8 on shingles of five words.

    Rows go by a 64-bit hash of doc_id and text, as several texts may have one doc_id, or none.
    """
    keyed = docs.withColumn("near_key_", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    classes = cut(near_duplicates(keyed.select(F.col("near_key_").alias("doc_id"), "text"), shingle_words=5, percent=80).select(F.col("doc_id").alias("near_key_"), "component_id", "kept"))
    several = classes.where(~F.col("kept")).select("component_id").distinct()
    members = classes.join(several, "component_id", "left_semi").select("near_key_", "component_id").distinct()
    ids = keyed.select("near_key_", "doc_id").distinct()
    least = members.join(ids, "near_key_").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "near_key_")).alias("best")).select("component_id", F.col("best.near_key_").alias("stays"))
    dropped = cut(members.join(least, "component_id").where("near_key_ <> stays").select("near_key_"))
    again = cut(classes.groupBy("near_key_").count().where("count > 1").select("near_key_"))
    light = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kept = keyed.join(light(dropped), "near_key_", "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # one doc_id and one text on several rows: one of them stays
    lone = kept.join(light(again), "near_key_", "left_anti")
    one = kept.join(light(again), "near_key_", "left_semi").groupBy("near_key_").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return lone.select(*docs.columns).union(one.select("row.*"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 50 words that a document of a smaller id has."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 4096."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("near_copies", near_copy_stage), ("repeated_passages", substring_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages' models and hashes have no SQL form; tests hold near_copies against brute force, of the other stages columns and falling counts only.
ORACLE_SQL = None

"""Similarity networks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.letters import complex_similarity, fragments, letter_pairs


def similarities(pairs: DataFrame, separator: str = ";", removed: str = "") -> DataFrame:
    """pairs (a, b, ...) with similarity."""
    return pairs.withColumn("similarity", complex_similarity(F.col("a"), F.col("b"), separator, removed))


def network(texts: DataFrame, separator: str = ";", removed: str = "", distinct: bool = False) -> DataFrame:
    """a, b, similarity of every text (id, text) with every later one; ids order them.

    Fragments are compared where they share a letter pair, through an index of
    pairs; the others have similarity 0, and only the last step lists all pairs.
    Among equal texts with distinct, the first stays.
    """
    if distinct:
        texts = texts.groupBy("text").agg(F.min("id").alias("id"))
    parts = texts.select("id", F.posexplode(fragments(F.col("text"), separator, removed)).alias("pos", "fragment"))
    whole = parts.groupBy("id").agg(F.count("*").alias("fragments"))
    kinds = parts.select("fragment").distinct()
    times = kinds.select("fragment", F.explode(letter_pairs(F.col("fragment"))).alias("pair")).groupBy("fragment", "pair").agg(F.count("*").alias("n"))
    size = times.groupBy("fragment").agg(F.sum("n").alias("size"))
    one = times.select(F.col("fragment").alias("x"), "pair", F.col("n").alias("nx"))
    two = times.select(F.col("fragment").alias("y"), "pair", F.col("n").alias("ny"))
    both = one.join(two, "pair").groupBy("x", "y").agg(F.sum(F.least("nx", "ny")).alias("both"))
    alike = both.join(size.select(F.col("fragment").alias("x"), F.col("size").alias("sx")), "x").join(size.select(F.col("fragment").alias("y"), F.col("size").alias("sy")), "y").select("x", "y", (2.0 * F.col("both") / (F.col("sx") + F.col("sy"))).alias("s"))
    # an empty fragment compares as -1 with any, itself included: it never beats another, and decides only if alone
    left = parts.select(F.col("id").alias("a"), "pos", F.col("fragment").alias("x"))
    found = left.join(alike, "x").join(parts.select(F.col("id").alias("b"), F.col("fragment").alias("y")), "y")
    best = found.groupBy("a", "pos", "b").agg(F.max("s").alias("s")).groupBy("a", "b").agg(F.sum("s").alias("s"))
    ids = texts.select("id", "text").join(whole, "id")
    grid = ids.select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.col("fragments").alias("na")).withColumn("k_", F.lit(1)).join(ids.select(F.col("id").alias("b"), F.col("text").alias("text_b"), F.col("fragments").alias("nb")).withColumn("k_", F.lit(1)), "k_").where("a < b")
    out = grid.join(best.withColumnRenamed("s", "forth"), ["a", "b"], "left").join(best.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("s").alias("back")), ["a", "b"], "left").na.fill(0.0, ["forth", "back"])
    return out.select(F.col("text_a").alias("a"), F.col("text_b").alias("b"), ((F.col("forth") / F.col("na") + F.col("back") / F.col("nb")) / 2).alias("similarity"))


def numbered(texts: DataFrame, order: str) -> DataFrame:
    """id, text: distinct texts with their rank in the order of a column, for network()."""
    firsts = texts.groupBy("text").agg(F.min(order).alias("o_"))
    return firsts.select(F.row_number().over(Window.orderBy("o_", "text")).alias("id"), "text")

"""Enrichment of a term's items in an external list of items: plain Fisher tests, elim and weight.

Terms are taken level by level, from the deepest; each level is one set of
joins.  Only the loop over levels is sequential, as its results decide what
higher levels see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fisher import fisher_two_sided
from ..model import Ontology
from . import graph
from .cuts import cut


def fisher_by_term(items: DataFrame, external: DataFrame, total: int) -> DataFrame:
    """term, p_value of each term's items (term, item) against the external items (item)."""
    external = external.select("item").distinct()
    n = external.count()
    met = items.select("term", "item").distinct().join(external.withColumn("hit", F.lit(1)), "item", "left").groupBy("term").agg(F.count("hit").alias("a"), F.count("*").alias("n"))
    b, c = F.lit(n) - F.col("a"), F.col("n") - F.col("a")
    return met.select("term", fisher_two_sided(F.col("a"), b, c, F.lit(total) - F.col("a") - b - c).alias("p_value"))


def first_parents(onto: Ontology) -> DataFrame:
    return onto.edges.groupBy(F.col("child").alias("term")).agg(F.min_by("parent", F.struct("pos", "parent")).alias("parent"))


def shortest_parents(onto: Ontology) -> DataFrame:
    """term, parent: the second node of the term's first shortest way upwards."""
    level = onto.meta.select(F.col("term").alias("parent"), "level")
    return onto.edges.join(level, "parent").groupBy(F.col("child").alias("term")).agg(F.min_by("parent", F.struct("level", "pos", "parent")).alias("parent"))


def connected(onto: Ontology, items: DataFrame) -> DataFrame:
    """term, level: the terms that have items and, level by level, shortest parents of all, up to the least level among them."""
    start = cut(items.select("term").distinct().join(onto.meta.select("term", "level"), "term"))
    bounds = start.agg(F.min("level").alias("low"), F.max("level").alias("high")).first()
    if bounds["low"] is None:
        return start
    up = shortest_parents(onto)
    state = start
    for level in range(bounds["high"], bounds["low"], -1):
        above = state.where(F.col("level") == level).join(up, "term").select(F.col("parent").alias("term"), F.lit(level - 1).alias("level"))
        state = cut(state.union(above).distinct())
    return state


def inherited(onto: Ontology, items: DataFrame, levels: DataFrame, strict: bool = False) -> DataFrame:
    """term, item: each term's items with those of the terms whose first parents lead to it.

    With strict a parent takes over from the child processed last only (the one
    of the greatest id), as a plain overwriting table would; else from all.
    """
    own = items.select("term", "item").distinct()
    up = first_parents(onto)
    bounds = levels.agg(F.min("level").alias("low"), F.max("level").alias("high")).first()
    state = cut(own)
    for level in range(bounds["high"] or 0, bounds["low"] or 0, -1):
        here = levels.where(F.col("level") == level).select("term").join(up, "term")
        if strict:
            here = here.groupBy("parent").agg(F.max("term").alias("term"))
        state = cut(state.union(here.join(state, "term").select(F.col("parent").alias("term"), "item")).distinct())
    return state


def elim(onto: Ontology, items: DataFrame, external: DataFrame, total: int, threshold: float, strict: bool = False) -> DataFrame:
    """term, level, p_value: items of a significant term count no longer for its ancestors.

    Terms of one level are tested together; an ancestor on the same or a deeper
    level than its descendant is not affected by it.
    """
    levels = connected(onto, items)
    held = inherited(onto, items, levels, strict)
    external = cut(external.select("item").distinct())
    n_external = external.count()
    spark = items.sparkSession
    gone = spark.createDataFrame([], held.schema)
    results = []
    for level in sorted((r[0] for r in levels.select("level").distinct().collect()), reverse=True):
        terms = levels.where(F.col("level") == level).select("term")
        lost = gone.join(terms, "term", "left_semi")
        mine = held.join(terms, "term", "left_semi").join(lost, ["term", "item"], "left_anti")
        a = mine.join(external, "item").groupBy("term").agg(F.count("*").alias("a"))
        size = mine.groupBy("term").agg(F.count("*").alias("size"))
        less = lost.join(external, "item", "left_semi").groupBy("term").agg(F.count("*").alias("less"))
        x = terms.join(a, "term", "left").join(size, "term", "left").join(less, "term", "left").na.fill(0)
        b, c = F.lit(n_external) - F.col("less") - F.col("a"), F.col("size") - F.col("a")
        tested = cut(x.select("term", F.lit(level).alias("level"), fisher_two_sided(F.col("a"), b, c, F.lit(total) - F.col("a") - b - c).alias("p_value")))
        results.append(tested)
        hit = tested.where(F.col("p_value") <= threshold).select("term")
        gone = cut(gone.union(held.join(hit, "term", "left_semi").join(onto.closed.select("term", "ancestor"), "term").select(F.col("ancestor").alias("term"), "item")).distinct())
    out = spark.createDataFrame([], "term string, level int, p_value double")
    for more in results:
        out = out.union(more)
    return out


def _weighted(weights: DataFrame, external: DataFrame, n_external: int, total: int) -> DataFrame:
    """term, p_value of weighted items (term, item, weight): weights are summed, then rounded up."""
    met = weights.join(external.withColumn("hit", F.lit(True)), "item", "left").groupBy("term").agg(
        F.ceil(F.round(F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)), 9)).alias("a"), F.ceil(F.round(F.sum(F.when(F.col("hit").isNull(), F.col("weight")).otherwise(0.0)), 9)).alias("c"), F.count("hit").alias("both"), F.count("*").alias("size"))
    return met.select("term", fisher_two_sided(F.col("a"), F.lit(n_external) - F.col("both"), F.col("c"), F.lit(total) - F.lit(n_external) - F.col("size") + F.col("both")).alias("p_value"))


def weight(onto: Ontology, items: DataFrame, external: DataFrame, total: int, strict: bool = False) -> DataFrame:
    """term, level, p_value: items lose weight in the terms that explain them worse than their children or parents.

    A term is compared with its children that have weights, by ln p(child) / ln
    p(term).  If no child reaches 1, the children's weights are multiplied by their
    ratios and they are tested anew; else the term's weights are divided by the
    ratios of the children that do, and it is tested anew.  Terms of a level that
    share a child are taken one after another, in order of id, others together.
    """
    levels = connected(onto, items)
    held = inherited(onto, items, levels, strict)
    external = cut(external.select("item").distinct())
    n = external.count()
    spark = items.sparkSession
    weights = spark.createDataFrame([], "term string, item string, weight double")
    p_values = spark.createDataFrame([], "term string, p_value double")
    held = held.select(F.col("term").cast("string").alias("term"), F.col("item").cast("string").alias("item"))
    external = external.select(F.col("item").cast("string").alias("item"))
    children = onto.edges.select(F.col("parent").alias("term"), "child").distinct()
    for level in sorted((r[0] for r in levels.select("level").distinct().collect()), reverse=True):
        left = levels.where(F.col("level") == level).select("term").distinct()
        left = cut(left)
        while not left.isEmpty():
            stored = weights.select(F.col("term").alias("child")).distinct()
            pairs = cut(children.join(left, "term", "left_semi").join(stored, "child", "left_semi").select("term", "child"))
            first = pairs.groupBy("child").agg(F.min("term").alias("first"))
            waits = pairs.join(first, "child").where("term <> first").select("term").distinct()
            now = cut(left.join(waits, "term", "left_anti"))
            mine = held.join(now, "term", "left_semi").withColumn("weight", F.lit(1.0))
            tested = cut(now.join(_weighted(mine, external, n, total), "term", "left").na.fill(1.0, ["p_value"]))
            rates = pairs.join(tested.select("term", F.col("p_value").alias("p")), "term").join(p_values.select(F.col("term").alias("child"), F.col("p_value").alias("q")), "child")
            # ln 1 = 0: the ratio to an insignificant term is infinite, between two such undefined and lost
            ratio = F.when(F.ln("p") != 0, F.ln("q") / F.when(F.ln("p") != 0, F.ln("p"))).otherwise(F.when(F.ln("q") != 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
            rates = cut(rates.select("term", "child", ratio.alias("ratio")))
            wins = rates.where("ratio >= 1").groupBy("term").agg(F.exp(F.sum(F.ln("ratio"))).alias("by"))
            mine = cut(mine.join(wins, "term", "left").select("term", "item", (F.col("weight") / F.coalesce("by", F.lit(1.0))).alias("weight")))
            again = _weighted(mine.join(wins.select("term"), "term", "left_semi"), external, n, total)
            losers = rates.join(wins.select("term"), "term", "left_anti").select(F.col("child").alias("term"), "ratio")
            lowered = weights.join(losers, "term").select("term", "item", (F.col("weight") * F.col("ratio")).alias("weight"))
            lowered = cut(lowered)
            relieved = _weighted(lowered, external, n, total)
            fresh = again.union(relieved)
            known = p_values.union(tested)
            p_values = cut(known.join(fresh.select("term"), "term", "left_anti").union(fresh))
            weights = cut(weights.join(losers.select("term"), "term", "left_anti").union(lowered).union(mine))
            left = cut(left.join(now, "term", "left_anti"))
    return levels.join(p_values, "term").select("term", "level", "p_value")


def enrichment(onto: Ontology, items: DataFrame, external: DataFrame, total: int, mode: str, threshold: float | None = None) -> DataFrame:
    """elim or weight by name; any other mode gives no rows."""
    if mode == "elim":
        return elim(onto, items, external, total, threshold)
    if mode == "weight":
        return weight(onto, items, external, total)
    return items.sparkSession.createDataFrame([], "term string, level int, p_value double")


__all__ = ["connected", "elim", "enrichment", "first_parents", "fisher_by_term", "graph", "inherited", "shortest_parents", "weight"]

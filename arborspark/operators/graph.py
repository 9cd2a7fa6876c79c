"""Closure, levels, paths, roots and pruning of a hierarchy of is-a edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """term, ancestor, distance: the fewest edges from each node to every node above it.

    Known paths are joined to themselves, so rounds are logarithmic in the depth.  In
    a cyclic graph a node is its own ancestor; such rows stay, callers drop them.
    """
    known = cut(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).where("term is not null and ancestor is not null").distinct().withColumn("distance", F.lit(1)))
    before = None
    for _ in range(most_rounds):
        tail = known.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("higher"), F.col("distance").alias("more"))
        longer = known.join(tail, "ancestor").select("term", F.col("higher").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        known = cut(known.union(longer).groupBy("term", "ancestor").agg(F.min("distance").alias("distance")))
        now = known.agg(F.count("*"), F.sum("distance")).first()
        if now == before:
            return known
        before = now
    raise RuntimeError("the hierarchy is deeper than 2 to the number of rounds")


def parentless(edges: DataFrame) -> DataFrame:
    """node: ends of edges that have no parent themselves, dangling ones included."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def roots(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms without an is-a edge; one whose parents all dangle is no root."""
    return terms.select("term").join(edges.select(F.col("child").alias("term")), "term", "left_anti")


def shortest_levels(terms: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """term, level: nodes on the shortest way to a parentless node, that one being level 1; -1 without a way.

    A dangling parent counts as a node of the way.
    """
    tops = parentless(edges)
    below = paths.join(tops.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").groupBy("term").agg((F.min("distance") + 1).alias("level"))
    return terms.select("term").join(below, "term", "left").join(edges.select(F.col("child").alias("term")).distinct().withColumn("has_", F.lit(True)), "term", "left").select(
        "term", F.coalesce("level", F.when(F.col("has_").isNull(), F.lit(1)).otherwise(F.lit(-1))).cast("int").alias("level"))


def longest_levels(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """term, level: nodes on the longest way to a parentless node of an acyclic hierarchy."""
    nodes = terms.select("term").union(edges.select("parent")).distinct()
    level = cut(nodes.withColumn("level", F.lit(1)))
    # no way has more nodes than there are; levels that still rise then lie above a cycle
    for _ in range(level.count() + 1):
        higher = edges.join(level.withColumnRenamed("term", "parent"), "parent").groupBy(F.col("child").alias("term")).agg((F.max("level") + 1).alias("up"))
        moved = cut(level.join(higher, "term", "left").select("term", F.greatest("level", F.coalesce("up", "level")).alias("level")))
        if moved.agg(F.sum("level")).first() == level.agg(F.sum("level")).first():
            return terms.select("term").join(moved, "term")
        level = moved
    raise RuntimeError("the hierarchy is cyclic")


def root_paths(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """term, path: every way from a term to a parentless node, the term first.

    Ways are as many as the hierarchy's diamonds make them; ask for them only when
    they are wanted.  A term in a cycle has the ways that leave it.  No way meets a
    node twice, so rounds end with the longest one.
    """
    step = edges.select(F.col("child").alias("at"), "parent")
    grown = terms.select("term", F.array("term").alias("path"), F.col("term").alias("at"))
    done = []
    while True:
        grown = cut(grown)
        if done and grown.isEmpty():
            break
        done.append(grown.join(step.select("at"), "at", "left_anti").select("term", "path"))
        grown = grown.join(step, "at").where(~F.array_contains("path", F.col("parent"))).select("term", F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("at"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def path_summary(paths: DataFrame) -> DataFrame:
    """term, total_paths, largest_path, shortest_path."""
    n = F.size("path")
    return paths.groupBy("term").agg(F.count("*").alias("total_paths"), F.max(n).alias("largest_path"), F.min(n).alias("shortest_path"))


def parental_path(paths: DataFrame, which: str = "shortest", level: int = 0) -> DataFrame:
    """term, path: the least of the term's shortest (largest) ways without the term itself, cut off below a level if one is given."""
    n = F.size("path")
    best = paths.groupBy("term").agg(F.min_by("path", F.struct(n if which == "shortest" else -n, "path")).alias("path"))
    above = F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))
    return best.select("term", (F.slice(above, 1, F.greatest(F.size("path") - level, F.lit(0))) if level else above).alias("path"))


def structure(n_terms: int, n_children: int, cyclic: bool) -> str:
    """circular if a cycle was met, atomic without edges, sparse with two or more parentless terms, which overrides circular."""
    if n_children and n_terms - n_children >= 2:
        return "sparse"
    return "atomic" if not n_children else "circular" if cyclic else "hierarchical"


def below(terms: DataFrame, closed: DataFrame, root: str, keep: bool) -> DataFrame:
    """The root and its descendants, or (keep false) the terms other than the descendants."""
    under = closed.where(F.col("ancestor") == root).select("term")
    whole = under.union(terms.where(F.col("term") == root).select("term")).distinct()
    return terms.join(whole, "term", "left_semi") if keep else terms.join(under.distinct(), "term", "left_anti")

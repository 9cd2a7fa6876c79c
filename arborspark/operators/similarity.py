"""Common ancestors, similarity of terms, best-match comparison of profiles.

A pair of terms meets through the ancestors of its first term, looked up among
those of the second: the join key is (second term, ancestor), so the root, which
all pairs share, is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..model import Ontology
from .cuts import cut
from .information import information

MEASURES = ("resnik", "lin", "jiang_conrath")


def common_ancestors(onto: Ontology, pairs: DataFrame) -> DataFrame:
    """a, b, ancestor: all common ancestors of each distinct pair (a, b), a term being its own."""
    above = onto.reflexive.select("term", "ancestor")
    left = pairs.select("a", "b").distinct().join(above.withColumnRenamed("term", "a"), "a")
    return left.join(above.withColumnRenamed("term", "b"), ["b", "ancestor"]).select("a", "b", "ancestor")


def best_common(onto: Ontology, pairs: DataFrame, ics: DataFrame) -> DataFrame:
    """a, b, mica, ic: the common ancestor of the greatest information, for equal terms the term; no row without any.

    Ties go to the nearest ancestor of a, then to the least id.  Values below -1
    and nulls never win.
    """
    above = onto.reflexive
    left = pairs.select("a", "b").distinct().join(above.select(F.col("term").alias("a"), "ancestor", "distance"), "a")
    both = left.join(above.select(F.col("term").alias("b"), "ancestor"), ["b", "ancestor"]).join(ics.select(F.col("term").alias("ancestor"), "ic"), "ancestor")
    own = F.col("a") == F.col("b")
    fit = both.where(F.when(own, F.col("ancestor") == F.col("a")).otherwise(F.col("ic") > -1.0))
    return fit.groupBy("a", "b").agg(F.min_by(F.struct("ancestor", "ic"), F.struct(-F.col("ic"), "distance", "ancestor")).alias("m")).select("a", "b", F.col("m.ancestor").alias("mica"), F.col("m.ic").alias("ic"))


def term_similarity(onto: Ontology, pairs: DataFrame, measure: str = "resnik", ics: DataFrame | None = None) -> DataFrame:
    """a, b, similarity of the distinct pairs (a, b) that have a common ancestor.

    resnik is its information, lin twice that over the sum of both terms',
    jiang_conrath the sum less twice that, which is a distance.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {MEASURES}")
    ics = ics if ics is not None else information(onto)
    common = best_common(onto, pairs, ics)
    if measure == "resnik":
        return common.select("a", "b", F.col("ic").alias("similarity"))
    both = common.join(ics.select(F.col("term").alias("a"), F.col("ic").alias("ia")), "a").join(ics.select(F.col("term").alias("b"), F.col("ic").alias("ib")), "b")
    value = ratio(2 * F.col("ic"), F.col("ia") + F.col("ib")) if measure == "lin" else F.col("ia") + F.col("ib") - 2 * F.col("ic")
    return both.select("a", "b", value.alias("similarity"))


def best_in_profile(onto: Ontology, terms: DataFrame, profiles: DataFrame, ics: DataFrame | None = None) -> DataFrame:
    """term, profile_id, mica, ic: for each of some terms its best common ancestor over a profile's terms; the first best wins."""
    pairs = _all_pairs(terms.select("term").distinct(), profiles.select("term").distinct())
    found = best_common(onto, pairs, ics if ics is not None else information(onto))
    return found.join(profiles.select("profile_id", F.col("term").alias("b"), "pos"), "b").groupBy(F.col("a").alias("term"), "profile_id").agg(
        F.min_by(F.struct("mica", "ic"), F.struct(-F.col("ic"), "pos")).alias("m")).select("term", "profile_id", "m.mica", "m.ic")


def _all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: every term of one list with every term of the other, as the comparison of all with all asks for."""
    return left.select(F.col("term").alias("a")).crossJoin(right.select(F.col("term").alias("b")))


#: Pairs of profiles that a task writes, and pairs of classes in one list.
TASK_PAIRS, LIST_PAIRS = 250_000, 4096


def _classed(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profile_id, class of every profile, and class, n, terms: profiles of the same terms, each as often, are of one class."""
    each = cut(profiles.where("profile_id is not null").groupBy("profile_id").agg(F.sort_array(F.collect_list("term")).alias("terms"), F.count("*").alias("n")))
    classes = cut(each.select("terms", "n").distinct().withColumn("class", F.monotonically_increasing_id()))
    return cut(each.join(classes, ["terms", "n"]).select("profile_id", "class")), classes


def pair_index(profiles: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """a, b with a <= b: the distinct term pairs that occur across two profiles (or a profile and another one's)."""
    pairs = _all_pairs(profiles.select("term").distinct(), (others if others is not None else profiles).select("term").distinct())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compare_profiles(onto: Ontology, profiles: DataFrame, others: DataFrame | None = None, measure: str = "resnik", ics: DataFrame | None = None, bidirectional: bool = True) -> DataFrame:
    """profile_a, profile_b, similarity of every profile with every other (all ordered pairs, itself too) or with the others.

    Best-match average: each term's greatest similarity to a term of the other
    profile, 0 if there is none, averaged; both directions weighted by their numbers
    of terms.  A distance is maximised as well.  The greatest similarity of a
    distinct term to a profile is found once, whatever the number of profiles with
    the term, and profiles of the same terms are compared once, as a class; their
    pairs are written by as many tasks as the pairs' number asks for.  Rows without a
    profile_id belong to no profile.
    """
    external = others is not None
    of_a, classes_a = _classed(profiles)
    of_b, classes_b = _classed(others) if external else (of_a, classes_a)
    one, two = (c.select("class", F.explode("terms").alias("term")) for c in (classes_a, classes_b))
    known = cut(term_similarity(onto, pair_index(one, two), measure, ics))
    both = known.union(known.where("a <> b").select("b", "a", "similarity"))

    def directed(one: DataFrame, two: DataFrame) -> DataFrame:
        best = both.join(two.select("class", F.col("term").alias("b")).distinct(), "b").groupBy("a", F.col("class").alias("to")).agg(F.max("similarity").alias("best"))
        return cut(one.select("class", F.col("term").alias("a")).join(best, "a").groupBy("class", "to").agg(F.sum("best").alias("total")))

    size = lambda c, name: c.select(F.col("class").alias(f"class_{name}"), F.col("n").alias(f"n{name}"))
    grid = size(classes_a, "a").crossJoin(size(classes_b, "b"))
    sums = directed(one, two)
    out = grid.join(sums.select(F.col("class").alias("class_a"), F.col("to").alias("class_b"), F.col("total").alias("forth")), ["class_a", "class_b"], "left").na.fill(0.0, ["forth"])
    value = F.col("forth") / F.col("na")
    if bidirectional:
        back = (directed(two, one) if external else sums).select(F.col("to").alias("class_a"), F.col("class").alias("class_b"), F.col("total").alias("back"))
        out = out.join(back, ["class_a", "class_b"], "left").na.fill(0.0, ["back"])
        value = (F.col("forth") + F.col("back")) / (F.col("na") + F.col("nb"))
    # one class may hold nearly all profiles: its members are dealt to tasks before they meet the others'
    lists = -(-classes_b.count() // LIST_PAIRS) or 1
    listed = out.groupBy("class_a", F.pmod(F.hash("class_b"), F.lit(lists)).alias("list")).agg(F.collect_list(F.struct("class_b", value.alias("similarity"))).alias("to"))
    tasks = -(-of_a.count() * of_b.count() // TASK_PAIRS) or 1
    left = of_a.select(F.col("profile_id").alias("profile_a"), F.col("class").alias("class_a")).join(listed, "class_a").repartition(tasks, "profile_a", "list")
    right = of_b.select(F.col("profile_id").alias("profile_b"), F.col("class").alias("class_b"))
    return left.select("profile_a", F.inline("to")).join(F.broadcast(right), "class_b").select("profile_a", "profile_b", "similarity")

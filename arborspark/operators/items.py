"""Items of terms (term, item): loading, inversion, propagation to ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ontology
from . import profiles as prof
from .cuts import cut
from .information import information
from .similarity import best_common


def loaded(stored: DataFrame, new: DataFrame, remove_old: bool = False, expand: bool = False) -> DataFrame:
    """Stored items with the new ones: in the place of those of the same terms, or united with them; remove_old forgets the stored ones."""
    new = new.select("term", "item")
    if remove_old:
        return new
    if expand:
        return stored.select("term", "item").union(new).distinct()
    return stored.join(new.select("term").distinct(), "term", "left_anti").select("term", "item").union(new)


def from_dictionary(onto: Ontology, tag: str) -> DataFrame:
    """term, item: a dictionary's values as items."""
    return onto.dictionary(tag).select("term", F.col("value").alias("item"))


def from_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.select("term", F.col("profile_id").alias("item"))


def to_profiles(items: DataFrame) -> DataFrame:
    """profile_id, term: each item with its terms."""
    return items.select(F.col("item").alias("profile_id"), "term")


def _exact(onto: Ontology, items: DataFrame, parents: DataFrame, least: int) -> DataFrame:
    """term, item that at least so many descendants with items of these parents share."""
    under = onto.closed.select(F.col("ancestor").alias("parent"), "term").join(parents.withColumnRenamed("term", "parent"), "parent", "left_semi")
    met = under.join(items, "term")
    return met.groupBy("parent", "item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("parent").alias("term"), "item")


def _by_meaning(onto: Ontology, items: DataFrame, parents: DataFrame, least: int, other: Ontology, ics: DataFrame) -> DataFrame:
    """term, item: common ancestors, in another ontology, of the items of pairs of a parent's descendants.

    For every pair each item's best common ancestor with an item of the other child
    counts; one that counts twice or more in a pair adds its count, and sums of at
    least `least` are kept.
    """
    holders = items.select("term").distinct()
    under = onto.closed.select(F.col("ancestor").alias("parent"), "term").join(parents.withColumnRenamed("term", "parent"), "parent", "left_semi").join(holders, "term", "left_semi")
    many = under.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("parent")
    under = under.join(many, "parent", "left_semi")
    couples = under.select("parent", F.col("term").alias("c1")).join(under.select("parent", F.col("term").alias("c2")), "parent").where("c1 <> c2")
    one, two = items.select(F.col("term").alias("c1"), F.col("item").alias("a")), items.select(F.col("term").alias("c2"), F.col("item").alias("b"))
    sides = cut(couples.join(one, "c1").join(two, "c2"))
    mica = best_common(other, sides.select("a", "b"), ics)
    best = sides.join(mica, ["a", "b"]).groupBy("parent", "c1", "c2", "a").agg(F.min_by("mica", F.struct(-F.col("ic"), "b")).alias("item"))
    pair = best.select("parent", F.least("c1", "c2").alias("x"), F.greatest("c1", "c2").alias("y"), "item")
    counted = pair.groupBy("parent", "x", "y", "item").agg(F.count("*").alias("n")).where("n >= 2")
    return counted.groupBy("parent", "item").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("parent").alias("term"), "item")


def propagated(onto: Ontology, items: DataFrame, least: int = 2, other: Ontology | None = None, clean: bool = True) -> DataFrame:
    """term, item: items that enough descendants share go up to their ancestors, level by level from the deepest but one.

    Without another ontology items are compared as they are; with one, in which
    the items are terms, by their best common ancestors, and a term that had items
    before is cleaned of ancestors afterwards if `clean`.
    """
    state = cut(items.select("term", "item").distinct())
    targets = state.select("term").distinct()
    targets = targets.union(targets.join(onto.closed, "term").select("ancestor")).distinct().join(onto.meta.select("term", "level"), "term")
    targets = cut(targets)
    levels = sorted(r["level"] for r in targets.select("level").distinct().collect() if r["level"] is not None)
    ics = information(other) if other is not None else None
    for level in reversed(levels[:-1]):
        parents = targets.where(F.col("level") == level).select("term")
        new = _exact(onto, state, parents, least) if other is None else _by_meaning(onto, state, parents, least, other, ics)
        new = cut(new)
        grown = state.union(new).distinct()
        if other is not None and clean:
            changed = new.select("term").distinct().join(state.select("term").distinct(), "term", "left_semi")
            subject = grown.join(changed, "term", "left_semi").select(F.col("term").alias("profile_id"), F.col("item").alias("term"), F.lit(0).alias("pos"))
            done = prof.cleaned(other, subject).select(F.col("profile_id").alias("term"), F.col("term").alias("item"))
            grown = grown.join(changed, "term", "left_anti").union(done)
        state = cut(grown)
    return state


def as_profiles_propagated(onto: Ontology, profiles: DataFrame, least: int = 1, unwanted: list[str] | None = None, other: Ontology | None = None, clean: bool = True) -> DataFrame:
    """profile_id, term: profiles expanded by propagating them as items."""
    out = to_profiles(propagated(onto, from_profiles(profiles), least, other, clean))
    return out.where(~F.col("term").isin(unwanted)) if unwanted else out


def concatenated(a, b):
    """Union of two array columns, or of two map columns of arrays key by key; a null side gives the other."""
    return F.coalesce(F.array_union(a, b), a, b)


def concatenated_maps(a, b):
    return F.coalesce(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(F.array_union(x, y), x, y)), a, b)

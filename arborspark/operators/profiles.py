"""Profiles (profile_id, term, pos): loading, cleaning, expanding, translating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ontology
from .lookup import names_of, resolved, terms_of_names


def checked(onto: Ontology, profiles: DataFrame, substitute: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, alternatives replaced by their terms if wanted, and rejected rows; repeats stay."""
    told = resolved(onto, profiles.withColumnRenamed("term", "id"))
    kept = told.where("main is not null").select("profile_id", F.col("main" if substitute else "id").alias("term"), "pos")
    return kept, told.where("main is null").select("profile_id", F.col("id").alias("term"), "pos")


def loaded(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored profiles with the new ones put in the place of those of the same id."""
    return stored.join(new.select("profile_id").distinct(), "profile_id", "left_anti").select("profile_id", "term", "pos").unionByName(new.select("profile_id", "term", "pos"))


def from_arrays(rows: DataFrame) -> DataFrame:
    """Long rows of profiles given as (profile_id, terms array)."""
    return rows.select("profile_id", F.posexplode("terms").alias("pos", "term")).select("profile_id", "term", "pos")


def as_arrays(profiles: DataFrame, column: str = "term") -> DataFrame:
    """profile_id, terms in order of pos."""
    return profiles.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("pos", column))).alias("x")).select("profile_id", F.col(f"x.{column}").alias("terms"))


def expanded(onto: Ontology, profiles: DataFrame, unwanted: list[str] | None = None) -> DataFrame:
    """profile_id, term: the terms with all their ancestors, each once, without unwanted ones."""
    above = profiles.select("profile_id", "term").distinct().join(onto.closed.select("term", "ancestor"), "term").select("profile_id", F.col("ancestor").alias("term"))
    out = profiles.select("profile_id", "term").union(above).distinct()
    return out.where(~F.col("term").isin(unwanted)) if unwanted else out


def without_ancestors(onto: Ontology, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows kept and removed: a term goes if it is an ancestor of another one of its profile."""
    above = profiles.select("profile_id", "term").distinct().join(onto.closed.select("term", "ancestor"), "term").select("profile_id", F.col("ancestor").alias("term")).distinct()
    return profiles.join(above, ["profile_id", "term"], "left_anti").select(*profiles.columns), profiles.join(above, ["profile_id", "term"], "left_semi").select(*profiles.columns)


def without_alternatives(onto: Ontology, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows kept and removed: an alternative id goes if its term is in the profile."""
    spare = profiles.select("profile_id", F.col("term").alias("main")).distinct().join(onto.alternatives, "main").select("profile_id", F.col("alt").alias("term")).distinct()
    return profiles.join(spare, ["profile_id", "term"], "left_anti").select(*profiles.columns), profiles.join(spare, ["profile_id", "term"], "left_semi").select(*profiles.columns)


def cleaned(onto: Ontology, profiles: DataFrame, remove_alternatives: bool = True) -> DataFrame:
    """Without ancestors of other members, then without alternatives of members."""
    kept, _ = without_ancestors(onto, profiles)
    return without_alternatives(onto, kept)[0] if remove_alternatives else kept


def hard_cleaned(onto: Ontology, profiles: DataFrame, term_filter: str | None = None, remove_alternatives: bool = True) -> DataFrame:
    """Ids resolved, unknown and obsolete ones gone, only strict descendants of a filter term if given, each once, then cleaned.

    A profile that loses all its terms has no rows left; see :func:`emptied`.
    """
    known, _ = checked(onto, profiles, substitute=True)
    if term_filter is not None:
        known = known.join(onto.closed.where(F.col("ancestor") == term_filter).select("term"), "term", "left_semi")
    once = known.groupBy("profile_id", "term").agg(F.min("pos").alias("pos"))
    live = once.join(onto.obsoletes, "term", "left_anti").select("profile_id", "term", "pos")
    return cleaned(onto, live, remove_alternatives)


def emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """profile_id of the profiles that have rows before but none after."""
    return before.select("profile_id").distinct().join(after.select("profile_id").distinct(), "profile_id", "left_anti")


def cleaned_by_score(onto: Ontology, profiles: DataFrame, scores: DataFrame, greatest: bool = True, remove_unscored: bool = True) -> DataFrame:
    """profile_id, term: each scored term gives way to the best-scored among itself and its relatives of the profile.

    scores are (term, score); ties go to the least id.  Unscored terms go or stay.
    """
    rows = profiles.select("profile_id", "term").distinct()
    scored = rows.join(scores, "term").select("profile_id", "term", "score")
    others = scored.select("profile_id", F.col("term").alias("other"), F.col("score").alias("s"))
    # upwards only, as a term has few ancestors; each pair found counts for both
    up = scored.join(onto.closed.select("term", F.col("ancestor").alias("other")), "term").join(others, ["profile_id", "other"])
    pair = lambda term, other, s: F.struct(F.col(term).alias("term"), F.col(other).alias("other"), F.col(s).alias("s"))
    related = up.select("profile_id", F.explode(F.array(pair("term", "other", "s"), pair("other", "term", "score"))).alias("x")).select("profile_id", "x.*")
    related = related.union(scored.select("profile_id", "term", F.col("term").alias("other"), F.col("score").alias("s")))
    best = related.groupBy("profile_id", "term").agg(F.min_by("other", F.struct(-F.col("s") if greatest else F.col("s"), "other")).alias("kept"))
    out = best.select("profile_id", F.col("kept").alias("term"))
    if not remove_unscored:
        out = out.union(rows.join(scores.select("term"), "term", "left_anti").select("profile_id", "term"))
    return out.distinct()


def translated(onto: Ontology, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profile_id, name, pos of known ids, and the rejected rows."""
    told = names_of(onto, profiles.withColumnRenamed("term", "id"))
    return told.where("name is not null").select("profile_id", "name", "pos"), told.where("name is null").select("profile_id", F.col("id").alias("term"), "pos")


def from_names(onto: Ontology, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profile_id, term, pos of known names (profile_id, name, pos), and the rejected rows."""
    told = terms_of_names(onto, named)
    return told.where("term is not null").select("profile_id", "term", "pos"), told.where("term is null").select("profile_id", "name", "pos")


def childs_table(onto: Ontology, profiles: DataFrame) -> DataFrame:
    """profile_id, term, name, children (array of struct<term, name>): each term with its descendants."""
    names = onto.terms.select("term", "name")
    under = onto.closed.select(F.col("ancestor").alias("term"), F.col("term").alias("child")).join(names.select(F.col("term").alias("child"), F.col("name").alias("child_name")), "child")
    lists = under.groupBy("term").agg(F.sort_array(F.collect_list(F.struct(F.col("child").alias("term"), F.col("child_name").alias("name")))).alias("children"))
    return profiles.select("profile_id", "term").distinct().join(names, "term", "left").join(lists, "term", "left").select("profile_id", "term", "name", "children")


def with_levels(onto: Ontology, profiles: DataFrame) -> DataFrame:
    """profiles with level, null for ids that are no terms."""
    return profiles.join(onto.meta.select("term", "level"), "term", "left").select(*profiles.columns, "level")

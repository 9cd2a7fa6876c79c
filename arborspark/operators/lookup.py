"""Term-level lookups: relatives, levels, ids, names, dictionaries, relation listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Ontology


def direct_relatives(onto: Ontology, above: bool) -> DataFrame:
    """term, relative: parents (above) or children."""
    return onto.edges.select(F.col("child").alias("term"), F.col("parent").alias("relative")) if above else onto.edges.select(F.col("parent").alias("term"), F.col("child").alias("relative"))


def relatives(onto: Ontology, above: bool) -> DataFrame:
    """term, relative: all ancestors or descendants."""
    return onto.closed.select("term", F.col("ancestor").alias("relative")) if above else onto.closed.select(F.col("ancestor").alias("term"), F.col("term").alias("relative"))


def resolved(onto: Ontology, ids: DataFrame) -> DataFrame:
    """ids (id and any other columns) with main: the term that each stands for, or null."""
    return ids.join(onto.resolver, "id", "left").select(*ids.columns, "main")


def first_value(onto: Ontology, tag: str) -> DataFrame:
    """term, value: a term's first value of a tag."""
    return onto.dictionary(tag).groupBy("term").agg(F.min_by("value", F.struct("pos", "value")).alias("value"))


def last_term(onto: Ontology, tag: str, pattern: str | None = None) -> DataFrame:
    """value, term: the term that a value stands for, the last one in order if it has several.

    With a pattern, its first group in a value is the value.
    """
    entries = onto.dictionary(tag)
    if pattern:
        entries = entries.withColumn("value", F.regexp_extract("value", pattern, 1)).where("value <> ''")
    return entries.join(onto.terms.select("term", "ord"), "term").groupBy("value").agg(F.max_by("term", F.struct("ord", "pos", "term")).alias("term"))


def names_of(onto: Ontology, ids: DataFrame) -> DataFrame:
    """ids (id, ...) with name: that of the term that the id stands for; null marks a rejected id."""
    names = first_value(onto, "name").select(F.col("term").alias("main"), F.col("value").alias("name"))
    return resolved(onto, ids).join(names, "main", "left").select(*ids.columns, "name")


#: The quoted text of a synonym line.
QUOTED = '"(.*)"'


def terms_of_names(onto: Ontology, names: DataFrame) -> DataFrame:
    """names (name, ...) with term: by name, else by synonym; null marks a rejected name."""
    by_name = last_term(onto, "name").select(F.col("value").alias("name"), F.col("term").alias("t1_"))
    by_synonym = last_term(onto, "synonym", QUOTED).select(F.col("value").alias("name"), F.col("term").alias("t2_"))
    return names.join(by_name, "name", "left").join(by_synonym, "name", "left").select(*names.columns, F.coalesce("t1_", "t2_").alias("term"))


def flagged(onto: Ontology, ids: DataFrame) -> DataFrame:
    """ids (id, ...) with is_term, is_alternative and is_obsolete."""
    marks = ((onto.terms.select(F.col("term").alias("id")), "is_term"), (onto.alternatives.select(F.col("alt").alias("id")), "is_alternative"), (onto.obsoletes.select(F.col("term").alias("id")), "is_obsolete"))
    for rows, mark in marks:
        ids = ids.join(rows.distinct().withColumn(mark, F.lit(True)), "id", "left").na.fill(False, [mark])
    return ids


def term_attributes(onto: Ontology) -> DataFrame:
    """term, name, level."""
    return onto.terms.select("term", "name").join(onto.meta.select("term", "level"), "term", "left")


def terms_by_level(onto: Ontology, terms: DataFrame | None = None) -> DataFrame:
    """level, terms: of the whole ontology, or of some rows (term), repeats kept; unknown terms have level null."""
    levels = onto.meta.select("term", "level")
    rows = levels if terms is None else terms.select("term").join(levels, "term", "left")
    return rows.groupBy("level").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def relation_listing(onto: Ontology, terms: DataFrame, modifiers: str = "") -> DataFrame:
    """What is below (modifier a: above) some terms (term).

    Without r, one column term of the relatives.  With r, parent and child of the
    relations among them and the given terms, with hN only those whose near end
    lies within the first N + 1 levels met, from the top (with a, from the bottom).
    n puts names in the place of ids.
    """
    above = "a" in modifiers
    given = terms.select("term").distinct()
    found = relatives(onto, above).join(given, "term", "left_semi").select(F.col("relative").alias("term")).distinct()

    def named(rows: DataFrame, column: str) -> DataFrame:
        if "n" not in modifiers:
            return rows
        return names_of(onto, rows.withColumnRenamed(column, "id")).drop("id").withColumnRenamed("name", column)

    if "r" not in modifiers:
        return named(found, "term")
    nodes = found.union(given).distinct()
    if hops := re.search(r"h([0-9]+)", modifiers):
        level = onto.meta.select("term", "level")
        # ranks of the distinct levels: as few rows as the hierarchy has levels
        step = F.dense_rank().over(Window.orderBy(F.desc("level") if above else F.asc("level")))
        ranks = nodes.join(level, "term").select("level").distinct().withColumn("step", step)
        nodes = nodes.join(level, "term").join(F.broadcast(ranks.where(F.col("step") <= int(hops.group(1)) + 1)), "level", "left_semi").select("term")
    pairs = onto.edges.select("parent", "child").join(nodes.withColumnRenamed("term", "child" if above else "parent"), "child" if above else "parent", "left_semi")
    return named(named(pairs.select("parent", "child"), "parent"), "child").select("parent", "child")

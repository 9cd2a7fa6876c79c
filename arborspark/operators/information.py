"""Information content of terms, and its means over profiles.

Kinds, with log to base 10, sf the structural frequency (descendants + 1):

* resnik: -log(sf / greatest sf)
* resnik_observed: -log(observed / greatest observed); null for a term never observed
* seco: 1 - log(sf) / log(number of terms)
* zhou: k * seco + (1 - k) * log(descendants) / log(depth); minus infinity for a leaf
* sanchez: -log((descendants / ancestors + 1) / (depth + 1)); minus infinity for a
  root with descendants, null for an isolated term

depth is the ontology's deepest level, or its most descendants where it has no
levels.  Isolated ontologies (no edges) have resnik 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log10, plain_zero, ratio
from ..model import Ontology

KINDS = ("resnik", "resnik_observed", "seco", "zhou", "sanchez")


def observed(onto: Ontology, profiles: DataFrame, increase: float = 1.0) -> DataFrame:
    """term, observed_freq: occurrences in profiles (profile_id, term, pos) of the term or of one below it; 0 if none."""
    times = profiles.groupBy("term").agg((F.count("*") * F.lit(increase)).alias("n"))  # before the join: each term once
    met = times.join(onto.reflexive, "term").groupBy(F.col("ancestor").alias("term")).agg(F.sum("n").alias("observed_freq"))
    return onto.terms.select("term").join(met, "term", "left").na.fill(0.0, ["observed_freq"])


def _seco(stats: dict) -> Column:
    return 1 - ratio(log10(F.col("struct_freq")), log10(F.lit(float(stats["n_terms"]))))


def information(onto: Ontology, kind: str = "resnik", observations: DataFrame | None = None, zhou_k: float = 0.5) -> DataFrame:
    """term, ic of every term; observations (term, observed_freq) are needed for resnik_observed."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    stats = onto.stats
    if kind == "resnik_observed":
        if observations is None:
            raise ValueError("resnik_observed needs observations")
        top = observations.agg(F.max("observed_freq")).first()[0]
        value = F.when(F.col("observed_freq") > 0, -log10(F.col("observed_freq") / F.lit(float(top or 1))))
        return observations.select("term", plain_zero(value).alias("ic"))
    depth = F.lit(stats["max_depth"])
    value = {
        "resnik": lambda: -log10(F.col("struct_freq") / F.lit(stats["max_struct_freq"])),
        "seco": lambda: _seco(stats),
        "zhou": lambda: zhou_k * _seco(stats) + (1 - zhou_k) * ratio(log10(F.col("descendants")), log10(depth)),
        "sanchez": lambda: -log10((ratio(F.col("descendants"), F.col("ancestors")) + 1) / (depth + 1)),
    }[kind]()
    return onto.meta.select("term", plain_zero(value).alias("ic"))


def profile_means(profiles: DataFrame, ics: DataFrame) -> DataFrame:
    """profile_id, mean_ic over a profile's terms, repeats counted."""
    return profiles.join(ics, "term").groupBy("profile_id").agg(F.avg("ic").alias("mean_ic"))


def dual_means(profiles: DataFrame, structural: DataFrame, observed_ics: DataFrame) -> DataFrame:
    """profile_id, mean_structural, mean_observed in one pass."""
    both = structural.withColumnRenamed("ic", "s_").join(observed_ics.withColumnRenamed("ic", "o_"), "term")
    return profiles.join(both, "term").groupBy("profile_id").agg(F.avg("s_").alias("mean_structural"), F.avg("o_").alias("mean_observed"))


def dual_of_observed(profiles: DataFrame, structural: DataFrame, observed_ics: DataFrame) -> DataFrame:
    """term, structural, observed of the terms that profiles hold."""
    return profiles.select("term").distinct().join(structural.withColumnRenamed("ic", "structural"), "term").join(observed_ics.withColumnRenamed("ic", "observed"), "term")

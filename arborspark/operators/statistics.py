"""Sizes, frequencies, level distributions and specificity of a set of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..model import Ontology
from .lookup import names_of


def sizes(profiles: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """profile_id, size; ids (profile_id), if given, add profiles without rows."""
    counted = profiles.groupBy("profile_id").agg(F.count("*").alias("size"))
    return counted if ids is None else ids.select("profile_id").distinct().join(counted, "profile_id", "left").na.fill(0, ["size"])


def mean_size(profiles: DataFrame, digits: int = 4) -> DataFrame:
    return sizes(profiles).agg(F.round(F.avg("size"), digits).alias("mean_size"))



def _quantiles(counted: DataFrame, **places: float) -> DataFrame:
    """One row with the size at each place, at (n - 1) p or the mean of the two around it; null without sizes.

    Sizes are counted first, so one row holds each different size once.
    """
    each = counted.groupBy("size").agg(F.count("*").alias("n"))
    upto = F.aggregate(F.sort_array(F.collect_list(F.struct("size", "n"))), F.array().cast("array<struct<size:bigint,upto:bigint>>"), lambda done, x: F.concat(done, F.array(F.struct(
        x["size"].cast("long").alias("size"), (F.coalesce(F.get(done, F.size(done) - 1)["upto"], F.lit(0)) + x["n"]).alias("upto")))))
    whole = each.agg(upto.alias("upto_"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_"))

    def value(p: float) -> Column:
        at = F.round((F.col("n_") - 1) * F.lit(p), 9)
        low, high = (F.get(F.filter("upto_", lambda x: x["upto"] > f(at)), 0)["size"].cast("double") for f in (F.floor, F.ceil))  # noqa: B023
        return F.when(F.col("n_") > 0, (low + high) / 2)

    return whole.select(*(value(p).alias(name) for name, p in places.items()))


def size_at_percentile(profiles: DataFrame, percent: float, increasing: bool = False) -> DataFrame:
    """The size at a percentile of the profiles in falling (increasing: rising) order."""
    p = percent / 100 if increasing else 1 - percent / 100
    return _quantiles(sizes(profiles), size=p)


def profile_stats(profiles: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """average, variance and deviation (of the population), max, min, count, count_non_zero, q1, median, q3 of the sizes."""
    counted = sizes(profiles, ids)
    whole = counted.agg(
        F.avg("size").alias("average"), F.var_pop("size").alias("variance"), F.stddev_pop("size").alias("standard_deviation"), F.max("size").alias("max"), F.min("size").alias("min"),
        F.count("*").alias("count"), F.count_if(F.col("size") != 0).alias("count_non_zero"),
    )
    # both sides are one row
    return whole.crossJoin(F.broadcast(_quantiles(counted, q1=0.25, median=0.5, q3=0.75)))


#: Labels of the report's rows and the figures behind them.
REPORT = (("Elements", "count"), ("Elements Non Zero", "count_non_zero"), ("Non Zero Density", "count_non_zero / count"), ("Max", "max"), ("Min", "min"), ("Average", "average"), ("Variance", "variance"), ("Standard Deviation", "standard_deviation"), ("Q1", "q1"), ("Median", "median"), ("Q3", "q3"))


def stats_report(stats: DataFrame) -> DataFrame:
    """label, value: one row per figure of profile_stats."""
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.expr(f"cast({what} as double)").alias("value")) for label, what in REPORT))
    return stats.select(F.explode(rows).alias("x")).select("x.label", "x.value")


def term_frequency(onto: Ontology, profiles: DataFrame, share: bool = True, translate: bool = True) -> DataFrame:
    """term, (name,) frequency: how often profiles hold a term, over their number if share."""
    counted = profiles.groupBy("term").agg(F.count("*").alias("n"))
    value = F.col("n")
    if share:
        counted = counted.join(F.broadcast(profiles.select("profile_id").distinct().agg(F.count("*").alias("all_"))))  # one row
        value = F.col("n") / F.col("all_")
    if translate:
        return names_of(onto, counted.withColumnRenamed("term", "id")).select(F.col("id").alias("term"), "name", value.alias("frequency"))
    return counted.select("term", value.alias("frequency"))


def levels_of_profiles(onto: Ontology, profiles: DataFrame, distinct: bool = True) -> DataFrame:
    """level, terms of the profiles' terms, each once or as often as it occurs."""
    rows = profiles.select("term").distinct() if distinct else profiles.select("term")
    return rows.join(onto.meta.select("term", "level"), "term").groupBy("level").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def level_distribution(onto: Ontology, profiles: DataFrame) -> DataFrame:
    """level, n_ontology, n_cohort, n_distinct and their percentages to three digits, for every level of the ontology."""
    level = onto.meta.select("term", "level")
    times = profiles.groupBy("term").agg(F.count("*").alias("times"))
    rows = level.join(times, "term", "left").groupBy("level").agg(F.count("*").alias("n_ontology"), F.coalesce(F.sum("times"), F.lit(0)).alias("n_cohort"), F.count("times").alias("n_distinct"))
    totals = rows.agg(*(F.sum(c).alias(f"all_{c}") for c in ("n_ontology", "n_cohort", "n_distinct")))
    percent = lambda c: F.round(ratio(F.col(c), F.col(f"all_{c}")) * 100, 3)
    return rows.join(F.broadcast(totals)).select("level", "n_ontology", "n_cohort", "n_distinct", percent("n_ontology").alias("pct_ontology"), percent("n_cohort").alias("pct_cohort"), percent("n_distinct").alias("pct_distinct"))


def weighted_contribution(section: DataFrame, peak, n_levels) -> DataFrame:
    """contribution: the differences of section (level, diff) weighted by their distance from the peak level, over n_levels."""
    away = F.lit(peak) - F.col("level")
    weight = F.when(away >= 0, away + 1).otherwise(F.abs(away))
    return section.agg((F.sum(F.col("diff") * weight) / F.lit(float(n_levels))).alias("contribution"))


def specificity_index(onto: Ontology, profiles: DataFrame, mode: str) -> DataFrame:
    """dsi: weighted surplus of the profiles' terms above the ontology's fullest level, over that below.

    mode "uniq" counts distinct terms, "weighted" all occurrences.  0 without a
    surplus above, null if there is none below.
    """
    if mode not in ("uniq", "weighted"):
        raise ValueError("mode is uniq or weighted")
    table = level_distribution(onto, profiles)
    shape = table.agg(F.max_by("level", F.struct("pct_ontology", "level")).alias("peak"), F.count("*").alias("n_levels"))
    diff = F.col("pct_distinct" if mode == "uniq" else "pct_cohort") - F.col("pct_ontology")
    away = F.col("peak") - F.col("level")
    weighted = F.col("diff") * F.when(away >= 0, away + 1).otherwise(F.abs(away))
    part = lambda above: F.sum(F.when((F.col("level") > F.col("peak")) == above, weighted))
    sums = table.join(F.broadcast(shape)).withColumn("diff", diff).where("diff > 0").groupBy("peak", "n_levels").agg(part(F.lit(True)).alias("high"), part(F.lit(False)).alias("low"))
    value = F.when(F.col("high").isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("high") / (F.col("n_levels") - F.col("peak")), F.col("low") / F.col("peak")))
    return shape.select(F.lit(1).alias("k_")).join(sums.select(F.lit(1).alias("k_"), value.alias("dsi"), F.lit(True).alias("some_")), "k_", "left").select(F.when(F.col("some_").isNull(), F.lit(0.0)).otherwise(F.col("dsi")).alias("dsi"))

"""One run over an ontology and profiles, with every step of the command line's options, in its order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ontology
from ..operators import information, items, lookup, profiles, similarity, statistics


@dataclass
class Options:
    """What is wanted; see the fields' comments."""

    root: str | None = None  # keep this term and what is below
    list_translate: str | None = None  # "names" or "codes": translate single terms and stop
    translate_codes: bool = False  # profiles hold names
    clean: bool = False
    term_filter: str | None = None  # keep strict descendants only
    expand: str | None = None  # "parental" or "propagate"
    unwanted: list[str] = field(default_factory=list)
    measure: str | None = None  # similarity of profiles
    references: DataFrame | None = None  # other profiles to compare with
    information: str | None = None  # "prof" or "ont"
    translate_names: bool = False
    children: tuple[str, list[str]] | None = None  # modifiers and terms
    statistics: bool = False
    attributes: bool = False
    keyword: str | None = None  # pattern of cross references
    keyword_terms: DataFrame | None = None  # term (by_value false) or value
    by_value: bool = False


def annotate(onto: Ontology, loaded: DataFrame | None, options: Options) -> dict[str, DataFrame]:
    """The tables that the options ask for: profiles, rejected, untranslated, emptied, similarity, information, names, children, stats, attributes, xrefs."""
    out: dict[str, DataFrame] = {}
    if options.root is not None:
        onto = onto.rerooted_at(options.root)
    if options.list_translate and loaded is not None:
        if options.list_translate == "names":
            told = lookup.names_of(onto, loaded.select(F.col("term").alias("id")))
            return {"translated": told.select("id", F.coalesce("name", F.lit("-")).alias("translation"))}
        told = lookup.terms_of_names(onto, loaded.select(F.col("term").alias("name")))
        return {"translated": told.select(F.col("name").alias("id"), F.coalesce("term", F.lit("-")).alias("translation"))}
    rows = loaded
    if rows is not None:
        if options.translate_codes:
            rows, out["untranslated"] = profiles.from_names(onto, rows.withColumnRenamed("term", "name"))
        rows, out["rejected"] = profiles.checked(onto, rows)
        if options.clean:
            before = rows
            rows = profiles.hard_cleaned(onto, rows, options.term_filter)
            out["emptied"] = profiles.emptied(before, rows)
        if options.expand == "parental":
            rows = profiles.expanded(onto, rows, options.unwanted).withColumn("pos", F.lit(0))
        elif options.expand == "propagate":
            rows = items.as_profiles_propagated(onto, rows, unwanted=options.unwanted).withColumn("pos", F.lit(0))
        out["profiles"] = rows
        if options.measure:
            references = options.references
            if references is not None:
                references, _ = profiles.checked(onto, references)
                if options.clean:
                    references = profiles.hard_cleaned(onto, references, options.term_filter)
            out["similarity"] = similarity.compare_profiles(onto, rows, references, options.measure)
        if options.information == "prof":
            seen = information.observed(onto, rows)
            out["information"] = information.dual_means(rows, information.information(onto), information.information(onto, "resnik_observed", seen))
        if options.translate_names:
            out["names"], _ = profiles.translated(onto, rows)
        if options.statistics:
            out["stats"] = statistics.stats_report(statistics.profile_stats(rows))
    if options.information == "ont":
        out["information"] = information.information(onto)
    if options.children:
        modifiers, terms = options.children
        out["children"] = lookup.relation_listing(onto, onto.terms.sparkSession.createDataFrame([(t,) for t in terms], "term string"), modifiers)
    if options.attributes:
        out["attributes"] = lookup.term_attributes(onto)
    if options.keyword is not None:
        # cross references that match, by term or the other way round
        found = onto.dictionary("xref").withColumn("value", F.regexp_extract("value", options.keyword, 0)).where("value <> ''").select("term", "value").distinct()
        wanted = options.keyword_terms
        out["xrefs"] = found if wanted is None else found.join(wanted, "value" if options.by_value else "term", "left_semi").select("term", "value")
    return out

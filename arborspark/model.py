"""An ontology as a handful of long tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import graph
from .operators.cuts import cut


@dataclass
class Ontology:
    """terms (term, name, ord), edges (child, parent, pos) and what was read beside them.

    edges may name parents that are no terms; those stand in paths and levels but
    in nothing else.  entries is (tag, term, value, pos), the dictionary of all
    further tags; alternatives (alt, main), obsoletes (term), header (tag, value).
    """

    terms: DataFrame
    edges: DataFrame
    entries: DataFrame | None = None
    alternatives: DataFrame | None = None
    obsoletes: DataFrame | None = None
    header: DataFrame | None = None
    rerooted: bool = False
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        spark = self.terms.sparkSession
        empty = lambda schema: spark.createDataFrame([], schema)
        self.entries = self.entries if self.entries is not None else empty("tag string, term string, value string, pos int")
        self.alternatives = self.alternatives if self.alternatives is not None else empty("alt string, main string")
        self.obsoletes = self.obsoletes if self.obsoletes is not None else empty("term string")
        self.header = self.header if self.header is not None else empty("tag string, value string")

    @cached_property
    def _paths(self) -> DataFrame:
        return graph.closure(self.edges)

    @cached_property
    def cyclic(self) -> bool:
        return not self._paths.where("term = ancestor").isEmpty()

    @cached_property
    def closed(self) -> DataFrame:
        """term, ancestor, distance between terms, without a term itself."""
        known = self.terms.select("term")
        return cut(self._paths.where("term <> ancestor").join(known, "term", "left_semi").join(known.withColumnRenamed("term", "ancestor"), "ancestor", "left_semi").select("term", "ancestor", "distance"))

    @property
    def reflexive(self) -> DataFrame:
        """closed with every term as its own ancestor at distance 0."""
        return self.closed.union(self.terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("distance")))

    @cached_property
    def structure(self) -> str:
        n, children = self.terms.count(), self.edges.select("child").distinct().count()
        kind = graph.structure(n, children, self.cyclic)
        return "sparse" if self.rerooted and kind != "atomic" else kind

    @cached_property
    def meta(self) -> DataFrame:
        """term, ancestors, descendants, struct_freq, level (null in a circular ontology)."""
        up = self.closed.groupBy("term").agg(F.count("*").alias("ancestors"))
        down = self.closed.groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("descendants"))
        made = self.terms.select("term").join(up, "term", "left").join(down, "term", "left").na.fill(0, ["ancestors", "descendants"])
        if self.structure == "circular":
            made = made.withColumn("level", F.lit(None).cast("int"))
        else:
            made = made.join(graph.shortest_levels(self.terms, self.edges, self._paths), "term")
        return cut(made.select("term", F.col("ancestors").cast("double").alias("ancestors"), F.col("descendants").cast("double").alias("descendants"), (F.col("descendants") + 1.0).alias("struct_freq"), "level"))

    @cached_property
    def stats(self) -> dict:
        """n_terms, max_struct_freq and max_depth: the deepest level, or the most descendants where there are no levels."""
        row = self.meta.agg(F.count("*").alias("n"), F.max("struct_freq").alias("sf"), F.max("level").alias("level"), F.max("descendants").alias("desc")).first()
        depth = row["level"] if row["level"] is not None and self.structure != "atomic" else row["desc"]
        return {"n_terms": row["n"], "max_struct_freq": row["sf"], "max_depth": float(depth) if depth is not None else None}

    @cached_property
    def resolver(self) -> DataFrame:
        """id, main: every id that stands for a term, alternatives followed to their end, before terms of the same id."""
        alt = self.alternatives.select(F.col("alt").alias("id"), "main")
        known = self.terms.select("term")
        # a chain has no more links than there are alternatives; what moves after these doublings lies in a circle
        for _ in range(alt.count().bit_length() + 1):
            onward = alt.select(F.col("id").alias("main"), F.col("main").alias("next"))
            moved = cut(alt.join(onward, "main", "left").select("id", F.coalesce("next", "main").alias("main")))
            settled = moved.exceptAll(alt).isEmpty()
            alt = moved
            if settled:
                break
        own = known.join(alt.select(F.col("id").alias("term")), "term", "left_anti").select(F.col("term").alias("id"), F.col("term").alias("main"))
        return alt.join(known.withColumnRenamed("term", "main"), "main", "left_semi").select("id", "main").union(own)

    def dictionary(self, tag: str) -> DataFrame:
        """term, value, pos of one tag; "name" and "is_a" are tags too."""
        if tag == "name":
            return self.terms.where("name is not null").select("term", F.col("name").alias("value"), F.lit(0).alias("pos"))
        if tag == "is_a":
            return self.edges.select(F.col("child").alias("term"), F.col("parent").alias("value"), "pos")
        return self.entries.where(F.col("tag") == tag).select("term", "value", "pos")

    def rerooted_at(self, root: str, keep_below: bool = True) -> Ontology:
        """A copy of the root with its descendants, or of what is left without these; edges to terms that went are cut."""
        terms = cut(graph.below(self.terms, self.closed, root, keep_below))
        names = terms.select("term")
        edges = self.edges.join(names.withColumnRenamed("term", "child"), "child", "left_semi").join(names.withColumnRenamed("term", "parent"), "parent", "left_semi").select("child", "parent", "pos")
        return Ontology(terms, cut(edges), self.entries.join(names, "term", "left_semi").select("tag", "term", "value", "pos"), self.alternatives.join(names.withColumnRenamed("term", "main"), "main", "left_semi").select("alt", "main"), self.obsoletes, self.header, True)

    def same_as(self, other: Ontology) -> bool:
        """Whether terms, edges, alternatives and entries hold the same rows."""
        pairs = ((self.terms.select("term", "name"), other.terms.select("term", "name")), (self.edges.select("child", "parent"), other.edges.select("child", "parent")), (self.alternatives, other.alternatives.select("alt", "main")), (self.entries.select("tag", "term", "value"), other.entries.select("tag", "term", "value")))
        return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)


def with_stats(df: DataFrame, stats: dict) -> dict[str, Column]:
    """The ontology's scalars as literals."""
    return {k: F.lit(v) for k, v in stats.items()}

"""OBO text as tables.

A file is read as one row, its lines are numbered within it, and a running count
of stanza heads gives each line its stanza; files are parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Ontology
from ..operators.cuts import cut

# Tags of the format with several values, with comments after an exclamation mark, and in order of preference for replacements.
MULTIVALUED = ("alt_id", "is_a", "subset", "synonym", "xref", "intersection_of", "union_of", "disjoint_from", "relationship", "replaced_by", "consider", "subsetdef", "synonymtypedef", "property_value", "remark")
COMMENTED = ("is_a", "union_of", "disjoint_from", "relationship", "subsetdef", "synonymtypedef", "property_value")
REPLACEMENTS = ("replaced_by", "consider", "alt_id")
STANZAS = ("Term", "Typedef", "Instance")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """file, stanza (0: header), kind, pos, tag, value of every line; a line without a colon is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^\[(\w+)\]", 1)
    marked = lines.where("line <> ''").withColumn("head", head)
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("stanza", F.count_if(F.col("head") != "").over(order)).withColumn("kind", F.coalesce(F.last(F.when(F.col("head") != "", F.col("head")), True).over(order), F.lit("header"))).where("head = ''")
    colon = F.instr("line", ":")
    tag = F.substring("line", F.lit(1), colon - 1)
    value = F.ltrim(F.substring("line", colon + 1, F.length("line")))
    value = F.when(tag == "is_a", F.regexp_replace(value, r"\{[^}]*\} ?", "")).otherwise(value)
    value = F.when(tag.isin(*COMMENTED), F.split(value, " ! ").getItem(0)).otherwise(value)
    checked = F.when(colon > 0, tag).otherwise(F.raise_error(F.concat(F.lit("line without a colon: "), F.col("line"))))
    return placed.select("file", "stanza", "kind", "pos", checked.alias("tag"), value.alias("value"))


def stanzas(tags: DataFrame, kind: str) -> DataFrame:
    """id, ord, pos, tag, value of the stanzas of a kind; of stanzas with one id the last counts, a repeated single-valued tag is an error."""
    own = tags.where(F.col("kind") == kind)
    ids = own.where("tag = 'id'").groupBy("file", "stanza").agg(F.first("value").alias("id"))
    last = ids.groupBy("id").agg(F.max_by(F.struct("file", "stanza"), F.struct("file", "stanza")).alias("s"), F.min(F.struct("file", "stanza")).alias("first"))
    # order by first appearance, as a table that is overwritten keeps it
    rows = own.join(last.select("id", "first", F.col("s.file").alias("file"), F.col("s.stanza").alias("stanza")), ["file", "stanza"])
    single = F.count("*").over(Window.partitionBy("id", "tag"))
    wrong = ~F.col("tag").isin(*MULTIVALUED) & (single > 1)
    return rows.withColumn("tag", F.when(wrong, F.raise_error(F.concat(F.lit("repeated tag: "), F.col("tag")))).otherwise(F.col("tag"))).select("id", F.concat_ws("#", F.col("first.file"), F.lpad(F.col("first.stanza").cast("string"), 12, "0")).alias("ord"), "pos", "tag", "value")


def header(tags: DataFrame) -> DataFrame:
    """tag, value of the lines before the first stanza."""
    return tags.where("stanza = 0").select("tag", "value")


def from_tags(tags: DataFrame, removed: list[str] | None = None, dictionaries: dict[str, str | None] | None = None) -> Ontology:
    """The ontology of parsed lines, without removed ids.

    dictionaries names further tags to keep as entries, each with a pattern whose
    first group is the value, or None; all other tags are entries as they are.
    """
    removed = removed or []
    every = cut(stanzas(tags, "Term").where(~F.col("id").isin(removed) if removed else F.lit(True)))
    marks = every.where("tag = 'is_obsolete' and value = 'true'").select("id").distinct()
    preferred = F.create_map(*(x for i, t in enumerate(REPLACEMENTS) for x in (F.lit(t), F.lit(i))))
    heirs = every.join(marks, "id", "left_semi").where(F.col("tag").isin(*REPLACEMENTS)).groupBy("id").agg(F.min_by("value", F.struct(preferred[F.col("tag")], "pos")).alias("main"))
    live = every.join(marks, "id", "left_anti")
    aliases = live.where("tag = 'alt_id'").where(F.col("value") != F.col("id"))
    if removed:
        aliases = aliases.where(~F.col("value").isin(removed))
    # an alternative id that heads a stanza of its own does not own further alternatives
    taken = aliases.select(F.col("value").alias("id")).distinct()
    alt = aliases.join(taken, "id", "left_anti").groupBy(F.col("value").alias("alt")).agg(F.max_by("id", F.struct("ord", "pos")).alias("main"))
    alternatives = heirs.select(F.col("id").alias("alt"), "main").union(alt.join(heirs.select(F.col("id").alias("alt")), "alt", "left_anti"))
    order = live.groupBy("id").agg(F.min("ord").alias("ord"), F.max(F.when(F.col("tag") == "name", F.col("value"))).alias("name"))
    terms = order.select(F.col("id").alias("term"), "name", "ord")
    known = F.trim(F.col("value"))
    edges = live.where("tag = 'is_a'").select(F.col("id").alias("child"), F.split(known, " ").getItem(0).alias("parent"), "pos")
    if removed:
        edges = edges.where(~F.col("parent").isin(removed))
    # a parent named by an alternative id is that id's term
    renamed = edges.join(alternatives.withColumnRenamed("alt", "parent"), "parent", "left").select("child", F.coalesce("main", "parent").alias("parent"), "pos")
    rest = live.where(~F.col("tag").isin("id", "name", "is_a")).select("tag", F.col("id").alias("term"), "value", "pos")
    for tag, pattern in (dictionaries or {}).items():
        if pattern:
            rest = rest.withColumn("value", F.when(F.col("tag") == tag, F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))).otherwise(F.col("value"))).where("value is not null")
    return Ontology(cut(terms), cut(renamed), cut(rest.select("tag", "term", "value", F.col("pos").cast("int").alias("pos"))), cut(alternatives), cut(marks.select(F.col("id").alias("term"))), header(tags),
                    extra={"typedefs": stanzas(tags, "Typedef"), "instances": stanzas(tags, "Instance")})


def read_obo(spark: SparkSession, path: str, removed: list[str] | None = None, dictionaries: dict[str, str | None] | None = None) -> Ontology:
    return from_tags(read_tags(spark, path), removed, dictionaries)

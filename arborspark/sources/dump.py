"""One JSON object for a whole ontology, as interchange with tools that dump their tables that way.

Read are terms (id: tag: value or values), alternatives_index, obsoletes, profiles
and items; indexes that follow from these are computed anew.  The form puts all
terms in one object, so it is one row while it is parsed or written: use
:mod:`.bundle` for anything large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Ontology
from ..operators.cuts import cut

SCHEMA = "terms map<string, map<string, string>>, alternatives_index map<string, string>, obsoletes map<string, string>, profiles map<string, array<string>>, items map<string, array<string>>"


def read_dump(spark: SparkSession, path: str) -> tuple[Ontology, DataFrame, DataFrame]:
    """The ontology, profiles (profile_id, term, pos) and items (term, item)."""
    whole = cut(spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("x")).select("x.*"))
    tags = whole.select(F.posexplode(F.map_entries("terms")).alias("ord", "t")).select("ord", F.col("t.key").alias("term"), F.explode(F.map_entries("t.value")).alias("e"))
    # a list of values arrives as its JSON text
    several = F.from_json("e.value", "array<string>")
    flat = cut(tags.select("ord", "term", F.col("e.key").alias("tag"), F.posexplode(F.when(F.col("e.value").startswith("["), several).otherwise(F.array("e.value"))).alias("pos", "value")))
    name = flat.where("tag = 'name'").select("term", F.col("value").alias("name"))
    terms = flat.select("term", F.lpad(F.col("ord").cast("string"), 12, "0").alias("ord")).distinct().join(name, "term", "left").select("term", "name", "ord")
    edges = flat.where("tag = 'is_a'").select(F.col("term").alias("child"), F.col("value").alias("parent"), "pos")
    entries = flat.where("tag not in ('id', 'name', 'is_a')").select("tag", "term", "value", "pos")
    alternatives = whole.select(F.explode(F.map_entries("alternatives_index")).alias("e")).select(F.col("e.key").alias("alt"), F.col("e.value").alias("main"))
    obsoletes = whole.select(F.explode(F.map_keys("obsoletes")).alias("term"))
    profiles = whole.select(F.explode(F.map_entries("profiles")).alias("e")).select(F.col("e.key").alias("profile_id"), F.posexplode("e.value").alias("pos", "term")).select("profile_id", "term", "pos")
    items = whole.select(F.explode(F.map_entries("items")).alias("e")).select(F.col("e.key").alias("term"), F.explode("e.value").alias("item"))
    return Ontology(terms, edges, entries, alternatives, obsoletes), profiles, items


def write_dump(onto: Ontology, path: str, profiles: DataFrame | None = None, items: DataFrame | None = None) -> None:
    """The same form, obsoletes too, so that a reloaded ontology answers alike."""
    spark = onto.terms.sparkSession
    values = onto.entries.union(onto.edges.select(F.lit("is_a").alias("tag"), "child", "parent", "pos"))
    lists = values.groupBy("term", "tag").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x")).select("term", "tag", F.col("x.value").alias("v"))
    single = F.col("tag").isin("comment", "namespace", "def", "is_obsolete", "created_by", "creation_date")
    fields = lists.select("term", F.concat(F.to_json(F.array("tag")), F.lit(":"), F.when(single, F.to_json(F.slice("v", 1, 1))).otherwise(F.to_json("v"))).alias("f"), single.alias("single"))
    # ["tag"]:["value"] becomes "tag":"value" or "tag":["value", ...]
    bare = F.regexp_replace("f", r'^\["(.*?)"\]:', '"$1":')
    text = fields.select("term", F.when(F.col("single"), F.regexp_replace(bare, r':\[(.*)\]$', ":$1")).otherwise(bare).alias("f")).groupBy("term").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    own = onto.terms.join(text, "term", "left").select("ord", "term", F.concat(quoted("term"), F.lit(":{\"id\":"), quoted("term"), F.when(F.col("name").isNotNull(), F.concat(F.lit(',"name":'), quoted("name"))).otherwise(F.lit("")), F.when(F.col("fs").isNotNull(), F.concat(F.lit(","), F.array_join("fs", ","))).otherwise(F.lit("")), F.lit("}")).alias("j"))
    body = own.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(F.struct("ord", "j"))).getField("j"), ","), F.lit("}")).alias("j"))

    def object_of(rows: DataFrame | None, key: str, value) -> DataFrame:
        if rows is None:
            return spark.createDataFrame([("{}",)], "j string")
        return rows.groupBy(key).agg(value.alias("v_")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "v_")))).alias("j"))

    parts = {
        "terms": body, "alternatives_index": object_of(onto.alternatives, "alt", F.first("main")), "obsoletes": object_of(onto.obsoletes, "term", F.lit("true")),
        "profiles": object_of(profiles, "profile_id", F.sort_array(F.collect_list(F.struct("pos", "term"))).getField("term")) if profiles is not None else object_of(None, "", None), "items": object_of(items, "term", F.sort_array(F.collect_list("item"))) if items is not None else object_of(None, "", None),
    }
    rows = None
    for i, (name, df) in enumerate(parts.items()):
        one = df.select(F.lit(i).alias("i"), F.concat(F.lit(f'"{name}":'), F.col("j")).alias("j"))
        rows = one if rows is None else rows.union(one)
    rows.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(F.struct("i", "j"))).getField("j"), ","), F.lit("}")).alias("value")).write.mode("overwrite").text(path)

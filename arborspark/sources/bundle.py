"""Ontologies with their profiles and items as a folder of JSON lines or Parquet, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Ontology

# The tables of a bundle and their columns.
TABLES = {
    "terms": "term string, name string, ord string", "edges": "child string, parent string, pos int", "entries": "tag string, term string, value string, pos int",
    "alternatives": "alt string, main string", "obsoletes": "term string", "header": "tag string, value string", "profiles": "profile_id string, term string, pos int", "items": "term string, item string",
}


def write_bundle(onto: Ontology, folder: str, profiles: DataFrame | None = None, items: DataFrame | None = None, form: str = "json") -> None:
    """Every table under its name; obsoletes and header are kept, so a reloaded ontology answers alike."""
    own = {name: getattr(onto, name) for name in ("terms", "edges", "entries", "alternatives", "obsoletes", "header")} | {"profiles": profiles, "items": items}
    for name, df in own.items():
        if df is not None:
            columns = [f"cast({part.split()[0]} as {part.split()[1]}) as {part.split()[0]}" for part in TABLES[name].split(", ")]
            df.selectExpr(*columns).write.mode("overwrite").format(form).save(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, form: str = "json") -> tuple[Ontology, DataFrame, DataFrame]:
    """The ontology, profiles and items; a table that was not written is empty."""
    found = {}
    for name, schema in TABLES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        found[name] = spark.read.schema(schema).format(form).load(f"{folder}/{name}") if there else spark.createDataFrame([], schema)
    return Ontology(*(found[k] for k in ("terms", "edges", "entries", "alternatives", "obsoletes", "header"))), found["profiles"], found["items"]

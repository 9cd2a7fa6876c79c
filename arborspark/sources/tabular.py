"""Tab-separated profiles and text tables, result lists, and the registry of ontologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiles import as_arrays


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def read_rows(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """cells: every line of headerless text, split."""
    return spark.read.text(path).select(F.split("value", _literal(separator)).alias("cells"))


def read_profiles(spark: SparkSession, path: str, separator: str = ";", id_column: int = 0, terms_column: int = 1) -> DataFrame:
    """profile_id, term, pos of a table with an id and a list of terms on each line."""
    rows = read_rows(spark, path).select(F.get("cells", F.lit(id_column)).alias("profile_id"), F.split(F.get("cells", F.lit(terms_column)), _literal(separator)).alias("terms"))
    return rows.select("profile_id", F.posexplode("terms").alias("pos", "term")).where("term <> ''").select("profile_id", "term", "pos")


def read_texts(spark: SparkSession, path: str, separator: str = "\t", column: int = 0, filter_column: int | None = None, filter_value: str | None = None) -> DataFrame:
    """text: the distinct values of a column, of lines with a value in another column if asked."""
    rows = read_rows(spark, path, separator)
    if filter_column is not None:
        rows = rows.where(F.get("cells", F.lit(filter_column)) == filter_value)
    return rows.select(F.get("cells", F.lit(column)).alias("text")).where("text is not null").distinct()


def is_number(text):
    """Whether a text column reads as a number."""
    return F.expr(f"try_cast({text} as double) is not null")


def merged_values(rows: DataFrame, distinct: bool = True) -> DataFrame:
    """key, values: all values of a key (key, value), each once if distinct."""
    return rows.groupBy("key").agg((F.sort_array(F.collect_set("value")) if distinct else F.sort_array(F.collect_list("value"))).alias("values"))


def write_lines(df: DataFrame, path: str) -> None:
    """All columns as text, parted by tabs, without a header."""
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def profile_lines(profiles: DataFrame, separator: str = "|") -> DataFrame:
    """profile_id and its terms joined."""
    return as_arrays(profiles).select("profile_id", F.array_join("terms", separator).alias("terms"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """key, source of a registry table."""
    return read_rows(spark, path).select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("source"))


def ontology_file(spark: SparkSession, name: str, registry_path: str, folder: str) -> str:
    """The file of a name: the path itself if it exists, else the local copy of a registered key.

    Downloading is left out on purpose: a cluster job should read from its store.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return name
    if registry(spark, registry_path).where(F.col("key") == name).isEmpty():
        raise FileNotFoundError(f"{name} is neither a file nor a registered key")
    return f"{folder}/{name}.obo"

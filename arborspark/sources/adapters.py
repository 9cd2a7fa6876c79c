"""Hierarchies, profiles and items in relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Ontology


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def from_edges(edges: DataFrame, names: DataFrame | None = None) -> Ontology:
    """An ontology of child, parent rows whose every node is a term; names are (term, name), else a term is its own name."""
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    terms = nodes.join(names, "term", "left") if names is not None else nodes.withColumn("name", F.col("term"))
    return Ontology(terms.select("term", "name", F.col("term").alias("ord")), edges.select("child", "parent").distinct().withColumn("pos", F.lit(0)))


def geography(spark: SparkSession, folder: str) -> Ontology:
    """WORLD above regions R:, nations N:, customers C: and suppliers S:."""
    t = lambda name: table(spark, folder, name)
    edges = t("region").select(_key("R:", "r_regionkey").alias("child"), F.lit("WORLD").alias("parent"))
    edges = edges.union(t("nation").select(_key("N:", "n_nationkey"), _key("R:", "n_regionkey")))
    edges = edges.union(t("customer").select(_key("C:", "c_custkey"), _key("N:", "c_nationkey"))).union(t("supplier").select(_key("S:", "s_suppkey"), _key("N:", "s_nationkey")))
    names = t("region").select(_key("R:", "r_regionkey").alias("term"), F.col("r_name").alias("name")).union(t("nation").select(_key("N:", "n_nationkey"), "n_name")).union(t("customer").select(_key("C:", "c_custkey"), "c_name")).union(t("supplier").select(_key("S:", "s_suppkey"), "s_name"))
    return from_edges(edges, names.union(spark.createDataFrame([("WORLD", "WORLD")], "term string, name string")))


def nations(spark: SparkSession, folder: str) -> Ontology:
    """The upper part of geography: WORLD, regions, nations."""
    t = lambda name: table(spark, folder, name)
    edges = t("region").select(_key("R:", "r_regionkey").alias("child"), F.lit("WORLD").alias("parent")).union(t("nation").select(_key("N:", "n_nationkey"), _key("R:", "n_regionkey")))
    return from_edges(edges)


def parts(spark: SparkSession, folder: str) -> Ontology:
    """PART above TYPE: and BRAND:, each part P: below one of both."""
    part = table(spark, folder, "part")
    edges = part.select(_key("TYPE:", "p_type").alias("child"), F.lit("PART").alias("parent")).union(part.select(_key("BRAND:", "p_brand"), F.lit("PART")))
    return from_edges(edges.union(part.select(_key("P:", "p_partkey"), _key("TYPE:", "p_type"))).union(part.select(_key("P:", "p_partkey"), _key("BRAND:", "p_brand"))))


def calendar(spark: SparkSession, folder: str) -> Ontology:
    """ALL above years, months and days of shipping."""
    day = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")).distinct()
    up = lambda n, m: day.select(F.substring("d", 1, n).alias("child"), F.substring("d", 1, m).alias("parent") if m else F.lit("ALL").alias("parent")).distinct()
    return from_edges(up(10, 7).union(up(7, 4)).union(up(4, 0)))


def supplier_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier with the nations N: of the customers that bought from it."""
    t = lambda name: table(spark, folder, name)
    sold = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    rows = sold.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(_key("S:", "l_suppkey").alias("profile_id"), _key("N:", "c_nationkey").alias("term")).distinct()
    return rows.withColumn("pos", F.substring("term", 3, 10).cast("int"))


def customer_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer with the parts P: that it bought."""
    t = lambda name: table(spark, folder, name)
    rows = t("lineitem").select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(_key("C:", "o_custkey").alias("profile_id"), _key("P:", "l_partkey").alias("term")).distinct().withColumn("pos", F.lit(0))


def mixed_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier with the parts P:, types TYPE: and brands BRAND: that it ships at a discount of 7 %, 8 % and 9 % or more."""
    t = lambda name: table(spark, folder, name)
    sold = t("lineitem").select("l_suppkey", "l_partkey", "l_discount").join(t("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    term = F.when(F.col("l_discount") < 0.075, _key("P:", "p_partkey")).when(F.col("l_discount") < 0.085, _key("TYPE:", "p_type")).otherwise(_key("BRAND:", "p_brand"))
    return sold.where("l_discount >= 0.065").select(_key("S:", "l_suppkey").alias("profile_id"), term.alias("term")).distinct().withColumn("pos", F.lit(0))


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each type TYPE: and brand BRAND: with the orders that have a part of it."""
    t = lambda name: table(spark, folder, name)
    sold = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.select("l_orderkey", F.explode(F.array(_key("TYPE:", "p_type"), _key("BRAND:", "p_brand"))).alias("term"))
    return rows.select("term", F.col("l_orderkey").alias("item")).distinct()

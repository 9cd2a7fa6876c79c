"""Sharding of a corpus by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side,
and dealt to ranges between splitters of a size-weighted sample (see
:mod:`.ranges`).  With the law "bytes" the order is cut where the running size
passes each eighth, "rows" cuts at equal counts, "key" gives each doc_id to the
shard with its highest hash (rendezvous hashing), so a further shard takes rows
only into itself.  A group of equal texts is cut only where a shard ends.

Defined cases: a null text has size 1 and checksum 0; repeated rows have slots
of their own; null doc_ids come first in their text's order and count as 0 for
"key"; an empty table gives no rows.  Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import sampled_ranges
from .shared import cut, documents

LAWS = ("bytes", "rows", "key")


def rendezvous(key: Column, shards: int) -> Column:
    """The shard of the highest hash of (key, shard)."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)))).getField("s")


def shard(docs: DataFrame, shards: int = 8, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("a_"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("b_"),
    ))
    ranges = sampled_ranges(rows, "a_", "b_", "size")
    order = ("a_", "b_", "size", "text_crc32")
    dealt = rows.withColumn("r_", ranges.of("a_", "b_"))
    if law == "key":
        own = F.coalesce("doc_id", F.lit(0))
        placed = dealt.withColumn("shard", rendezvous(own, shards)).withColumn("grown_shard", rendezvous(own, shards + 1))
    else:
        inside = Window.partitionBy("r_").orderBy(*order)
        if law == "bytes":
            until = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + ranges.before(ranges.weight, F.col("r_"))
            middle, total = until - F.col("size") + F.floor(F.col("size") / 2), max(1, sum(ranges.weight))
        else:
            middle, total = F.row_number().over(inside) - 1 + ranges.before(ranges.rows, F.col("r_")), max(1, sum(ranges.rows))
        # middle * shards could pass 2**63 only beyond an exabyte
        placed = dealt.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int")).withColumn("grown_shard", F.lit(None).cast("int"))
    placed = cut(placed)
    counts = placed.groupBy("shard", "r_").agg(F.count("*").alias("n_"))
    base = counts.select("shard", "r_", (F.sum("n_").over(Window.partitionBy("shard").orderBy("r_")) - F.col("n_")).alias("base_"))
    number = F.row_number().over(Window.partitionBy("r_", "shard").orderBy(*order)) - 1
    numbered = placed.withColumn("slot", number).join(base, ["r_", "shard"]).withColumn("slot", (F.col("slot") + F.col("base_")).cast("long"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 8, "bytes")

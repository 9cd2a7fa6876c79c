"""Structured Streaming form of the observed-frequency aggregate.

Annotations arrive as (ts, term).  Each batch meets the closure, a static table,
and a window's counts per ancestor are the state; late rows beyond the watermark
are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ontology


def observed_in_windows(stream: DataFrame, onto: Ontology, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """window_start, term, observed_freq; a streaming table if the input is one, else the same rows at once."""
    above = onto.reflexive.select("term", "ancestor")
    timed = stream.withWatermark("ts", watermark) if stream.isStreaming else stream
    counted = timed.join(above, "term").groupBy(F.window("ts", window).alias("w"), F.col("ancestor").alias("term")).agg(F.count("*").cast("double").alias("observed_freq"))
    return counted.select(F.col("w.start").alias("window_start"), "term", "observed_freq")

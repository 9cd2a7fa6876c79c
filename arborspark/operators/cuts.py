"""Cutting lineage in iterative plans: always to the shared checkpoint folder, never to executors' disks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the folder of spark.checkpoint.dir (a temporary one where that is unset, as in tests)."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)

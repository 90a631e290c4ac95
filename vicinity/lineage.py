"""Cut long lineages with a reliable checkpoint."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names.

    On one machine a temporary one when none is named; executors elsewhere could not see it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("name a folder all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="vicinity-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute the rows once and keep them where a lost executor cannot take them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

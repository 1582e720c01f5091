"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder that becomes it on one machine, and an error on several."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(made := f"file://{tempfile.mkdtemp(prefix='stemma-')}")
    return made


def cut(df: DataFrame) -> DataFrame:
    """Run the plan once, keep its rows in the shared folder and forget the lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)

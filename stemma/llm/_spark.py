"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stemma.sources.shared import cut, shared_dir

__all__ = ["batch_of", "clear", "cut", "cut_columnar"]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has cut; frames that read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_columnar(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed Parquet table; for wide intermediate rows that are read more than once."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

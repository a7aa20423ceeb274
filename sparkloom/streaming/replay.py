"""Replay of stored fields as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A streaming DataFrame over the Parquet files of ``path``, some files at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def step_files(field: DataFrame, path: str, step_elements: int) -> None:
    """Write ``idx, value`` as one file for each step of so many elements, in order of time of writing."""
    from pyspark.sql import functions as F

    steps = [r[0] for r in field.select(F.floor(F.col("idx") / step_elements).cast("long").alias("s")).distinct().orderBy("s").collect()]
    for s in steps:  # one small job a step: files must appear in order
        field.where((F.col("idx") >= s * step_elements) & (F.col("idx") < (s + 1) * step_elements)).coalesce(1).write.mode("append").parquet(path)

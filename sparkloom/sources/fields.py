"""Raw float files, discovery by extension, file names with parameters, encoded chunk tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, folder: str, extension: str, most: int | None = None) -> DataFrame:
    """``path, length`` of files with an extension in alphabetical order, at most ``most``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "false").load(folder).select("path", "length").orderBy("path")
    return files.limit(most) if most else files


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = raw.as_buffer()
            if not data.size or data.size % 4:
                raise ValueError(f"{path}: not a whole number of floats")
            v = np.frombuffer(data, "<f4")
            for k in range(0, len(v), 1 << 16):
                part = v[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(part)], names=["field_id", "idx", "value"])


def load_raw(spark: SparkSession, path: str, expected_bytes: int | None = None, extension: str = ".f32") -> DataFrame:
    """``field_id, idx, value`` of raw little-endian float files; a short file is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(path)
    if expected_bytes is not None:
        files = files.withColumn("content", F.when(F.col("length") < expected_bytes, F.raise_error(F.concat(F.lit("short read: "), "path")).cast("binary")).otherwise(F.col("content")))
    return files.select("path", "content").mapInArrow(_values, "field_id string, idx long, value float")


def load_hdf5(spark: SparkSession, path: str, dataset: str = "data") -> DataFrame:
    """A dataset of a local HDF5 file, where h5py is installed."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("HDF5 needs h5py, which is not installed; convert to Parquet or raw floats") from e
    with h5py.File(path) as f:
        values = np.asarray(f[dataset], np.float32).ravel()
    return spark.createDataFrame(pd.DataFrame({"field_id": path, "idx": np.arange(len(values)), "value": values}))


def load_field(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension: .h5/.hdf5, .parquet, else raw floats."""
    if path.endswith((".h5", ".hdf5")):
        return load_hdf5(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("field_id", "idx", "value")
    return load_raw(spark, path, extension="." + path.rsplit(".", 1)[-1])


def parse_names(files: DataFrame) -> DataFrame:
    """Parameters in names like ``f32_normal_p0.10_w4.0_random.bin``: type, palette, perturbation, bin width, fill."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda p: F.regexp_extract(name, p, 1)
    none = lambda c: F.when(c != "", c)
    return files.withColumns(
        {
            "dtype": none(part(r"^(f32|f64|i32|u8)_")), "palette": none(part(r"^(?:f32|f64|i32|u8)_([a-z_]+?)_p")),
            "perturbation": none(part(r"_p([0-9.]+?)(?:_|\.[a-z]+$)")).try_cast("double"), "bin_width": none(part(r"_w([0-9.]+?)(?:_|\.[a-z]+$)")).try_cast("double"),
            "fill": none(part(r"_w[0-9.]+_([a-z]+)")),
        }
    )


def write_chunks(encoded: DataFrame, path: str) -> None:
    """Encoded chunks as Parquet by field, so that a field's chunks are read alone."""
    encoded.write.mode("overwrite").partitionBy("field_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, field_id: str | None = None) -> DataFrame:
    """Encoded chunks, of one field by partition pruning."""
    df = spark.read.parquet(path)
    return df.where(F.col("field_id") == field_id) if field_id else df


def algorithms_attribute(encoded: DataFrame) -> DataFrame:
    """``field_id, algorithms``: the comma-separated algorithms of its chunks in order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "comp_algo"))), lambda s: s["comp_algo"])
    return encoded.groupBy("field_id").agg(F.array_join(names, ",").alias("algorithms"))

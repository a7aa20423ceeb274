"""Chunk statistics: one pass of partial aggregates, byte entropy, deviation and second difference.

All take a chunked field ``field_id, chunk_id, pos, value``.  A null value is no element: it is left out of
everything, and a chunk of nulls alone has no row.  NaN is left out of minimum and maximum and of nothing
else; a chunk of NaN alone has neither.  Rows without chunk_id are a chunk of their own.  Sums are doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import float_word, word_bytes

KEYS = ["field_id", "chunk_id"]


def _elements(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("value").isNotNull())


def basic(chunks: DataFrame) -> DataFrame:
    """``n, sum, min, max, range, mean`` of each chunk."""
    v, seen = F.col("value").cast("double"), F.when(~F.isnan("value"), F.col("value")).cast("double")
    out = _elements(chunks).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.min(seen).alias("min"), F.max(seen).alias("max"))
    return out.withColumns({"range": F.col("max") - F.col("min"), "mean": F.col("sum") / F.col("n")})


def mean_abs_deviation(chunks: DataFrame) -> DataFrame:
    """``mad``: mean of ``|x - mean|``, not divided by the range."""
    v = F.col("value").cast("double")
    centred = _elements(chunks).withColumn("dev", F.abs(v - F.avg(v).over(Window.partitionBy(*KEYS))))
    return centred.groupBy(*KEYS).agg((F.sum("dev") / F.count("*")).alias("mad"))


def second_difference(chunks: DataFrame) -> DataFrame:
    """``deriv``: mean of ``|x[i+1] - 2 x[i] + x[i-1]|`` over the inner elements; 0 for fewer than three."""
    v, w = F.col("value").cast("double"), Window.partitionBy(*KEYS).orderBy("pos")
    d2 = _elements(chunks).withColumn("d2", F.abs(F.lead(v).over(w) - 2 * v + F.lag(v).over(w)))
    n = F.count("*")
    return d2.groupBy(*KEYS).agg(F.when(n > 2, F.sum("d2") / (n - 2)).otherwise(F.lit(0.0)).alias("deriv"))


def byte_histogram(chunks: DataFrame) -> DataFrame:
    """``byte, count`` of each chunk's raw float bytes."""
    return _elements(chunks).select(*KEYS, F.explode(word_bytes(float_word(F.col("value")))).alias("byte")).groupBy(*KEYS, "byte").agg(F.count("*").alias("count"))


def entropy_of(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy in bits of histogram rows ``keys, count``."""
    total = F.sum("count").over(Window.partitionBy(*keys))
    p = F.col("count") / F.col("total")
    return hist.withColumn("total", total).groupBy(*keys).agg(F.abs(F.sum(-p * F.log2(p))).alias("entropy"))


def byte_entropy(chunks: DataFrame) -> DataFrame:
    return entropy_of(byte_histogram(chunks), KEYS)


def text_entropy(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, entropy`` of the UTF-8 bytes of a text column; null for a null text, 0 for an empty one.

    A histogram a row, over Arrow: a row a byte would multiply the table.
    """
    bits = F.pandas_udf(lambda x: pd.Series([None if b is None else entropy_bytes(b) for b in x], dtype="float64"), "double")
    return docs.select(key, bits(F.encode(text, "utf-8")).alias("entropy"))


def features(chunks: DataFrame) -> DataFrame:
    """All statistics of each chunk in one shuffle: rows are brought together by chunk and reduced with numpy.

    The relational forms above give the same values; this one moves each value once.
    """
    placed = _elements(chunks).select(*KEYS, "pos", F.col("value").cast("float").alias("value")).repartition(*KEYS).sortWithinPartitions(*KEYS, "pos")
    return placed.mapInArrow(_features, "field_id string, chunk_id long, n long, sum double, min double, max double, range double, mad double, deriv double, entropy double")


_COLUMNS = ["field_id", "chunk_id", "n", "sum", "min", "max", "range", "mad", "deriv", "entropy"]


def chunk_stats(x: np.ndarray) -> tuple[float | None, ...]:
    """(sum, min, max, range, mad, deriv, entropy) of one chunk of floats."""
    v = x.astype(np.float64)
    seen = v[~np.isnan(v)]
    low, high = (float(seen.min()), float(seen.max())) if len(seen) else (None, None)
    mad = float(np.abs(v - v.mean()).mean()) if len(v) else 0.0
    deriv = float(np.abs(v[2:] - 2 * v[1:-1] + v[:-2]).sum() / (len(v) - 2)) if len(v) > 2 else 0.0
    return float(v.sum()), low, high, None if low is None else high - low, mad, deriv, entropy_bytes(x.tobytes())


def entropy_bytes(raw: bytes) -> float:
    """Shannon entropy of bytes in bits; 0 for none."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / max(len(raw), 1)
    return float(abs(-(p * np.log2(p)).sum()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    name: tuple | None = None

    def row() -> tuple:
        x = np.concatenate(held)
        return (name[0], None if name[1] == -(1 << 63) else int(name[1]), len(x), *chunk_stats(x))

    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple] = []
        ids, chunk, value = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).fill_null(-(1 << 63)).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (ids[1:] != ids[:-1])) + 1).tolist(), len(chunk)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if name != (ids[a], chunk[a]):
                if held:
                    out.append(row())
                held, name = [], (ids[a], chunk[a])
            held.append(value[a:b].astype(np.float32))
        if out:
            yield _batch(out)
    if held:
        yield _batch([row()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64()] + [pa.float64()] * 7
    return pa.RecordBatch.from_arrays([pa.array([None if i == "" else v for v in c], t) for i, (c, t) in enumerate(zip(zip(*rows, strict=True), types, strict=True))], names=_COLUMNS)


def _array_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = b.column(2)
        flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        rows = [(int(e - a), *chunk_stats(flat[a:e].astype(np.float32))) for a, e in zip(at[:-1], at[1:], strict=True)]
        types = [pa.int64()] + [pa.float64()] * 7
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["field_id", "chunk_id", "values", *_COLUMNS[2:]])


def array_features(arrays: DataFrame) -> DataFrame:
    """Chunks ``field_id, chunk_id, values`` with their statistics: no shuffle beyond the one that made the arrays."""
    return arrays.select(*KEYS, "values").mapInArrow(_array_rows, "field_id string, chunk_id long, values array<float>, n long, sum double, min double, max double, range double, mad double, deriv double, entropy double")

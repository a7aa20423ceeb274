"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import partial, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every word-based contract: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of text, that numpy code takes at once; a longer text is taken alone.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19

#: Scratch tables that exist, and those of the scope that is open.
_live: dict[str, None] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch in jobs that this subpackage runs itself over texts or sets.
BATCH_ROWS = 2000


def _give_back() -> None:
    """Free memory that Arrow and the allocator keep.

    Workers live on between tasks and share their executor's memory; without the trim the allocator's
    leftovers of large work arrays took executors of 3 GB over their limit.
    """
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that gives free memory back after each batch."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            _give_back()

    @wraps(f)
    def inner(batches: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
        yield from f(taken(batches), *args, **options)
        _give_back()

    return inner


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for jobs run inside; the session's setting stands again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS if int(was) <= 0 else min(int(was), BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def text_slices(batch: pa.RecordBatch, column: int = 1, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold few rows and little text, so that work arrays stay small."""
    n = batch.num_rows
    if not n:
        return
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < n:
        end = int(np.searchsorted(total, total[at] + size, side="right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (a local master) gets a folder of this process;
    any other raises ValueError, for its executors could not read such a folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "shared")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder for a table that cuts lineage."""
    path = f"{shared_dir(spark).rstrip('/')}/sparkloom-{tag}-{uuid.uuid4().hex}"
    _live[path] = None
    made = _scope.get()
    if made is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: later stages survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The paths of all scratch tables made inside, for :func:`drop_scratch` when their readers are done."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
        outer = _scope.get()
        if outer is not None:
            outer += made


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; unknown or deleted ones are passed over."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        if name in _live:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
            del _live[name]


def _drop_all() -> None:
    """At the end of the driver program no result is read any more, so what is left can go."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _live:
        with suppress(Exception):  # the JVM may be gone
            drop_scratch(spark, list(_live))


atexit.register(_drop_all)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@tidy
def _sums(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    part, run = TaskContext.get().partitionId(), [0] * len(names)
    for batch in batches:
        cols = list(batch.columns)
        for k, name in enumerate(names):
            at = batch.schema.get_field_index(name)
            end = np.cumsum(cols[at].to_numpy(zero_copy_only=False)) + run[k]
            cols[at] = pa.array(np.concatenate([[run[k]], end[:-1]]) if len(end) else end, pa.int64())
            run[k] = int(end[-1]) if len(end) else run[k]
            cols.append(batch.column(at))
        cols.append(pa.array(np.full(batch.num_rows, part, np.int32)))
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *[f"{n}_own_" for n in names], "part_"])


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str, partitions: int = 0) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of that column over all rows before it in ``order``.

    Rows are dealt by ranges of ``order`` and sorted there; sums run within a range, and the ranges' totals
    (one row each) are summed in order.  So no task holds more than its range, whatever the keys, as long as
    ``order`` tells rows apart.  ``sums`` are non-null whole numbers, their totals below 2^63.
    """
    names, own = list(sums), df.columns
    rows = df.withColumns({n: c.cast("long") for n, c in sums.items()})
    rows = rows.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n}_own_ long" for n in names] + ["part_ int"])
    rows = materialize(rows.mapInArrow(partial(_sums, names=names), schema), tag)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("part_").agg(*[F.sum(f"{n}_own_").alias(f"{n}_all_") for n in names])
    base = ranges.select("part_", *[F.coalesce(F.sum(f"{n}_all_").over(before), F.lit(0)).alias(f"{n}_base_") for n in names])
    # a row for each range: small whatever the input
    return rows.join(F.broadcast(base), "part_").select(*own, *[(F.col(n) + F.col(f"{n}_base_")).alias(n) for n in names])

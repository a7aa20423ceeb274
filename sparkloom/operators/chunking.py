"""Arrays as long tables, cut into chunks.

A field is ``field_id, idx, value`` with ``idx`` the place in C order (last dimension fastest).
Chunk ids and places come from arithmetic on ``idx``; nothing is shuffled or ordered for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_1d(field: DataFrame, size: int, drop_tail: bool = False, total: int | None = None) -> DataFrame:
    """Adds ``chunk_id, pos``.  The last chunk may be short; ``drop_tail`` (needs ``total``) leaves it out."""
    out = field.withColumns({"chunk_id": whole(F.col("idx"), size), "pos": F.pmod("idx", F.lit(size)).cast("int")})
    return out.where(F.col("chunk_id") < total // size) if drop_tail and total is not None else out


def chunk_counts(dims: Sequence[int], chunk: Sequence[int]) -> list[int]:
    """Chunks along each dimension, partial ones included."""
    return [-(-d // c) for d, c in zip(dims, chunk, strict=True)]


def whole(idx: Column, size) -> Column:
    """``idx div size`` in whole numbers, exact beyond 2^53."""
    return F.call_function("div", idx.cast("long"), F.lit(size).cast("long"))


def coordinates(idx: Column, dims: Sequence[int]) -> list[Column]:
    """N-D coordinates of a linear index, last dimension fastest."""
    return [F.pmod(whole(idx, prod(dims[k + 1 :])), F.lit(d)).cast("long") for k, d in enumerate(dims)]


def linear(coords: Sequence[Column], dims: Sequence[int]) -> Column:
    """Linear index of coordinates."""
    out = F.lit(0).cast("long")
    for c, d in zip(coords, dims, strict=True):
        out = out * d + c
    return out


def gather(field: DataFrame, dims: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """Adds ``chunk_id, pos``: the hyper-rectangle of each element and its place there, in C order.

    Chunks at the upper edges are cut, not padded.
    """
    at = coordinates(F.col("idx"), dims)
    grid = chunk_counts(dims, chunk)
    of = [whole(c, s) for c, s in zip(at, chunk, strict=True)]
    pos = F.lit(0).cast("long")
    for c, o, s, d in zip(at, of, chunk, dims, strict=True):
        pos = pos * F.least(F.lit(s), d - o * s) + (c - o * s)
    return field.withColumns({"chunk_id": linear(of, grid), "pos": pos.cast("long")})


def scatter(chunks: DataFrame, dims: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """The inverse of :func:`gather`: ``idx`` from ``chunk_id, pos``."""
    grid = chunk_counts(dims, chunk)
    of = coordinates(F.col("chunk_id"), grid)
    sizes = [F.least(F.lit(s), d - o * s) for o, s, d in zip(of, chunk, dims, strict=True)]
    rest, inner = F.col("pos"), []
    for size in reversed(sizes):
        inner.append(F.pmod(rest, size))
        rest = whole(rest, size)
    inner.reverse()
    return chunks.withColumn("idx", linear([o * s + i for o, s, i in zip(of, chunk, inner, strict=True)], dims))


def is_contiguous(dims: Sequence[int], chunk: Sequence[int]) -> bool:
    """Whether a whole chunk is one run of the field: all dimensions but the first non-trivial one are whole."""
    inner = False
    for d, c in zip(dims, chunk, strict=True):
        if inner and c != d:
            return False
        inner = inner or c > 1
    return True


def sub_chunk(pos: Column, element_bytes: int, sub_bytes: int) -> Column:
    """Number of the sub-chunk (256 KiB for shuffles, 64 KiB for codecs) that an element lies in."""
    return whole(pos * element_bytes, sub_bytes)


def concat_and_pad(tensors: DataFrame, total: int) -> DataFrame:
    """``idx, value`` of tensors ``tensor_id, pos, value`` end to end, zero-padded to ``total``.

    More than ``total`` values are an error.  Offsets are sums over tensors, one row each.
    """
    from pyspark.sql import Window

    sizes = tensors.groupBy("tensor_id").agg(F.count("*").alias("n"))
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("tensor_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = tensors.join(start, "tensor_id").select((F.col("start") + F.col("pos")).alias("idx"), "value")
    checked = placed.withColumn("value", F.when(F.col("idx") >= total, F.raise_error(F.lit("tensors are longer than the padded size")).cast("float")).otherwise(F.col("value")))
    return tensors.sparkSession.range(total).withColumnRenamed("id", "idx").join(checked, "idx", "full").select("idx", F.coalesce("value", F.lit(0).cast("float")).alias("value"))


def choose_2d(n: int) -> tuple[int, int]:
    """Rows and columns nearest to a square that hold ``n`` values exactly."""
    r = int(n**0.5)
    while r > 1 and n % r:
        r -= 1
    return max(r, 1), n // max(r, 1)


def periodic_neighbours(field: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Adds ``neighbours``: the sum over both neighbours along every dimension, with wrap-around.

    Every element is sent once to each neighbour (a narrow explode) and summed where it lands.
    """
    at = coordinates(F.col("idx"), dims)
    targets = []
    for k, d in enumerate(dims):
        for step in (1, -1):
            moved = list(at)
            moved[k] = F.pmod(at[k] + step, F.lit(d))
            targets.append(linear(moved, dims))
    sent = field.select(F.explode(F.array(*targets)).alias("idx"), F.col("value").alias("from_"))
    return field.join(sent.groupBy("idx").agg(F.sum("from_").alias("neighbours")), "idx")

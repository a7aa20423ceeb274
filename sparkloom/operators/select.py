"""Choice of an encoding: candidates, masks, cost, ranks, exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import action_algo, action_quant, action_shuffle, cost, heuristic_algorithm


def candidates(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Every chunk with every configuration; the configurations are a fixed table of 32 or 64 rows."""
    return chunks.crossJoin(F.broadcast(configs))


def mask_lossless(rows: DataFrame, error_bound: float) -> DataFrame:
    """Without an error bound, quantised candidates go."""
    return rows if error_bound > 0 else rows.where(F.col("quant") == 0)


def mask_psnr(rows: DataFrame, min_psnr: float) -> DataFrame:
    return rows if min_psnr <= 0 else rows.where(F.col("psnr") >= min_psnr)


def formula_predictions(rows: DataFrame) -> DataFrame:
    """Deterministic stand-in predictions from a chunk's statistics and an action: a fixture, no claim about codecs."""
    a, q, s = action_algo(F.col("action32")), action_quant(F.col("action32")), action_shuffle(F.col("action32"))
    size = F.col("n_bytes") / 4096.0
    return rows.withColumns(
        {
            "ct": 0.5 + a * 0.125 + s * 0.25 + size,
            "dt": 0.25 + a * 0.0625 + s * 0.125 + size / 2,
            "ratio": (1 + a * 0.25 + s * 0.5) * (1 + q * 2.0) * 8.0 / (1 + F.round("entropy", 6)),
            "psnr": F.when(q == 1, 40.0 + 2.5 * a).otherwise(120.0),
        }
    )


def with_cost(rows: DataFrame, w0=1.0, w1=1.0, w2=1.0, **options) -> DataFrame:
    return rows.withColumn("cost", cost(F.col("ct"), F.col("dt"), F.col("ratio"), F.col("n_bytes"), w0, w1, w2, **options))


def ranked(rows: DataFrame, keys: Sequence[str], by: str = "cost", action: str = "action32") -> DataFrame:
    """Adds ``rank`` (1 is best) by cost, ties by the lower id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by, action)))


def best(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str = "cost", action: str = "action32") -> DataFrame:
    """The cheapest row of each group by a partial aggregate, without sorting all candidates."""
    first = F.min(F.struct(by, action, *columns)).alias("b")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"b.{c}").alias(c) for c in (by, action, *columns)])


def alternatives(rows: DataFrame, k: int) -> DataFrame:
    """The next ``k`` after the best of ranked rows."""
    return rows.where(F.col("rank").between(2, k + 1))


def heuristic(stats: DataFrame) -> DataFrame:
    return stats.withColumn("algorithm", heuristic_algorithm(F.col("entropy")))


def explored_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Explored samples in order: the primary first, then by cost."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_primary"), "cost", "action32")))


def adopt(primary: Column, explored: Column, fits: Column) -> Column:
    """Whether an explored alternative replaces the primary: strictly cheaper and within its room."""
    return (explored < primary) & fits


def random_actions(chunks: DataFrame, configs: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` configurations of each chunk by a seeded hash; reruns agree."""
    draw = F.xxhash64(F.lit(seed), "field_id", "chunk_id", "action64")
    rows = candidates(chunks, configs).withColumn("draw", F.row_number().over(Window.partitionBy("field_id", "chunk_id").orderBy(draw, "action64")))
    return rows.where(F.col("draw") <= n).drop("draw")

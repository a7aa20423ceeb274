"""Telemetry tables derived from the star schema, so that every analytic query has an input and an SQL twin.

Predictions and measurements are deterministic formulas of chunk statistics and configuration: fixtures
for the analytics, no claim about any codec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import config64
from ..functions.scalar import cost, fraction_error
from ..operators import chunking, stats

#: Elements of a chunk of the ``events`` field.
CHUNK = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.value`` in the order of ``event_id`` (a dense key) as one float field."""
    return read(spark, sf_dir, "events").select(F.lit("events").alias("field_id"), F.col("event_id").alias("idx"), F.col("value").cast("float").alias("value"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_1d(field(spark, sf_dir), CHUNK)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each chunk and 64-space configuration with predicted and real metrics."""
    e = stats.features(chunks(spark, sf_dir)).select("chunk_id", (F.col("n") * 4).alias("chunk_bytes"), F.round("entropy", 6).alias("entropy"))
    rows = e.crossJoin(F.broadcast(config64(spark)))
    a, s, q = F.col("algo_idx"), F.col("shuffle_bytes") / 4, (F.col("error_bound") > 0).cast("int")
    rows = rows.withColumns(
        {
            "pred_comp_ms": 1.5 + a * 0.125 + s * 0.25 + F.col("chunk_bytes") / 4096.0,
            "pred_decomp_ms": 1.25 + a * 0.0625 + s * 0.125 + F.col("chunk_bytes") / 8192.0,
            "pred_ratio": (1 + a * 0.25 + s * 0.5) * (1 + q * 2.0) * 8.0 / (1 + F.col("entropy")),
            "pred_psnr": F.when(q == 0, 120.0).otherwise(40.0 + F.pmod("action64", F.lit(4)) * 10.0),
            "drift": (F.pmod(F.col("chunk_id") * 31 + F.col("action64") * 17, F.lit(41)) - 20) / 40.0,
        }
    )
    for m in ("comp_ms", "decomp_ms", "ratio", "psnr"):
        rows = rows.withColumn(f"real_{m}", F.col(f"pred_{m}") * (1 + F.col("drift")))
    for kind in ("pred", "real"):
        rows = rows.withColumn(f"{kind}_cost", cost(F.col(f"{kind}_comp_ms"), F.col(f"{kind}_decomp_ms"), F.col(f"{kind}_ratio"), F.col("chunk_bytes"), 1, 1, 1, bandwidth=100.0))
    return rows.withColumns({f"mape_{m}_frac": fraction_error(F.col(f"pred_{m}"), F.col(f"real_{m}")) for m in ("cost", "ratio", "comp_ms", "decomp_ms")})


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk telemetry of four ranks: ``phase, rank, timestep, chunk, action, ratio, comp_ms, sgd_fired, n_chunks``."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.when(F.pmod("event_id", F.lit(3)) == 0, "nn-rl/balanced").when(F.pmod("event_id", F.lit(3)) == 1, "nn-rl/ratio").otherwise("zstd").alias("phase"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("rank"),
        F.pmod(F.floor(F.col("event_id") / 100), F.lit(20)).cast("int").alias("timestep"),
        F.pmod(F.floor(F.col("event_id") / 10), F.lit(10)).cast("int").alias("chunk"),
        F.pmod(F.col("event_id") * 7, F.lit(5)).cast("int").alias("action"),
        (1 + F.pmod("event_id", F.lit(17)) / 8.0).alias("ratio"),
        (1 + F.pmod("event_id", F.lit(23)) / 4.0).alias("comp_ms"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("sgd_fired"),
        (10 + F.pmod("user_id", F.lit(4))).cast("int").alias("n_chunks"),
        "event_id",
    )


def timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestep telemetry: sizes and stage times by ``phase, timestep``."""
    c = chunk_rows(spark, sf_dir)
    return c.groupBy("phase", "timestep").agg(
        (F.count("*") * 0.25).alias("orig_mib"), F.sum(0.25 / F.col("ratio")).alias("file_mib"), F.sum("comp_ms").alias("comp_ms"), F.sum(F.col("comp_ms") * 0.5).alias("write_ms"),
        (F.count("*") * 0.125).alias("stats_ms"), (F.count("*") * 0.0625).alias("nn_ms"), (F.count("*") * 0.25 - F.col("timestep") % 3 * 2.0).alias("stage1_ms"), (F.sum("comp_ms") * 0.75).alias("io_ms"),
    )

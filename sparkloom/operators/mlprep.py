"""Model preparation: schema mapping, grouped splits and folds, train-only normalisation, imputation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import ALGORITHMS
from ..functions.scalar import log_positive, log_time, psnr_target, ssim_target


def canonical(rows: DataFrame) -> DataFrame:
    """Generator rows in the canonical training schema; failed rows go."""
    return rows.where("success").select(
        F.col("chunk_id").cast("string").alias("file"), F.lower("algorithm").alias("algorithm"), F.when(F.col("quantized"), "linear").otherwise("none").alias("quantization"),
        F.col("shuffle_bytes").alias("shuffle"), "error_bound", F.col("original_bytes").alias("original_size"), F.col("entropy_bits").alias("entropy"), "mad", "second_derivative",
        F.col("comp_time_ms").alias("compression_time_ms"), F.col("decomp_time_ms").alias("decompression_time_ms"), "compression_ratio", "psnr_db", "ssim", "rmse",
        F.col("max_abs_error").alias("max_error"), F.col("mean_abs_error").alias("mean_abs_err"),
    )


def label_encode(rows: DataFrame) -> DataFrame:
    """Integer features for names: ``algo_idx, quant, shuffle_on``; an unknown algorithm is null."""
    at = F.array_position(F.array(*[F.lit(n) for n in ALGORITHMS[1:]]), F.lower("algorithm")).cast("int")
    return rows.withColumns({"algo_idx": F.when(at > 0, at - 1), "quant": (F.col("quantization") == "linear").cast("int"), "shuffle_on": (F.col("shuffle") > 0).cast("int")})


def targets(rows: DataFrame) -> DataFrame:
    """Transformed training targets."""
    return rows.withColumns({"y_comp": log_time(F.col("compression_time_ms")), "y_decomp": log_time(F.col("decompression_time_ms")), "y_ratio": log_positive(F.col("compression_ratio")), "y_psnr": psnr_target(F.col("psnr_db")), "y_ssim": ssim_target(F.coalesce("ssim", F.lit(1.0)))})


def _hash(key: str, seed: int, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(modulus))


def hash_split(key: str, percent: int = 80, seed: int = 42) -> Column:
    """Whether a group is in training, by a seeded hash of its key: the same on any cluster, without a shuffle."""
    return _hash(key, seed, 100) < percent


def hash_fold(key: str, folds: int = 5, seed: int = 7) -> Column:
    return _hash(key, seed, folds).cast("int")


def shuffled_split(rows: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``train``: the exact legacy-generator shuffle of the sorted keys, of which the first ``fraction`` are held out.

    Keys stay in Spark under their number; only the shuffled numbers (8 bytes a key) come from the driver.
    """
    from .ordering import dense_number

    spark = rows.sparkSession
    numbered = dense_number(rows.select(key).distinct(), [key], "number_")
    order = np.arange(numbered.count())
    np.random.RandomState(seed).shuffle(order)
    held = spark.createDataFrame(pd.DataFrame({"held_": order[: max(1, int(len(order) * fraction))] + 1}), "held_ long")
    names = numbered.join(held, numbered["number_"] == held["held_"], "left").select(key, F.col("held_").isNull().alias("train"))
    return join_null_safe(rows, names, [key])


def train_statistics(rows: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """One row: mean, population deviation (1 below 1e-8), minimum and maximum of training rows."""
    out = []
    for c in columns:
        v = F.when(train, F.col(c))
        sd = F.stddev_pop(v)
        out += [F.avg(v).alias(f"{c}_mean"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return rows.agg(*out)


def standardise(rows: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Adds ``*_z`` by the training rows' statistics, which is one broadcast row."""
    s = F.broadcast(train_statistics(rows, columns, train))
    return rows.crossJoin(s).withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(*rows.columns, *[f"{c}_z" for c in columns])


def join_null_safe(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by ``keys``, of which nulls are equal; one of each key column stays."""
    named = other.withColumnsRenamed({k: f"{k}_other_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_other_")) for k in keys]
    return rows.join(named, on, "left").drop(*[f"{k}_other_" for k in keys])


def impute_zero(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Zeros (and less) become the group's median of the positive values; null keys are a group as others are."""
    med = rows.groupBy(*keys).agg(F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.5).alias("med_"))
    return join_null_safe(rows, med, keys).withColumn(value, F.when(F.col(value) > 0, F.col(value)).otherwise(F.col("med_"))).drop("med_")


def group_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``group_id`` from 1 in key order: the distinct keys are numbered, not the rows.

    Partial counts by range of the distinct keys keep the numbering off a single task.
    """
    from .ordering import dense_number

    numbered = dense_number(rows.select(*keys).distinct(), list(keys), "group_id")
    return join_null_safe(rows, numbered, keys)


def size_interactions(rows: DataFrame) -> DataFrame:
    """Products of the logarithm of the size with each statistic."""
    s = F.log1p("original_size")
    return rows.withColumns({"size_entropy": s * F.col("entropy"), "size_mad": s * F.col("mad"), "size_deriv": s * F.col("second_derivative")})


def fold_grid(rows: DataFrame, fold: Column, folds: int, grid: DataFrame) -> DataFrame:
    """Rows of each parameter set and fold with their part, for grouped fitting; the grid is small."""
    cells = grid.crossJoin(rows.sparkSession.range(folds).select(F.col("id").cast("int").alias("held_fold")))
    return rows.withColumn("fold", fold).crossJoin(F.broadcast(cells)).withColumn("is_train", F.col("fold") != F.col("held_fold"))


def mean_abs_by_group(rows: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """``feature, importance``: mean absolute attribution, one-hot columns added up under one name."""
    sums = rows.agg(*[sum((F.avg(F.abs(F.col(c))) for c in cols), F.lit(0.0)).alias(name) for name, cols in groups.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in groups])).alias("x")).select("x.*")


def fold_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("folds"))


def masked_metrics(rows: DataFrame, predicted: str, real: str, mask: float = 0.01) -> DataFrame:
    """MAE, R2 and MAPE where ``|real| > mask``, in original units; also of quantised rows alone."""
    from .telemetry import mape_mae_r2

    every = mape_mae_r2(rows, [], F.col(predicted), F.col(real), cap=float("inf"), mask=mask).withColumn("slice", F.lit("all"))
    lossy = mape_mae_r2(rows.where(F.col("quantization") == "linear"), [], F.col(predicted), F.col(real), cap=float("inf"), mask=mask).withColumn("slice", F.lit("lossy"))
    return every.unionByName(lossy)


def windows_of(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys)

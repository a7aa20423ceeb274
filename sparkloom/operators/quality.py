"""Reconstruction quality of pairs ``original, restored``, as aggregates of one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: stabilisers of the global SSIM, as shares of the range
SSIM_K1, SSIM_K2 = 0.01, 0.03


def metrics(pairs: DataFrame, keys: Sequence[str] = (), compressed_bytes: Column | None = None) -> DataFrame:
    """``n, mse, rmse, mae, max_error, psnr, ssim`` (and ``bit_rate``) by ``keys``.

    A perfect match has infinite PSNR as 120 and SSIM 1.  A constant original (range 0) with errors has null PSNR.
    """
    x, y = F.col("original").cast("double"), F.col("restored").cast("double")
    d = x - y
    sums = [
        F.count("*").alias("n"), F.sum(d * d).alias("sq"), F.sum(F.abs(d)).alias("ab"), F.max(F.abs(d)).alias("max_error"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    ]
    if compressed_bytes is not None:
        sums.append(F.max(compressed_bytes).alias("stored"))
    s = pairs.groupBy(*keys).agg(*sums)
    n, span = F.col("n"), F.col("hi") - F.col("lo")
    mx, my = F.col("sx") / n, F.col("sy") / n
    vx, vy, cov = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my, F.col("sxy") / n - mx * my
    c1, c2 = (SSIM_K1 * span) * (SSIM_K1 * span), (SSIM_K2 * span) * (SSIM_K2 * span)
    mse = F.col("sq") / n
    ssim = ((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    perfect = F.col("sq") == 0
    out = s.select(
        *keys, "n", mse.alias("mse"), F.sqrt(mse).alias("rmse"), (F.col("ab") / n).alias("mae"), "max_error",
        F.when(perfect, F.lit(120.0)).when(span > 0, F.least(10 * F.log10(span * span / mse), F.lit(120.0))).alias("psnr"),
        F.when(perfect, F.lit(1.0)).otherwise(ssim).alias("ssim"),
        *([(F.col("stored") * 8.0 / n).alias("bit_rate")] if compressed_bytes is not None else []),
    )
    return out


def mismatches(pairs: DataFrame, keys: Sequence[str], bound: Column) -> DataFrame:
    """``mismatches`` (NaN differs from everything), ``violations`` of ``bound`` and ``max_error``."""
    x, y = F.col("original").cast("double"), F.col("restored").cast("double")
    differs = (x != y) | F.isnan(x) | F.isnan(y)
    return pairs.groupBy(*keys).agg(F.count_if(differs).alias("mismatches"), F.count_if(F.abs(x - y) > bound).alias("violations"), F.max(F.abs(x - y)).alias("max_error"))


def bytes_equal(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """``equal`` by ``keys``: whether binary columns agree in every row."""
    return pairs.groupBy(*keys).agg((~F.max(~F.col(a).eqNullSafe(F.col(b)))).alias("equal"))


def normalised_rmse(rmse: Column, span: Column) -> Column:
    """RMSE over the range; 0 for a range of 0."""
    return F.when(span > 0, rmse / span).otherwise(F.lit(0.0))


def quantised_pairs(field: DataFrame, keys: Sequence[str], bound: float) -> DataFrame:
    """``keys, original, restored, low, high, step_bound, bits, code``: linear quantisation by group and back."""
    from ..functions.scalar import dequantize, effective_bound, precision_bits, quantize

    v = F.col("value").cast("float").cast("double")
    limits = field.where(~F.isnan("value")).groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    with_bound = limits.withColumn("step_bound", effective_bound(F.lit(bound), F.col("low"), F.col("high")))
    with_bits = with_bound.withColumn("bits", precision_bits(F.col("low"), F.col("high"), F.col("step_bound")))
    # codes are centred: one step is twice the bound, the lowest value has the code 0
    joined = field.join(F.broadcast(with_bits) if not keys else with_bits, list(keys)) if keys else field.crossJoin(F.broadcast(with_bits))
    coded = joined.withColumn("code", quantize(v, F.col("low"), 1 / (2 * F.col("step_bound")), F.col("bits")))
    return coded.select(*keys, v.alias("original"), dequantize(F.col("code"), F.col("low"), 2 * F.col("step_bound")).cast("double").alias("restored"), "low", "high", "step_bound", "bits", "code")

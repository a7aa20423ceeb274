"""Telemetry tables: explicit schemas, column aliases, logs, and their writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of exchanged tables.
TRACE = "chunk_id int, action64 int, comp_lib string, chosen int, chunk_bytes long, " + ", ".join(f"{k}_{m} double" for k in ("pred", "real") for m in ("cost", "ratio", "comp_ms", "decomp_ms", "psnr", "ssim", "max_error")) + ", mape_cost_frac double, mape_ratio_frac double, mape_comp_ms_frac double, mape_decomp_ms_frac double, explore_mode int"
RANKING = "phase string, timestep int, chunk int, n_active_configs int, kendall_tau double, top1_regret double, predicted_best int, actual_best int, predicted_best_cost double, actual_best_cost double"
RANKING_COSTS = "phase string, timestep int, chunk int, action32 int, algo_name string, predicted_cost double, actual_cost double, actual_ratio double, actual_comp_ms double, actual_decomp_ms double, predicted_rank int, actual_rank int"
TIMING = "e2e_ms double, vol_ms double"


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """CSV files with a header; rows of the wrong shape go."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(paths if isinstance(paths, str) else list(paths))


def first_present(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first path that exists, on any file system Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def load_column(df: DataFrame, name: str, scale: float = 1.0) -> DataFrame:
    """One column as scaled doubles; what is no number, null or NaN goes."""
    v = F.col(name).try_cast("double") * scale
    return df.select(v.alias(name)).where(F.col(name).isNotNull() & ~F.isnan(name))


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first non-null of those columns that exist."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


#: Canonical columns from older names; a pair also scales.
ALIASES: Mapping[str, tuple] = {
    "file_mib": ("file_mib", "file_mb", ("file_bytes", 1 / 1048576)), "orig_mib": ("orig_mib", "orig_mb", ("orig_bytes", 1 / 1048576)),
    "write_mibps": ("write_mibps", "write_mbps"), "read_mibps": ("read_mibps", "read_mbps"), "ratio": ("ratio", "compression_ratio"),
}


def aliased(df: DataFrame, aliases: Mapping[str, tuple] = ALIASES) -> DataFrame:
    """Adds canonical columns from whichever older ones exist."""
    for name, old in aliases.items():
        parts = [(o, 1.0) if isinstance(o, str) else o for o in old]
        have = [F.col(c) if scale == 1.0 else F.col(c) * scale for c, scale in parts if c in df.columns]
        if have:
            df = df.withColumn(name, F.coalesce(*have))
    return df


def normalise(tables: Sequence[DataFrame], aliases: Mapping[str, tuple] = ALIASES) -> DataFrame:
    """One table of several with different columns, aliases resolved."""
    out = aliased(tables[0], aliases)
    for t in tables[1:]:
        out = out.unionByName(aliased(t, aliases), allowMissingColumns=True)
    return out


def parse_cv_log(spark: SparkSession, path: str) -> DataFrame:
    """``fold, metric, value`` of log lines like ``Fold 3: ratio MAPE = 12.5%``; ``fold`` is null for means."""
    lines = spark.read.text(path)
    line = F.col("value")
    found = lines.select(
        F.regexp_extract(line, r"(?i)fold\s+(\d+)", 1).alias("f"), F.regexp_extract(line, r"(?i)(?:fold\s+\d+\s*:|mean)\s*([\w /]+?)\s*[=:]", 1).alias("metric"),
        F.regexp_extract(line, r"[=:]\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?\d+)?)\s*%?\s*(?:\+/-.*)?$", 1).alias("v"),
    )
    return found.where("metric <> '' and v <> ''").select(F.when(F.col("f") != "", F.col("f").cast("int")).alias("fold"), F.trim("metric").alias("metric"), F.col("v").cast("double").alias("value"))


def to_sentinels(df: DataFrame, sentinels: Mapping[str, float]) -> DataFrame:
    """Nulls as the sentinel values that exchanged files use."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in sentinels.items()})


def from_sentinels(df: DataFrame, sentinels: Mapping[str, float]) -> DataFrame:
    """Sentinel values and NaN as nulls."""
    return df.withColumns({c: F.when((F.col(c) == v) | F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)) for c, v in sentinels.items()})


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A telemetry table as CSV with a header."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def timing(spark: SparkSession, e2e_ms: float, vol_ms: float) -> DataFrame:
    return spark.createDataFrame([(e2e_ms, vol_ms)], TIMING)


def lifetime_summary(chunks: DataFrame) -> DataFrame:
    """One row of totals: chunks, bytes in and out, ratio, learning and exploration counts."""
    return chunks.agg(F.count("*").alias("chunks"), F.sum("original_bytes").alias("original_bytes"), F.sum("encoded_bytes").alias("encoded_bytes"), (F.sum("original_bytes") / F.sum("encoded_bytes")).alias("ratio"))

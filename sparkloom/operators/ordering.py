"""Global numbering without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_number(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... (long) in the order of ``order`` (unique), by ranges of the rows themselves.

    Ranges are cut at quantiles of the first order column, which rows can tell on their own; so counts and
    numbers agree however often the plan runs.  Each range counts its rows; the running sum goes over ranges.
    """
    first, others = F.col(order[0]), [F.col(c).asc_nulls_first() for c in order]
    ranges = 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the first bytes of strings, or the numbers themselves, as doubles: never out of order, at worst equal
    kind = rows.schema[order[0]].dataType.simpleString()
    place = F.conv(F.hex(F.substring(F.encode(F.rpad(first, 7, "\0"), "utf-8"), 1, 7)), 16, 10).cast("double") if kind == "string" else first.cast("double")
    cuts = sorted({float(x) for x in rows.select(F.percentile_approx(place, [k / ranges for k in range(1, ranges)])).first()[0] or []})
    part = F.when(first.isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c < place)))
    local = rows.withColumn("part_", part).withColumn("n_", F.row_number().over(Window.partitionBy("part_").orderBy(*others)))
    counts = rows.withColumn("part_", part).groupBy("part_").agg(F.count("*").alias("c_"))
    base = counts.withColumn("base_", F.coalesce(F.sum("c_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c_")
    return local.join(F.broadcast(base), "part_").withColumn(name, F.col("base_") + F.col("n_")).drop("part_", "n_", "base_")

"""Telemetry analytics over traces, chunk rows, timesteps and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import TINY


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def nan_mean(x: Column) -> Column:
    """Mean of what is neither null nor NaN; null for none."""
    return F.avg(F.when(~F.isnan(x), x))


# -- regret, ranks ----------------------------------------------------------------------------


def regret(trace: DataFrame, key: str = "chunk_id", cost: str = "real_cost", floor: float = 1e-9) -> DataFrame:
    """Adds ``oracle_cost`` and ``regret`` = cost over the chunk's least, less 1."""
    least = F.min(cost).over(Window.partitionBy(key))
    return trace.withColumn("oracle_cost", least).withColumn("regret", F.col(cost) / F.greatest(F.col("oracle_cost"), F.lit(floor)) - 1)


def argmin_rows(trace: DataFrame, key: str = "chunk_id", cost: str = "real_cost", action: str = "action64") -> DataFrame:
    """The cheapest row of each chunk, first on ties, by a partial aggregate."""
    rest = [c for c in trace.columns if c not in (key, cost, action)]
    return trace.groupBy(key).agg(F.min(F.struct(cost, action, *rest)).alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in (cost, action, *rest)])


def chosen_rows(trace: DataFrame, key: str = "chunk_id", action: str = "action64") -> DataFrame:
    """The row with the least predicted cost of each chunk."""
    return argmin_rows(trace, key, "pred_cost", action)


def ranks(trace: DataFrame, keys: Sequence[str], action: str = "action64") -> DataFrame:
    """Adds ``pred_rank, real_rank`` (1 is best)."""
    w = Window.partitionBy(*keys)
    return trace.withColumns({"pred_rank": F.row_number().over(w.orderBy("pred_cost", action)), "real_rank": F.row_number().over(w.orderBy("real_cost", action))})


def kendall_tau(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n, tau`` by keys: concordant less discordant pairs over all; ranks have no ties.

    A group is one chunk's candidates (64 at most), so its pairs are made within an array of them.
    """
    group = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pred_rank", "real_rank"))).alias("r"))
    ordered = F.transform("r", lambda s: s["real_rank"])
    later = F.expr("aggregate(transform(o, (x, i) -> aggregate(slice(o, i + 2, size(o)), 0, (s, y) -> s + if(y > x, 1, -1))), 0, (s, v) -> s + v)")
    n = F.size("o")
    return group.select(*keys, ordered.alias("o")).select(*keys, n.alias("n"), F.when(n > 1, later / (n * (n - 1) / 2.0)).alias("tau"))


def tau_summary(taus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of valid taus."""
    return taus.where("tau is not null").groupBy(*keys).agg(F.avg("tau").alias("tau_mean"), F.stddev_pop("tau").alias("tau_std"), F.count("*").alias("n"))


def top_regret(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``top1_regret`` as a ratio (1 is the oracle) and top-1 and top-3 membership of the prediction."""
    return ranked.groupBy(*keys).agg(
        (F.max(F.when(F.col("pred_rank") == 1, F.col("real_cost"))) / F.min("real_cost")).alias("top1_regret"),
        F.max(((F.col("pred_rank") == 1) & (F.col("real_rank") == 1)).cast("int")).alias("top1"),
        F.max(((F.col("pred_rank") <= 3) & (F.col("real_rank") == 1)).cast("int")).alias("top3"),
    )


# -- prediction error -------------------------------------------------------------------------


def mape_mae_r2(rows: DataFrame, keys: Sequence[str], predicted: Column, real: Column, cap: float = 200.0, floor: float | None = None, mask: float = TINY) -> DataFrame:
    """``mape_pct`` (capped, of values clamped to ``floor``), ``mae`` and ``r2 = 1 - residual / total`` (of raw values).

    R2 is 0 for fewer than two rows or no spread; it is not the squared correlation.
    """
    clamp = (lambda c: F.greatest(c, F.lit(floor))) if floor is not None else (lambda c: c)
    p, r = clamp(predicted), clamp(real)
    pct = F.when(F.abs(r) > mask, F.least(F.abs(p - r) / F.abs(r) * 100, F.lit(cap)))
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(pct).alias("mape_pct"), F.avg(F.abs(predicted - real)).alias("mae"),
        F.sum((real - predicted) * (real - predicted)).alias("res"), F.sum(real * real).alias("sq"), F.sum(real).alias("sm"),
    )
    tot = F.col("sq") - F.col("sm") * F.col("sm") / F.col("n")
    return s.select(*keys, "n", "mape_pct", "mae", F.when((F.col("n") < 2) | (tot < 1e-12), F.lit(0.0)).otherwise(1 - F.col("res") / tot).alias("r2"))


def cost_error_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation in percent of fraction columns, each clipped to 0..10 first."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.least(F.greatest(F.col(m), F.lit(0.0)), F.lit(10.0)).alias("v")) for m in metrics])).alias("x"))
    return long.groupBy(F.col("x.metric").alias("metric")).agg((F.avg("x.v") * 100).alias("mean_pct"), (F.stddev_samp("x.v") * 100).alias("std_pct"))


# -- series -----------------------------------------------------------------------------------


def binned_mean(rows: DataFrame, x: str, value: str, size: int) -> DataFrame:
    """``x`` (middle of the bin), ``mean``, ``n`` by bins of ``size``."""
    b = F.floor(F.col(x) / size).cast("long")
    return rows.groupBy((b * size + size / 2).alias("x")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def moving_average(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Trailing mean over ``w = min(10, max(1, n // 6))`` rows, only where the frame is full."""
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(order)
    n = F.count("*").over(w)
    width = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(n / 6))).cast("int")
    numbered = rows.withColumns({"w_": width, "k_": F.row_number().over(ordered), "last_": F.collect_list(value).over(ordered.rowsBetween(-9, 0))})
    mean = F.expr("aggregate(slice(last_, greatest(size(last_) - w_ + 1, 1), w_), 0d, (s, x) -> s + x)") / F.col("w_")
    return numbered.where(F.col("k_") >= F.col("w_")).select(*keys, order, F.col("w_").alias("w"), mean.alias("smoothed"))


def final_fraction_mean(rows: DataFrame, keys: Sequence[str], order: str, value: str, fraction: float = 0.2) -> DataFrame:
    """Mean of the last ``max(1, round(fraction * n))`` rows, halves to even."""
    w = Window.partitionBy(*keys)
    last = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * fraction, 0)).cast("long")
    return rows.withColumns({"last_": last, "k_": F.row_number().over(w.orderBy(F.desc(order)))}).where(F.col("k_") <= F.col("last_")).groupBy(*keys).agg(F.avg(value).alias("final_mean"), F.count("*").alias("n"))


def last_rows(rows: DataFrame, keys: Sequence[str], order: str, n: int = 5) -> DataFrame:
    return rows.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("k_") <= n).drop("k_")


def drop_warm_up(rows: DataFrame, key: str = "phase", step: str = "timestep") -> DataFrame:
    """Rows after the first timestep, or all of a phase that has no others."""
    later = F.max((F.col(step) > 0).cast("int")).over(Window.partitionBy(key))
    return rows.withColumn("later_", later).where((F.col(step) > 0) | (F.col("later_") == 0)).drop("later_")


def milestones(rows: DataFrame, keys: Sequence[str], step: str = "timestep", percents: Sequence[int] = (0, 25, 50, 75, 100)) -> DataFrame:
    """Rows at shares of the distinct timesteps of each group."""
    w = Window.partitionBy(*keys)
    place = F.dense_rank().over(w.orderBy(step)) - 1
    n = F.size(F.collect_set(step).over(w))
    at = F.array_distinct(F.array(*[F.least(F.floor(F.col("steps_") * p / 100), F.col("steps_") - 1).cast("int") for p in percents]))
    return rows.withColumns({"place_": place, "steps_": n}).where(F.array_contains(at, F.col("place_"))).drop("place_", "steps_")


def quantile_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, 90 % quantile (linear) and mean, and how many are above 1."""
    return rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"), F.avg(value).alias("mean"), F.count_if(F.col(value) > 1).alias("blown"))


def p95_of_positive(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.percentile(value, 0.95).alias("p95"))


def upper_median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The element at ``n // 2`` of a group's sorted repeats (few by nature)."""
    s = F.array_sort(F.collect_list(value))
    return rows.groupBy(*keys).agg(s.alias("s")).select(*keys, F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("median"))


# -- shares -----------------------------------------------------------------------------------


def share_by_window(rows: DataFrame, order: str, label: str, size: int) -> DataFrame:
    """Share of each label in windows of ``size``; a window's shares add up to 1."""
    win = F.floor(F.col(order) / size).cast("long")
    n = rows.groupBy(win.alias("win"), label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("win")))


def frequency(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Count and percentage of each label by keys."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])))


# -- rollups ----------------------------------------------------------------------------------


def mode_of(label: str):
    """The most frequent value; the least of equally frequent ones."""
    return F.mode(label, True)


def rollup_chunks(rows: DataFrame, numbers: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Ranks brought together by (phase, timestep, chunk): most frequent action, means, sums of counters."""
    return rows.groupBy("phase", "timestep", "chunk").agg(mode_of("action").alias("action"), *[F.avg(c).alias(c) for c in numbers], *[F.sum(c).alias(c) for c in counters])


def rollup_timesteps(rows: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Means over ranks by (phase, timestep); ``n_chunks`` is the lowest rank's."""
    return rows.groupBy("phase", "timestep").agg(*[F.avg(c).alias(c) for c in numbers], F.min(F.struct("rank", "n_chunks"))["n_chunks"].alias("n_chunks"))


def multi_run(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of times over runs; rates from the mean times."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.avg("write_ms").alias("write_ms"), F.coalesce(F.stddev_samp("write_ms"), F.lit(0.0)).alias("write_ms_std"), F.avg("read_ms").alias("read_ms"), F.coalesce(F.stddev_samp("read_ms"), F.lit(0.0)).alias("read_ms_std"), F.max("orig_mib").alias("orig_mib"))
    rate = lambda ms: F.when(F.col(ms) > 0, F.col("orig_mib") * 1000 / F.col(ms)).otherwise(0.0)
    return s.withColumns({"write_mibps": rate("write_ms"), "read_mibps": rate("read_ms")})


def totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio and throughput of totals, not means of ratios."""
    s = rows.groupBy(*keys).agg(F.sum("orig_mib").alias("orig_mib"), F.sum("file_mib").alias("file_mib"), F.sum("write_ms").alias("write_ms"))
    return s.withColumns({"ratio": F.when(F.col("file_mib") > 0, F.col("orig_mib") / F.col("file_mib")), "write_mibps": F.when(F.col("write_ms") > 0, F.col("orig_mib") * 1000 / F.col("write_ms"))})


# fixed values: bounds of a ratio in models of storing time
RATIO_LOW, RATIO_HIGH = 1e-3, 100.0


def clipped_ratio(ratio: Column) -> Column:
    return F.greatest(F.lit(RATIO_LOW), F.least(F.lit(RATIO_HIGH), ratio))


def best_static(trace: DataFrame, label: str = "comp_lib", bandwidth: float = 300_000.0) -> DataFrame:
    """The one library with the least mean of compression and storing time, and its means.

    Storing takes ``chunk_bytes / ratio / bandwidth`` (bytes per ms), the ratio clipped; ties go to the first name.
    """
    ratio = clipped_ratio(F.col("real_ratio"))
    per = trace.groupBy(label).agg(
        F.avg(F.col("real_comp_ms") + F.col("chunk_bytes") / ratio / bandwidth).alias("mean_ms"), F.avg("real_comp_ms").alias("comp_ms"), F.avg(ratio).alias("ratio"), F.avg("chunk_bytes").alias("chunk_bytes")
    )
    return per.orderBy("mean_ms", label).limit(1)


def policy_best(rows: DataFrame) -> DataFrame:
    """Largest ratio and throughput by policy."""
    return rows.groupBy("policy").agg(F.max("ratio").alias("ratio"), F.max("write_mibps").alias("write_mibps"))


def split_policy(phase: Column) -> dict[str, Column]:
    """``nn-rl/balanced`` into its parts; no policy is the empty string."""
    return {"base_phase": F.split_part(phase, F.lit("/"), F.lit(1)), "policy": F.split_part(phase, F.lit("/"), F.lit(2))}


def prefer_phase(rows: DataFrame, wanted: str, order: str) -> DataFrame:
    """The row of the exact phase, else of one that begins with it, else the last row."""
    priority = F.when(F.col("phase") == wanted, 0).when(F.col("phase").startswith(wanted), 1).otherwise(2)
    return rows.orderBy(priority, F.desc(order)).limit(1)


def complete_groups(rows: DataFrame, keys: Sequence[str], least: int = 8) -> DataFrame:
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") >= least).drop("n_"), list(keys), "left_semi")


# -- models of what would be ------------------------------------------------------------------


# fixed values of the threshold model: storing bandwidth (bytes per ms), what learning and exploring cost (ms), the share
# of untouched chunks from which on the rate suffers, and by how much
SWEEP_BANDWIDTH, LEARN_MS, EXPLORE_MS, UNTOUCHED, PENALTY = 307.2, 3.0, 35.0, 0.60, 0.22


def threshold_sweep(trace: DataFrame, grid: Sequence[float], deltas: Sequence[float], bandwidth: float = SWEEP_BANDWIDTH, learn_ms: float = LEARN_MS, explore_ms: float = EXPLORE_MS) -> DataFrame:
    """``x1, delta``: mean regret, error and write rate (bytes per ms over 1024) if the thresholds were x1 and x1 + delta.

    A chunk's chosen configuration with an error below x1 stays as it is; from x1 on it learns (half of regret and
    error remain, ``learn_ms`` more); from x1 + delta on it explores (nothing remains, the oracle's configuration
    and ``explore_ms`` more). Untouched chunks beyond a share of 60 % cost 22 % of the rate for each unit above.
    ``bandwidth`` of 307,200 is that of 300 MB a second; the default is a thousandth of it, as published.
    """
    spark = trace.sparkSession
    pairs = spark.createDataFrame([(a, d, a + d) for a in grid for d in deltas], "x1 double, delta double, x2 double")
    chosen = chosen_rows(regret(trace)).select("chunk_id", "chunk_bytes", "regret", "mape_cost_frac", "real_comp_ms", "real_ratio")
    oracle = argmin_rows(trace).select("chunk_id", F.col("real_comp_ms").alias("oracle_ms"), F.col("real_ratio").alias("oracle_ratio"))
    rows = chosen.join(oracle, "chunk_id").crossJoin(F.broadcast(pairs))
    error = F.col("mape_cost_frac")
    mode = F.when(error < F.col("x1"), 0).when(error < F.col("x2"), 1).otherwise(2)
    rows = rows.withColumn("mode", mode)
    by_mode = lambda zero, one, two: F.when(F.col("mode") == 0, zero).when(F.col("mode") == 1, one).otherwise(two)
    left = by_mode(F.lit(1.0), F.lit(0.5), F.lit(0.0))
    comp = by_mode(F.col("real_comp_ms"), F.col("real_comp_ms") + learn_ms, F.col("oracle_ms") + explore_ms)
    ratio = clipped_ratio(by_mode(F.col("real_ratio"), F.col("real_ratio"), F.col("oracle_ratio")))
    out = rows.groupBy("x1", "delta").agg(
        F.avg(left * F.col("regret")).alias("regret"), F.avg(left * F.least(error, F.lit(100.0))).alias("error_frac"),
        F.avg(F.col("chunk_bytes") / (comp + F.col("chunk_bytes") / ratio / bandwidth)).alias("rate"), F.avg((F.col("mode") == 0).cast("int")).alias("frac0"),
    )
    return out.withColumn("rate", F.col("rate") / 1024 * (1 - F.greatest(F.col("frac0") - UNTOUCHED, F.lit(0.0)) * PENALTY))


# fixed values: modelled speed-ups, each on top of those before it; the lossy ones each on top of tiering and async
TIERING, ASYNC = 1.8, 1.5
LOSSY = (("lossy_low", 1.05), ("lossy_mid", 1.01), ("lossy_high", 1.08))


def whatif_io(rows: DataFrame) -> DataFrame:
    """Modelled, not measured: I/O time of ``workload, compute_ms, io_ms`` in each setting.

    I/O of less than half of both becomes as much as compute first; then tiering divides it, asynchronous
    writes divide that, and each lossy setting divides that again.
    """
    share = F.col("io_ms") / (F.col("compute_ms") + F.col("io_ms") + 1e-9)
    rows = rows.withColumn("plain", F.when(share < 0.5, F.col("compute_ms")).otherwise(F.col("io_ms")))
    rows = rows.withColumn("tiered", F.col("plain") / TIERING).withColumn("async", F.col("tiered") / ASYNC)
    settings = [("compressed", F.col("plain")), ("tiering", F.col("tiered")), ("async", F.col("async")), *[(n, F.col("async") / f) for n, f in LOSSY]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), io.alias("modelled_io_ms")) for n, io in settings]))
    return rows.select("workload", "compute_ms", each.alias("x")).select("workload", "x.setting", "x.modelled_io_ms", (F.col("compute_ms") + F.col("x.modelled_io_ms")).alias("modelled_total_ms"))


def pipeline_breakdown(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean stage times; what the first stage spends beside statistics and network, 0 at least."""
    s = rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("stats_ms", "nn_ms", "stage1_ms", "comp_ms", "io_ms")])
    return s.withColumn("residual_ms", F.greatest(F.lit(0.0), F.col("stage1_ms") - F.col("stats_ms") - F.col("nn_ms")))


def waterfall(rows: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """``stage, ordinal, ms, offset``: stages end to end."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("stage"), F.col(s).alias("ms")) for i, s in enumerate(stages)])).alias("x")).select(*keys, "x.*")
    w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("offset", F.coalesce(F.sum("ms").over(w), F.lit(0.0)))


def io_rates(rows: DataFrame) -> DataFrame:
    """``comp_gbps, decomp_gbps`` from sums of bytes and times."""
    return rows.agg((F.sum("chunk_bytes") / F.sum("real_comp_ms") / 1e6).alias("comp_gbps"), (F.sum("chunk_bytes") / F.sum("real_decomp_ms") / 1e6).alias("decomp_gbps"))


def pareto(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rows that no other row beats in both of two values to be large: a running maximum over a sort."""
    w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(F.desc(a), F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top_", F.max(b).over(w)).where(F.col("top_").isNull() | (F.col(b) > F.col("top_"))).drop("top_")


# -- reports ----------------------------------------------------------------------------------


def phase_average(rows: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Means by phase over fields, in the fixed order of phases; unknown phases last."""
    from ..functions.dimensions import phase

    s = rows.groupBy("phase").agg(*[F.avg(c).alias(c) for c in numbers])
    return s.join(F.broadcast(phase(rows.sparkSession)), "phase", "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(999)))


def align_phases(tables: dict[str, DataFrame], phases: Sequence[str], value: str) -> DataFrame:
    """``ordinal, phase`` and a column for each dataset; null where it has no such phase."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame(list(enumerate(phases)), "ordinal int, phase string")
    for name, t in tables.items():
        out = out.join(t.groupBy("phase").agg(F.avg(value).alias(name)), "phase", "left")
    return out


def epoch_series(rows: DataFrame, keys: Sequence[str], means: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Means and sums by epoch and ``keys``."""
    return rows.groupBy("epoch", *keys).agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def epoch_milestones(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of every ``n // 5``-th distinct epoch and of the last; the distinct epochs alone are ranked."""
    epochs = rows.select(*keys, "epoch").distinct()
    w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    ranked = epochs.withColumns({"place_": F.row_number().over(w.orderBy("epoch")) - 1, "epochs_": F.count("*").over(w)})
    wanted = ranked.where((F.col("place_") % F.greatest(F.lit(1), F.floor(F.col("epochs_") / 5)) == 0) | (F.col("place_") == F.col("epochs_") - 1))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in (*keys, "epoch")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.alias("r").join(wanted.select(*keys, "epoch").alias("w"), on, "left_semi")


def profiled_timesteps(step: Column, total: Column) -> Column:
    """Whether a timestep is profiled: all of a run below 10, else 0, 5, 10 and each tenth of the way to the last."""
    marks = F.transform(F.sequence(F.lit(10), F.lit(100), F.lit(10)), lambda pct: F.floor((total - 1) * pct / 100))
    return (total < 10) | step.isin(0, 5, 10) | F.array_contains(marks, step.cast("long"))


def flag_large_errors(rows: DataFrame, column: str, limit_pct: float = 50.0) -> DataFrame:
    return rows.withColumn("flagged", F.col(column) > limit_pct)


def series_by_step(chosen: DataFrame, step: Column, limit: float = 200.0) -> DataFrame:
    """``step``: mean regret, mean error in percent (clipped at ``limit``) and chunks, for each step."""
    error = F.least(F.col("mape_cost_frac") * 100, F.lit(limit))
    return chosen.groupBy(step.alias("step")).agg(F.avg("regret").alias("regret"), F.avg(error).alias("error_pct"), F.count("*").alias("chunks"))


def counter_totals(rows: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Counters added up over timesteps."""
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counters])


def size_series(trace: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rate-distortion and size series: bytes, mean ratio, quality and rate by ``by`` (bound, chunk size, ...)."""
    return trace.groupBy(*by).agg(
        F.sum("chunk_bytes").alias("bytes"), F.avg(clipped_ratio(F.col("real_ratio"))).alias("ratio"), F.avg("real_psnr").alias("psnr_db"), (F.sum("chunk_bytes") / F.sum("real_comp_ms")).alias("bytes_per_ms")
    )


def positive_regret_mean(rows: DataFrame, keys: Sequence[str], value: str = "regret") -> DataFrame:
    """Mean of finite positive values."""
    v = F.when((F.col(value) > 0) & (F.col(value) < float("inf")), F.col(value))
    return rows.groupBy(*keys).agg(F.avg(v).alias("mean_regret"))


def metric_regret(chosen: Column, best: Column) -> Column:
    """Absolute difference of a metric; 0 where it is not finite."""
    d = F.abs(chosen - best)
    return F.when(F.isnan(d) | (d == float("inf")) | d.isNull(), F.lit(0.0)).otherwise(d)


def observed(rows: DataFrame, name: str, **conditions: Column):
    """(rows, observation): counts of conditions gathered while the rows go by, such as cache hits."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


def enriched(rows: DataFrame, sources: Sequence[DataFrame], on: Sequence[str], value: str) -> DataFrame:
    """``value`` from the first source that has it, by left joins."""
    for k, s in enumerate(sources):
        rows = rows.join(s.select(*on, F.col(value).alias(f"source_{k}_")), list(on), "left")
    names = [f"source_{k}_" for k in range(len(sources))]
    return rows.withColumn(value, F.coalesce(*[F.col(n) for n in names])).drop(*names)

"""Registered queries of the engine and their SQL twins (DuckDB dialect, same column names).

Computed doubles are rounded to six digits on both sides: engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dimensions, scalar
from ..operators import chunking, codec, mlprep, predict, quality, select, stats, telemetry
from ..sources.telemetry import read_csv, write_csv
from ..streaming import learn
from . import arrays, derived
from .derived import CHUNK, chunks, read, trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits; negative zero to zero."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- SQL building blocks ----------------------------------------------------------------------

_CHUNKS = f"""chunks as (select event_id // {CHUNK} as chunk_id, event_id % {CHUNK} as pos, cast(value as float) as value from events)"""
_BYTES = _CHUNKS + """,
bits as (select chunk_id, cast(cast(value as bit) as varchar) as b from chunks),
bytes as (select chunk_id, unnest([substr(b, 1, 8), substr(b, 9, 8), substr(b, 17, 8), substr(b, 25, 8)]) as byte from bits),
hist as (select chunk_id, byte, count(*) as n from bytes group by all),
ent as (select chunk_id, -sum(n / t * log2(n / t)) + 0.0 as entropy from (select *, sum(n) over (partition by chunk_id) as t from hist) group by all)"""
_STATS = """,
base as (select chunk_id, count(*) as n, sum(value::double) as s, min(value)::double as lo, max(value)::double as hi from chunks group by all),
dev as (select chunk_id, avg(abs(value::double - m)) as mad from (select *, avg(value::double) over (partition by chunk_id) as m from chunks) group by all),
dd as (select chunk_id, case when count(*) > 2 then sum(abs(nx - 2 * value::double + pv)) / (count(*) - 2) else 0.0 end as deriv
  from (select *, lead(value::double) over w as nx, lag(value::double) over w as pv from chunks window w as (partition by chunk_id order by pos)) group by all)"""
_CONFIG64 = """cfg as (select a.a * 8 + s.s * 4 + b.b as action64, a.a as algo_idx, 4 * s.s as shuffle_bytes, [0.0, 0.1, 0.01, 0.001][b.b + 1]::double as error_bound,
  a.a + 8 * (b.b > 0)::int + 16 * s.s as nn_idx, (['lz4','snappy','deflate','gdeflate','zstd','ans','cascaded','bitcomp'])[a.a + 1] || case when s.s = 1 then '+shuf' else '' end as comp_lib
  from range(8) a(a), range(2) s(s), range(4) b(b))"""
_COST = "greatest({k}_comp_ms, 1.0) + greatest({k}_decomp_ms, 1.0) + chunk_bytes / (least({k}_ratio, 100.0) * 100.0)"
_TRACE = f"""with {_BYTES},
sizes as (select chunk_id, count(*) * 4 as chunk_bytes from chunks group by all),
{_CONFIG64},
p as (select c.chunk_id, chunk_bytes, round(entropy, 6) as entropy, cfg.*,
    1.5::double + algo_idx * 0.125::double + shuffle_bytes / 4 * 0.25::double + chunk_bytes / 4096.0::double as pred_comp_ms,
    1.25::double + algo_idx * 0.0625::double + shuffle_bytes / 4 * 0.125::double + chunk_bytes / 8192.0::double as pred_decomp_ms,
    (1 + algo_idx * 0.25::double + shuffle_bytes / 4 * 0.5::double) * (1 + (error_bound > 0)::int * 2.0::double) * 8.0::double / (1 + round(entropy, 6)) as pred_ratio,
    case when error_bound = 0 then 120.0::double else 40.0::double + action64 % 4 * 10.0::double end as pred_psnr,
    ((c.chunk_id * 31 + action64 * 17) % 41 - 20) / 40.0::double as drift
  from sizes c join ent using (chunk_id), cfg),
r as (select *, pred_comp_ms * (1 + drift) as real_comp_ms, pred_decomp_ms * (1 + drift) as real_decomp_ms, pred_ratio * (1 + drift) as real_ratio, pred_psnr * (1 + drift) as real_psnr from p),
k as (select *, {_COST.format(k="pred")} as pred_cost, {_COST.format(k="real")} as real_cost from r),
trace as (select *, case when real_cost > 1e-6 then abs(pred_cost - real_cost) / real_cost else 0.0 end as mape_cost_frac,
    case when real_ratio > 1e-6 then abs(pred_ratio - real_ratio) / real_ratio else 0.0 end as mape_ratio_frac from k)"""
_CHOSEN = _TRACE + """,
oracle as (select *, min(real_cost) over (partition by chunk_id) as oracle_cost from trace),
reg as (select *, real_cost / greatest(oracle_cost, 1e-9) - 1 as regret from oracle),
chosen as (select * from (select *, row_number() over (partition by chunk_id order by pred_cost, action64) as k from reg) where k = 1)"""
_RANKED = _TRACE + """,
ranked as (select *, row_number() over (partition by chunk_id order by pred_cost, action64) as pred_rank,
    row_number() over (partition by chunk_id order by real_cost, action64) as real_rank from trace)"""
_ROWS = """rows as (select case event_id % 3 when 0 then 'nn-rl/balanced' when 1 then 'nn-rl/ratio' else 'zstd' end as phase, (user_id % 4)::int as rank,
  ((event_id // 100) % 20)::int as timestep, ((event_id // 10) % 10)::int as chunk, ((event_id * 7) % 5)::int as action, 1 + (event_id % 17) / 8.0::double as ratio,
  1 + (event_id % 23) / 4.0::double as comp_ms, (event_id % 2)::int as sgd_fired, (10 + user_id % 4)::int as n_chunks, event_id from events)"""
_STEPS = _ROWS + """,
steps as (select phase, timestep, count(*) * 0.25::double as orig_mib, sum(0.25::double / ratio) as file_mib, sum(comp_ms) as comp_ms, sum(comp_ms * 0.5::double) as write_ms,
  count(*) * 0.125::double as stats_ms, count(*) * 0.0625::double as nn_ms, count(*) * 0.25::double - timestep % 3 * 2.0::double as stage1_ms, sum(comp_ms) * 0.75::double as io_ms from rows group by phase, timestep)"""


# -- chunks -----------------------------------------------------------------------------------


@query(f"with {_CHUNKS} select chunk_id, count(*) as n, round(sum(value::double), 6) as sum, min(value)::double as min, max(value)::double as max, round(max(value)::double - min(value)::double, 6) as range from chunks group by all")
def chunk_basic_stats(spark, d):
    return stats.basic(chunks(spark, d)).select("chunk_id", "n", F.round("sum", 6).alias("sum"), "min", "max", F.round("range", 6).alias("range"))


@query(f"with {_CHUNKS}{_STATS} select chunk_id, round(deriv, 6) as deriv from dd")
def chunk_second_difference(spark, d):
    return rounded(stats.second_difference(chunks(spark, d)).select("chunk_id", "deriv"))


@query(f"with {_CHUNKS}{_STATS} select chunk_id, round(mad, 6) as mad from dev")
def chunk_mean_abs_deviation(spark, d):
    return rounded(stats.mean_abs_deviation(chunks(spark, d)).select("chunk_id", "mad"))


@query(f"with {_BYTES} select chunk_id, (list_sum([substr(byte, i, 1)::int * (1 << (8 - i)) for i in range(1, 9)]))::int as byte, n as count from hist")
def chunk_byte_histogram(spark, d):
    return stats.byte_histogram(chunks(spark, d)).select("chunk_id", "byte", "count")


@query(f"with {_BYTES} select chunk_id, round(entropy, 6) as entropy from ent")
def chunk_byte_entropy(spark, d):
    return rounded(stats.byte_entropy(chunks(spark, d)).select("chunk_id", "entropy"))


@query("""with b as (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as byte from documents),
h as (select doc_id, byte, count(*) as n from b group by all)
select doc_id, round(-sum(n / t * log2(n / t)) + 0.0, 6) as entropy from (select *, sum(n) over (partition by doc_id) as t from h) group by all""")
def text_byte_entropy(spark, d):
    return rounded(stats.text_entropy(read(spark, d, "documents"), "doc_id", "text"))


_FEATURES = f"with {_BYTES}{_STATS}, f as (select chunk_id, n, s, lo, hi, mad, deriv, entropy from base join dev using (chunk_id) join dd using (chunk_id) join ent using (chunk_id))"
_ALGO = "case when entropy < 3.5 then 'zstd' when entropy < 5.5 then 'gdeflate' else 'lz4' end"


@query(_FEATURES + " select chunk_id, n, round(s, 6) as sum, round(lo, 6) as min, round(hi, 6) as max, round(hi - lo, 6) as range, round(mad, 6) as mad, round(deriv, 6) as deriv, round(entropy, 6) as entropy from f")
def chunk_features(spark, d):
    return rounded(stats.features(chunks(spark, d)).drop("field_id"))


@query(_FEATURES + f" select chunk_id, round(entropy, 6) as entropy, {_ALGO} as algorithm from f")
def heuristic_selection(spark, d):
    return rounded(select.heuristic(stats.features(chunks(spark, d)).select("chunk_id", "entropy")))


@query(_FEATURES + f" select {_ALGO} as algorithm, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from f group by 1")
def selection_frequency(spark, d):
    return rounded(telemetry.frequency(select.heuristic(stats.features(chunks(spark, d))), [], "algorithm"))


# -- configurations ---------------------------------------------------------------------------

_C32 = """c as (select x::int as action32, (x % 8)::int as algo_idx, (x // 8 % 2)::int as quant, (x // 16 % 2)::int as shuffle from range(32) t(x)),
n as (select *, (['lz4','snappy','deflate','gdeflate','zstd','ans','cascaded','bitcomp'])[algo_idx + 1] || case shuffle when 1 then '+shuf' else '' end || case quant when 1 then '+quant' else '' end as name from c)"""


@query(f"with {_C32} select action32, algo_idx, quant, shuffle, name, action32 as back from n")
def config32_decode(spark, d):
    a = F.col("action32")
    c = dimensions.config32(spark).select("action32", scalar.action_algo(a).alias("algo_idx"), scalar.action_quant(a).alias("quant"), scalar.action_shuffle(a).alias("shuffle"), scalar.action_name(a).alias("name"))
    return c.withColumn("back", scalar.action_index(F.upper("name")))


@query(f"with {_CONFIG64} select action64::int as action64, nn_idx::int as nn_idx, error_bound from cfg")
def config64_to_32(spark, d):
    return dimensions.config64(spark).select("action64", scalar.to_nn_index(F.col("action64"), F.col("error_bound")).alias("nn_idx"), "error_bound")


_CAND = f"""with {_BYTES}, {_C32},
cc as (select chunk_id, count(*) * 4 as n_bytes from chunks group by all),
x as (select chunk_id, action32, name, quant, n_bytes, 0.5::double + algo_idx * 0.125::double + shuffle * 0.25::double + n_bytes / 4096.0::double as ct,
  0.25::double + algo_idx * 0.0625::double + shuffle * 0.125::double + n_bytes / 4096.0::double / 2 as dt,
  (1 + algo_idx * 0.25::double + shuffle * 0.5::double) * (1 + quant * 2.0::double) * 8.0::double / (1 + round(entropy, 6)) as ratio,
  case quant when 1 then 40.0::double + 2.5::double * algo_idx else 120.0::double end as psnr
  from cc join ent using (chunk_id), n)"""


def _cost_sql(w0: str, w1: str, w2: str, bw: str = "100.0") -> str:
    return f"{w0} * greatest(ct, 1.0) + {w1} * greatest(dt, 1.0) + {w2} * (n_bytes / (least(ratio, 100.0) * {bw}))"


def _candidates(spark: SparkSession, d: str, error_bound: float = 0.0) -> DataFrame:
    s = stats.features(chunks(spark, d)).select("chunk_id", (F.col("n") * 4).alias("n_bytes"), "entropy")
    configs = select.mask_lossless(dimensions.config32(spark), error_bound)
    return select.formula_predictions(select.candidates(s, configs))


@query(_CAND + f" select chunk_id, action32, name, round({_cost_sql('1', '1', '1')}, 6) as cost from x where quant = 0")
def config_cross_join_cost(spark, d):
    return rounded(select.with_cost(_candidates(spark, d), bandwidth=100.0).select("chunk_id", "action32", "name", "cost"))


@query(_CAND + f""", k as (select *, {_cost_sql('1', '1', '1')} as cost from x),
r as (select *, row_number() over (partition by chunk_id order by cost, action32) as rank from k) select chunk_id, action32, rank::int as rank, round(cost, 6) as cost from r where rank between 2 and 4""")
def config_rank_topk(spark, d):
    rows = select.ranked(select.with_cost(_candidates(spark, d, 0.01), bandwidth=100.0), ["chunk_id"])
    return rounded(select.alternatives(rows, 3).select("chunk_id", "action32", "rank", "cost"))


@query(_CAND + f""", pol(policy, w0, w1, w2) as (values ('balanced', 1.0, 1.0, 1.0), ('ratio', 0.0, 0.0, 1.0), ('speed', 1.0, 0.0, 0.0), ('speed_both', 1.0, 1.0, 0.0)),
k as (select *, {_cost_sql('w0::double', 'w1::double', 'w2::double')} as cost from x, pol),
r as (select *, row_number() over (partition by chunk_id, policy order by cost, action32) as rank from k) select chunk_id, policy, action32, name, round(cost, 6) as cost from r where rank = 1""")
def config_best_per_policy(spark, d):
    rows = _candidates(spark, d, 0.01).crossJoin(F.broadcast(dimensions.policy(spark)))
    priced = select.with_cost(rows, F.col("w0"), F.col("w1"), F.col("w2"), bandwidth=100.0)
    return rounded(select.best(priced, ["chunk_id", "policy"], ["name"]))


@query(_CAND + f""", k as (select *, {_cost_sql('1', '1', '1')} as cost from x where psnr >= 50),
r as (select *, row_number() over (partition by chunk_id order by cost, action32) as rank from k) select chunk_id, action32, psnr, round(cost, 6) as cost from r where rank = 1""")
def psnr_floor_selection(spark, d):
    rows = select.with_cost(select.mask_psnr(_candidates(spark, d, 0.01), 50.0), bandwidth=100.0)
    return rounded(select.best(rows, ["chunk_id"], ["psnr"]))


@query(_FEATURES + " select chunk_id, case when hi - lo > 0 then round(least(10 * log10((hi - lo) * (hi - lo) / (0.01::double * 0.01::double / 3)), 120.0), 6) end as psnr from f")
def analytical_psnr(spark, d):
    s = stats.basic(chunks(spark, d))
    return rounded(s.select("chunk_id", scalar.analytical_psnr(F.col("range"), F.lit(0.01)).alias("psnr")))


# -- quantisation and quality -----------------------------------------------------------------

_QUANT = """with v as (select p_brand as brand, l_extendedprice::float::double as value from lineitem join part on l_partkey = p_partkey),
lim as (select brand, min(value) as low, max(value) as high from v group by all),
eb as (select *, high - low as span, 2.4e-7::double * greatest(abs(low), abs(high)) as rnd from lim),
eb2 as (select *, case when span <= 0 then 1.0 else greatest(case when {b} - rnd - 0.05::double * {b} > 0 then {b} - rnd - 0.05::double * {b} else greatest(span / 4e9::double, 0.1::double * rnd) end, span / 4e9::double) end as step_bound from eb),
eb3 as (select *, case when span / (2 * step_bound) * 1.1::double <= 127 then 8 when span / (2 * step_bound) * 1.1::double <= 32767 then 16 else 32 end as bits from eb2),
q as (select v.brand, value, low, high, step_bound, bits, greatest(-(case bits when 8 then 127 when 16 then 32767 else 2147483647 end)::bigint - 1,
  least((case bits when 8 then 127 when 16 then 32767 else 2147483647 end)::double, round((value - low) * (1 / (2 * step_bound)))))::bigint as code from v join eb3 using (brand)),
pairs as (select *, value as original, (code * (2 * step_bound) + low)::float::double as restored from q)"""


def _quantised(spark: SparkSession, d: str, bound: float) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    return quality.quantised_pairs(rows.select("brand", F.col("l_extendedprice").alias("value")), ["brand"], bound)


@query(_QUANT.format(b="0.5::double") + " select brand, bits, count(*) as n, sum(code)::bigint as code_sum, min(code) as code_min, max(code) as code_max from pairs group by all")
def linear_quantize(spark, d):
    return _quantised(spark, d, 0.5).groupBy("brand", "bits").agg(F.count("*").alias("n"), F.sum("code").alias("code_sum"), F.min("code").alias("code_min"), F.max("code").alias("code_max"))


@query(_QUANT.format(b="10.0::double") + " select brand, count(*) as n, round(max(abs(original - restored)), 6) as max_error, sum((abs(original - restored) > 10.0)::int)::bigint as violations from pairs group by all")
def dequantize_roundtrip(spark, d):
    p = _quantised(spark, d, 10.0)
    return rounded(p.groupBy("brand").agg(F.count("*").alias("n")).join(quality.mismatches(p, ["brand"], F.lit(10.0)).select("brand", "max_error", "violations"), "brand"))


@query(" union all ".join(f"select * from ({_QUANT.format(b=f'{b}::double')} select distinct {b}::double as bound, brand, round(step_bound, 6) as step_bound, bits from pairs)" for b in ("500.0", "10.0", "0.001")))
def quantize_precision_choice(spark, d):
    v = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(
        F.min(F.col("l_extendedprice").cast("float").cast("double")).alias("low"), F.max(F.col("l_extendedprice").cast("float").cast("double")).alias("high"))
    rows = v.withColumn("bound", F.explode(F.array(*[F.lit(b) for b in (500.0, 10.0, 0.001)])))
    rows = rows.withColumn("step_bound", scalar.effective_bound(F.col("bound"), F.col("low"), F.col("high")))
    return rounded(rows.withColumn("bits", scalar.precision_bits(F.col("low"), F.col("high"), F.col("step_bound"))).select("bound", "brand", "step_bound", "bits"))


_METRICS = """, s as (select brand, count(*) as n, sum((original - restored) * (original - restored)) as sq, sum(abs(original - restored)) as ab, max(abs(original - restored)) as max_error,
  avg(original) as mx, avg(restored) as my, avg(original * original) as xx, avg(restored * restored) as yy, avg(original * restored) as xy, max(original) - min(original) as span from pairs group by all)
select brand, n, round(sq / n, 6) as mse, round(sqrt(sq / n), 6) as rmse, round(ab / n, 6) as mae, round(max_error, 6) as max_error,
  round(case when sq = 0 then 120.0 when span > 0 then least(10 * log10(span * span / (sq / n)), 120.0) end, 6) as psnr,
  round(case when sq = 0 then 1.0 else (2 * mx * my + (0.01 * span) ** 2) * (2 * (xy - mx * my) + (0.03 * span) ** 2) / ((mx * mx + my * my + (0.01 * span) ** 2) * (xx - mx * mx + yy - my * my + (0.03 * span) ** 2)) end, 6) as ssim from s"""


@query(_QUANT.format(b="10.0::double") + _METRICS)
def quality_metrics(spark, d):
    return rounded(quality.metrics(_quantised(spark, d, 10.0), ["brand"]))


@query(_QUANT.format(b="0.5::double") + " select brand, sum((original <> restored)::int)::bigint as mismatches, sum((abs(original - restored) > 0.25)::int)::bigint as violations, round(max(abs(original - restored)), 6) as max_error from pairs group by all")
def mismatch_and_violations(spark, d):
    return rounded(quality.mismatches(_quantised(spark, d, 0.5), ["brand"], F.lit(0.25)))


# -- trace ------------------------------------------------------------------------------------


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.chosen_rows(telemetry.regret(trace(spark, d)))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.ranks(trace(spark, d), ["chunk_id"])


@query(_CHOSEN + " select chunk_id, action64::int as action64, comp_lib, round(oracle_cost, 6) as oracle_cost, round(regret, 6) as regret from chosen")
def trace_regret(spark, d):
    return rounded(_chosen(spark, d).select("chunk_id", "action64", "comp_lib", "oracle_cost", "regret"))


@query(_CHOSEN + " select chunk_id, round(mape_cost_frac, 6) as mape_cost_frac, round(mape_cost_frac * 100, 6) as mape_cost_pct from chosen")
def trace_cost_mape(spark, d):
    return rounded(_chosen(spark, d).select("chunk_id", "mape_cost_frac", (F.col("mape_cost_frac") * 100).alias("mape_cost_pct")))


@query(_CHOSEN + " select (case when mape_cost_frac > 0.5 then 2 when mape_cost_frac > 0.3 then 1 else 0 end)::int as explore_mode, count(*) as n from chosen group by 1")
def explore_mode_counts(spark, d):
    return _chosen(spark, d).groupBy(scalar.explore_mode(F.col("mape_cost_frac")).alias("explore_mode")).agg(F.count("*").alias("n"))


@query(_TRACE + """ select comp_lib, count(*) as n, round(avg(least(abs(greatest(pred_ratio, 1) - greatest(real_ratio, 1)) / greatest(real_ratio, 1) * 100, 200.0)), 6) as mape_pct,
  round(avg(abs(pred_ratio - real_ratio)), 6) as mae, round(1 - sum((real_ratio - pred_ratio) ** 2) / (sum(real_ratio * real_ratio) - sum(real_ratio) * sum(real_ratio) / count(*)), 6) as r2 from trace group by all""")
def mape_mae_r2(spark, d):
    return rounded(telemetry.mape_mae_r2(trace(spark, d), ["comp_lib"], F.col("pred_ratio"), F.col("real_ratio"), floor=1.0))


_TAU = _RANKED + """, tau as (select a.chunk_id, 64 as n, sum(case when b.real_rank > a.real_rank then 1 else -1 end) / (64 * 63 / 2.0::double) as tau
  from ranked a join ranked b on a.chunk_id = b.chunk_id and a.pred_rank < b.pred_rank group by a.chunk_id)"""


@query(_TAU + " select chunk_id, n::int as n, round(tau, 6) as tau from tau")
def kendall_tau(spark, d):
    return rounded(telemetry.kendall_tau(_ranked(spark, d), ["chunk_id"]))


@query(_TAU + " select chunk_id % 4 as grp, round(avg(tau), 6) as tau_mean, round(stddev_pop(tau), 6) as tau_std, count(*) as n from tau group by 1")
def tau_by_group(spark, d):
    taus = telemetry.kendall_tau(_ranked(spark, d), ["chunk_id"]).withColumn("grp", F.pmod("chunk_id", F.lit(4)))
    return rounded(telemetry.tau_summary(taus, ["grp"]))


@query(_RANKED + """ select chunk_id, round(max(real_cost) filter (pred_rank = 1) / min(real_cost), 6) as top1_regret, max((pred_rank = 1 and real_rank = 1)::int) as top1,
  max((pred_rank <= 3 and real_rank = 1)::int) as top3 from ranked group by all""")
def top1_top3_accuracy(spark, d):
    return rounded(telemetry.top_regret(_ranked(spark, d), ["chunk_id"]))


@query(_CHOSEN + " select chunk_id // 4 * 4 + 2.0::double as x, round(avg(mape_cost_frac), 6) as mean, count(*) as n from chosen group by 1")
def binned_convergence(spark, d):
    return rounded(telemetry.binned_mean(_chosen(spark, d), "chunk_id", "mape_cost_frac", 4))


@query(_TRACE + """, w as (select *, count(*) over (partition by action64) as n, row_number() over (partition by action64 order by chunk_id) as kk from trace),
v as (select *, least(10, greatest(1, n // 6)) as w from w)
select a.action64::int as action64, a.chunk_id, a.w::int as w, round(avg(b.mape_cost_frac), 6) as smoothed from v a join v b on a.action64 = b.action64 and b.kk between a.kk - a.w + 1 and a.kk where a.kk >= a.w group by all""")
def moving_average_convergence(spark, d):
    return rounded(telemetry.moving_average(trace(spark, d), ["action64"], "chunk_id", "mape_cost_frac"))


@query(_TRACE + """, best as (select chunk_id // 8 as win, comp_lib from (select *, row_number() over (partition by chunk_id order by real_cost, action64) as k from trace) where k = 1)
select win, comp_lib, count(*) as n, round(count(*) / sum(count(*)) over (partition by win), 6) as share from best group by win, comp_lib""")
def config_share_by_window(spark, d):
    return rounded(telemetry.share_by_window(telemetry.argmin_rows(trace(spark, d)), "chunk_id", "comp_lib", 8))


@query(_TRACE + """, m as (select comp_lib, avg(real_comp_ms + chunk_bytes / greatest(0.001::double, least(100.0::double, real_ratio)) / 300000.0::double) as mean_ms,
  avg(real_comp_ms) as comp_ms, avg(greatest(0.001::double, least(100.0::double, real_ratio))) as ratio, avg(chunk_bytes) as chunk_bytes from trace group by comp_lib)
select comp_lib, round(mean_ms, 6) as mean_ms, round(comp_ms, 6) as comp_ms, round(ratio, 6) as ratio, round(chunk_bytes, 6) as chunk_bytes from m order by m.mean_ms, comp_lib limit 1""")
def best_static_config(spark, d):
    return rounded(telemetry.best_static(trace(spark, d)))


_GRID, _DELTAS = (0.05, 0.1, 0.2, 0.3, 0.5), (0.05, 0.2, 0.5)


@query(_CHOSEN + f""", opt as (select chunk_id, real_comp_ms as o_ms, real_ratio as o_ratio from (select *, row_number() over (partition by chunk_id order by real_cost, action64) as kk from trace) where kk = 1),
g(x) as (values {', '.join(f'({x}::double)' for x in _GRID)}), dl(d) as (values {', '.join(f'({x}::double)' for x in _DELTAS)}),
z as (select *, case when mape_cost_frac < x then 0 when mape_cost_frac < x + d then 1 else 2 end as md from chosen join opt using (chunk_id), g, dl),
y as (select x as x1, d as delta, avg(case md when 0 then regret when 1 then regret * 0.5::double else 0.0::double end) as regret, avg(case md when 0 then least(mape_cost_frac, 100.0) when 1 then least(mape_cost_frac, 100.0) * 0.5::double else 0.0::double end) as error_frac,
  avg(chunk_bytes / (case md when 0 then real_comp_ms when 1 then real_comp_ms + 3 else o_ms + 35 end + chunk_bytes / greatest(0.001::double, least(100.0::double, case md when 2 then o_ratio else real_ratio end)) / 307.2::double)) / 1024 as rate, avg((md = 0)::int) as frac0 from z group by all)
select x1, delta, round(regret, 6) as regret, round(error_frac, 6) as error_frac, round(rate * (1 - greatest(frac0 - 0.6::double, 0.0) * 0.22::double), 6) as rate, round(frac0, 6) as frac0 from y""")
def threshold_sweep(spark, d):
    return rounded(telemetry.threshold_sweep(trace(spark, d), _GRID, _DELTAS))


@query(_TRACE + """, fin as (select *, count(*) over (partition by comp_lib, error_bound) as n, row_number() over (partition by comp_lib, error_bound order by chunk_id desc) as kk from trace)
select comp_lib, error_bound, round(avg(mape_cost_frac), 6) as final_mean, count(*) as n from fin where kk <= greatest(1, round_even(n * 0.2, 0)) group by all""")
def final_fraction_mean(spark, d):
    return rounded(telemetry.final_fraction_mean(trace(spark, d), ["comp_lib", "error_bound"], "chunk_id", "mape_cost_frac"))


@query(_CHOSEN + " select round(quantile_cont(regret, 0.5), 6) as median, round(quantile_cont(regret, 0.9), 6) as p90, round(avg(regret), 6) as mean, sum((regret > 1)::int)::bigint as blown from chosen")
def regret_quantiles(spark, d):
    return rounded(telemetry.quantile_summary(_chosen(spark, d), [], "regret"))


@query(_CHOSEN + """, l as (select 'mape_cost_frac' as metric, least(greatest(mape_cost_frac, 0.0), 10.0) as v from chosen union all select 'mape_ratio_frac', least(greatest(mape_ratio_frac, 0.0), 10.0) from chosen)
select metric, round(avg(v) * 100, 6) as mean_pct, round(stddev_samp(v) * 100, 6) as std_pct from l group by all""")
def clipped_error_summary(spark, d):
    return rounded(telemetry.cost_error_summary(_chosen(spark, d), ["mape_cost_frac", "mape_ratio_frac"]))


@query(_TRACE + " select round(sum(chunk_bytes) / sum(real_comp_ms) / 1e6, 9) as comp_gbps, round(sum(chunk_bytes) / sum(real_decomp_ms) / 1e6, 9) as decomp_gbps from trace")
def codec_rates(spark, d):
    r = telemetry.io_rates(trace(spark, d))
    return r.select(F.round("comp_gbps", 9).alias("comp_gbps"), F.round("decomp_gbps", 9).alias("decomp_gbps"))


# -- rollups ----------------------------------------------------------------------------------


@query(f"""with {_ROWS}, c as (select phase, timestep, chunk, action, count(*) as k from rows group by all),
m as (select phase, timestep, chunk, action from (select *, row_number() over (partition by phase, timestep, chunk order by k desc, action) as o from c) where o = 1)
select r.phase, r.timestep, r.chunk, any_value(m.action) as action, round(avg(ratio), 6) as ratio, round(avg(comp_ms), 6) as comp_ms, sum(sgd_fired)::bigint as sgd_fired from rows r join m using (phase, timestep, chunk) group by all""")
def rank_rollup_chunk(spark, d):
    return rounded(telemetry.rollup_chunks(derived.chunk_rows(spark, d), ["ratio", "comp_ms"], ["sgd_fired"]))


@query(f"with {_ROWS} select phase, timestep, round(avg(ratio), 6) as ratio, round(avg(comp_ms), 6) as comp_ms, arg_min(n_chunks, rank) as n_chunks from rows group by all")
def rank_rollup_timestep(spark, d):
    return rounded(telemetry.rollup_timesteps(derived.chunk_rows(spark, d), ["ratio", "comp_ms"]))


@query(f"with {_STEPS} select phase, round(sum(orig_mib), 6) as orig_mib, round(sum(file_mib), 6) as file_mib, round(sum(write_ms), 6) as write_ms, round(sum(orig_mib) / sum(file_mib), 6) as ratio, round(sum(orig_mib) * 1000 / sum(write_ms), 6) as write_mibps from steps group by all")
def total_throughput_ratio(spark, d):
    return rounded(telemetry.totals(derived.timesteps(spark, d), ["phase"]))


@query(f"""with {_STEPS}, s as (select phase, count(*) as n_runs, avg(write_ms) as write_ms, coalesce(stddev_samp(write_ms), 0.0) as write_ms_std, avg(io_ms) as read_ms, coalesce(stddev_samp(io_ms), 0.0) as read_ms_std, max(orig_mib) as orig_mib from steps group by all)
select phase, n_runs, round(write_ms, 6) as write_ms, round(write_ms_std, 6) as write_ms_std, round(read_ms, 6) as read_ms, round(read_ms_std, 6) as read_ms_std, orig_mib, round(orig_mib * 1000 / write_ms, 6) as write_mibps, round(orig_mib * 1000 / read_ms, 6) as read_mibps from s""")
def multi_run_mean_std(spark, d):
    return rounded(telemetry.multi_run(derived.timesteps(spark, d).withColumnRenamed("io_ms", "read_ms"), ["phase"]))


@query(f"""with {_STEPS}, w as (select phase as workload, sum(comp_ms) as c, sum(io_ms) as io from steps group by all),
p as (select workload, c, case when io / (c + io + 1e-9::double) < 0.5::double then c else io end as plain from w),
m as (select workload, c, 'compressed' as setting, plain as x from p union all select workload, c, 'tiering', plain / 1.8::double from p
  union all select workload, c, 'async', plain / 1.8::double / 1.5::double from p
  union all select workload, c, s, plain / 1.8::double / 1.5::double / f::double from p, (values ('lossy_low', 1.05), ('lossy_mid', 1.01), ('lossy_high', 1.08)) l(s, f))
select workload, setting, round(x, 6) as modelled_io_ms, round(c + x, 6) as modelled_total_ms from m""")
def whatif_io_model(spark, d):
    w = derived.timesteps(spark, d).groupBy(F.col("phase").alias("workload")).agg(F.sum("comp_ms").alias("compute_ms"), F.sum("io_ms").alias("io_ms"))
    return rounded(telemetry.whatif_io(w))


@query(f"""with {_STEPS}, a as (select phase, avg(stats_ms) as stats_ms, avg(nn_ms) as nn_ms, avg(stage1_ms) as stage1_ms, avg(comp_ms) as comp_ms, avg(io_ms) as io_ms from steps group by all)
select phase, round(stats_ms, 6) as stats_ms, round(nn_ms, 6) as nn_ms, round(stage1_ms, 6) as stage1_ms, round(comp_ms, 6) as comp_ms, round(io_ms, 6) as io_ms, round(greatest(0.0, stage1_ms - stats_ms - nn_ms), 6) as residual_ms from a""")
def pipeline_residual(spark, d):
    return rounded(telemetry.pipeline_breakdown(derived.timesteps(spark, d), ["phase"]))


@query(f"""with {_STEPS}, a as (select phase, avg(stats_ms) as stats_ms, avg(nn_ms) as nn_ms, avg(comp_ms) as comp_ms, avg(io_ms) as io_ms from steps group by all)
select phase, 0 as ordinal, 'stats_ms' as stage, round(stats_ms, 6) as ms, 0.0::double as offset from a union all select phase, 1, 'nn_ms', round(nn_ms, 6), round(stats_ms, 6) from a
union all select phase, 2, 'comp_ms', round(comp_ms, 6), round(stats_ms + nn_ms, 6) from a union all select phase, 3, 'io_ms', round(io_ms, 6), round(stats_ms + nn_ms + comp_ms, 6) from a""")
def stage_waterfall(spark, d):
    return rounded(telemetry.waterfall(telemetry.pipeline_breakdown(derived.timesteps(spark, d), ["phase"]), ["phase"], ["stats_ms", "nn_ms", "comp_ms", "io_ms"]))


@query(f"with {_STEPS}, b as (select phase, dense_rank() over (partition by phase order by timestep) - 1 as place, count(*) over (partition by phase) as n, timestep, comp_ms from steps) select phase, timestep, round(comp_ms, 6) as comp_ms from b where place in (0, least(floor(n * 25 / 100), n - 1), least(floor(n * 50 / 100), n - 1), least(floor(n * 75 / 100), n - 1), n - 1)")
def milestone_timesteps(spark, d):
    return rounded(telemetry.milestones(derived.timesteps(spark, d), ["phase"]).select("phase", "timestep", "comp_ms"))


@query(f"with {_STEPS} select split_part(phase, '/', 1) as base_phase, split_part(phase, '/', 2) as policy, count(*) as n, round(avg(comp_ms), 6) as comp_ms from steps where timestep > 0 group by 1, 2")
def warm_policy_average(spark, d):
    warm = telemetry.drop_warm_up(derived.timesteps(spark, d)).withColumns(telemetry.split_policy(F.col("phase")))
    return rounded(warm.groupBy("base_phase", "policy").agg(F.count("*").alias("n"), F.avg("comp_ms").alias("comp_ms")))


@query(f"""with {_STEPS}, r as (select phase, timestep, orig_mib / file_mib as ratio, orig_mib * 1000 / write_ms as mibps from steps)
select phase, timestep, round(ratio, 6) as ratio, round(mibps, 6) as mibps from r a where not exists (select 1 from r b where b.phase = a.phase and b.ratio >= a.ratio and b.mibps >= a.mibps and (b.ratio > a.ratio or b.mibps > a.mibps))""")
def pareto_front(spark, d):
    r = derived.timesteps(spark, d).select("phase", "timestep", (F.col("orig_mib") / F.col("file_mib")).alias("ratio"), (F.col("orig_mib") * 1000 / F.col("write_ms")).alias("mibps"))
    return rounded(telemetry.pareto(r, ["phase"], "ratio", "mibps"))


_PHASES = dimensions.PHASES


@query(f"""with {_STEPS}, p(ordinal, phase) as (values {', '.join(f"({i}, '{p}')" for i, p in enumerate(_PHASES))})
select s.phase, coalesce(any_value(ordinal), 999)::int as ordinal, round(avg(comp_ms), 6) as comp_ms, round(avg(io_ms), 6) as io_ms from steps s left join p using (phase) group by s.phase""")
def phase_average(spark, d):
    return rounded(telemetry.phase_average(derived.timesteps(spark, d), ["comp_ms", "io_ms"]))


@query(f"""with {_STEPS}, p(ordinal, phase) as (values (0, 'zstd'), (1, 'nn-rl/balanced'), (2, 'nothing'))
select ordinal, p.phase, round((select avg(comp_ms) from steps s where s.phase = p.phase), 6) as first_set, round((select avg(comp_ms) from steps s where s.phase = p.phase and timestep > 9), 6) as second_set from p""")
def phase_alignment(spark, d):
    t = derived.timesteps(spark, d)
    return rounded(telemetry.align_phases({"first_set": t, "second_set": t.where("timestep > 9")}, ["zstd", "nn-rl/balanced", "nothing"], "comp_ms"))


@query(f"with {_STEPS} select phase, timestep, timestep in (0, 5, 10, 1, 3, 7, 9, 11, 13, 15, 17, 19) as profiled, comp_ms / orig_mib > 10 as flagged from steps")
def profiled_timesteps(spark, d):
    t = derived.timesteps(spark, d).withColumn("rate", F.col("comp_ms") / F.col("orig_mib"))
    return telemetry.flag_large_errors(t, "rate", 10.0).select("phase", "timestep", telemetry.profiled_timesteps(F.col("timestep"), F.lit(20)).alias("profiled"), "flagged")


@query(_CHOSEN + " select comp_lib, round(avg(regret) filter (regret > 0), 6) as mean_regret from chosen group by all")
def positive_regret(spark, d):
    return rounded(telemetry.positive_regret_mean(_chosen(spark, d), ["comp_lib"]))


@query(_TRACE + " select comp_lib, round(quantile_cont(pred_cost, 0.95), 6) as p95 from trace where pred_cost > 0 group by all")
def p95_cost(spark, d):
    return rounded(telemetry.p95_of_positive(trace(spark, d), ["comp_lib"], "pred_cost"))


@query(f"with {_STEPS}, r as (select split_part(phase, '/', 2) as policy, orig_mib / file_mib as ratio, orig_mib * 1000 / write_ms as write_mibps from steps where phase like 'nn%') select policy, round(max(ratio), 6) as ratio, round(max(write_mibps), 6) as write_mibps from r group by all")
def policy_comparison(spark, d):
    t = derived.timesteps(spark, d).where(F.col("phase").startswith("nn")).withColumns({"policy": telemetry.split_policy(F.col("phase"))["policy"], "ratio": F.col("orig_mib") / F.col("file_mib"), "write_mibps": F.col("orig_mib") * 1000 / F.col("write_ms")})
    return rounded(telemetry.policy_best(t))


# -- model preparation ------------------------------------------------------------------------


@query(_TRACE + """, e as (select chunk_id, action64, case when (chunk_id + action64) % 5 = 0 then 0.0 else real_ratio end as ratio from trace),
m as (select chunk_id, median(ratio) filter (ratio > 0) as med from e group by all)
select e.chunk_id, action64::int as action64, dense_rank() over (order by e.chunk_id)::int as group_id, round(case when ratio > 0 then ratio else med end, 6) as ratio from e join m using (chunk_id)""")
def experience_impute(spark, d):
    t = trace(spark, d).select("chunk_id", "action64", F.when(F.pmod(F.col("chunk_id") + F.col("action64"), F.lit(5)) == 0, 0.0).otherwise(F.col("real_ratio")).alias("ratio"))
    return rounded(mlprep.group_ids(mlprep.impute_zero(t, ["chunk_id"], "ratio"), ["chunk_id"]).select("chunk_id", "action64", "group_id", "ratio"))


_SPLIT = "(('0x' || substr(md5('42-' || chunk_id), 1, 8))::bigint % 100 < 80)"


@query(_TRACE + f""", tr as (select avg(entropy) as m, case when stddev_pop(entropy) < 1e-8 then 1.0 else stddev_pop(entropy) end as s from trace where {_SPLIT})
select chunk_id, action64::int as action64, round((entropy - m) / s, 6) as entropy_z from trace, tr""")
def standardise_train_only(spark, d):
    t = trace(spark, d).select("chunk_id", "action64", "entropy").withColumn("train", mlprep.hash_split("chunk_id"))
    return rounded(mlprep.standardise(t, ["entropy"], F.col("train")).select("chunk_id", "action64", F.col("entropy_z")))


@query(f"with {_CHUNKS}, c as (select distinct chunk_id from chunks) select chunk_id, {_SPLIT} as train, (('0x' || substr(md5('7-' || chunk_id), 1, 8))::bigint % 5)::int as fold from c")
def hash_group_split(spark, d):
    c = chunks(spark, d).select("chunk_id").distinct()
    return c.withColumns({"train": mlprep.hash_split("chunk_id"), "fold": mlprep.hash_fold("chunk_id")})


@query("""select 'a' as src, event_id as id, value as size_mib, null::double as extra from events where event_id % 2 = 0
union all select 'b', event_id, value * 1024 * 1024 / 1048576, value * 2 from events where event_id % 2 = 1""")
def union_alias_normalise(spark, d):
    from ..sources.telemetry import normalise

    e = read(spark, d, "events")
    a = e.where("event_id % 2 = 0").select(F.lit("a").alias("src"), F.col("event_id").alias("id"), F.col("value").alias("size_mib"))
    b = e.where("event_id % 2 = 1").select(F.lit("b").alias("src"), F.col("event_id").alias("id"), (F.col("value") * 1024 * 1024).alias("size_bytes"), (F.col("value") * 2).alias("extra"))
    return normalise([a, b], {"size_mib": ("size_mib", ("size_bytes", 1 / 1048576))}).select("src", "id", "size_mib", "extra")


# -- N-D arrays -------------------------------------------------------------------------------

_GRID_CHUNK = (48, 20)


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int]]:
    """All of ``embeddings`` as a field, and its dimensions: ids by the longest vector."""
    e = read(spark, d, "embeddings")
    top = e.agg(F.coalesce(F.max("vec_id") + 1, F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("columns")).first()
    dims = (max(1, top["rows"]), max(1, top["columns"]))
    return e.select("vec_id", F.posexplode("embedding").alias("j", "value")).select(F.lit("embeddings").alias("field_id"), (F.col("vec_id") * dims[1] + F.col("j")).alias("idx"), "value"), dims


_GATHER = """with dims as (select greatest(1, coalesce(max(len(embedding)), 1)) as w from embeddings),
g as (select vec_id as i, unnest(range(len(embedding))) as j, unnest(embedding) as value, w from embeddings, dims),
c as (select *, i // 48 * ((w + 19) // 20) + j // 20 as chunk_id, (i % 48) * least(20, w - j // 20 * 20) + j % 20 as pos, i * w + j as idx from g)"""


@query(_GATHER + " select chunk_id, pos, idx, value::double as value from c")
def nd_gather(spark, d):
    grid, dims = _grid(spark, d)
    return chunking.gather(grid, dims, _GRID_CHUNK).select("chunk_id", "pos", "idx", F.col("value").cast("double").alias("value"))


@query(_GATHER + " select idx, chunk_id, true as back from c")
def nd_scatter(spark, d):
    grid, dims = _grid(spark, d)
    g = chunking.gather(grid, dims, _GRID_CHUNK).withColumnRenamed("idx", "was")
    return chunking.scatter(g, dims, _GRID_CHUNK).select("idx", "chunk_id", (F.col("idx") == F.col("was")).alias("back"))


@query("""with dims as (select max(len(embedding)) as w, max(vec_id) + 1 as h from embeddings),
g as (select vec_id as i, unnest(range(len(embedding))) as j, unnest(embedding) as value, w, h from embeddings, dims),
s as (select (i + 1) % h as i, j, value from g union all select (i + h - 1) % h, j, value from g union all select i, (j + 1) % w, value from g union all select i, (j + w - 1) % w, value from g),
t as (select i, j, sum(value::double) as neighbours from s group by all)
select g.i * w + g.j as idx, round(value::double, 6) as value, round(neighbours, 6) as neighbours from g join t using (i, j)""")
def grid_neighbours(spark, d):
    """The sum of each element's four neighbours in ``embeddings`` taken as a periodic grid."""
    grid, dims = _grid(spark, d)
    return rounded(chunking.periodic_neighbours(grid.withColumn("value", F.col("value").cast("double")), dims).select("idx", "value", "neighbours"))


@query("""with v as (select label::varchar as field_id, vec_id as chunk_id, unnest(range(len(embedding))) as pos, unnest(embedding)::float as value from embeddings),
bits as (select chunk_id, cast(cast(value as bit) as varchar) as b from v),
bytes as (select chunk_id, unnest([substr(b, 1, 8), substr(b, 9, 8), substr(b, 17, 8), substr(b, 25, 8)]) as byte from bits),
hist as (select chunk_id, byte, count(*) as n from bytes group by all),
ent as (select chunk_id, -sum(n / t * log2(n / t)) + 0.0 as entropy from (select *, sum(n) over (partition by chunk_id) as t from hist) group by all),
base as (select field_id, chunk_id, count(*) as n, sum(value::double) as s, min(value)::double as lo, max(value)::double as hi from v group by all),
dev as (select chunk_id, avg(abs(value::double - m)) as mad from (select *, avg(value::double) over (partition by chunk_id) as m from v) group by all),
dd as (select chunk_id, case when count(*) > 2 then sum(abs(nx - 2 * value::double + pv)) / (count(*) - 2) else 0.0 end as deriv
  from (select *, lead(value::double) over w as nx, lag(value::double) over w as pv from v window w as (partition by chunk_id order by pos)) group by all)
select field_id, chunk_id, n, round(s, 6) as sum, round(lo, 6) as min, round(hi, 6) as max, round(hi - lo, 6) as range, round(mad, 6) as mad, round(deriv, 6) as deriv, round(entropy, 6) as entropy
from base join ent using (chunk_id) join dev using (chunk_id) join dd using (chunk_id)""")
def vector_features(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("field_id"), F.col("vec_id").alias("chunk_id"), F.posexplode("embedding").alias("pos", "value"))
    return rounded(stats.features(e))


# -- series, counters, preparation ------------------------------------------------------------


@query(f"with {_ROWS} select phase, sum(sgd_fired)::bigint as sgd_fired, sum(n_chunks)::bigint as n_chunks from rows group by all")
def counter_totals(spark, d):
    return telemetry.counter_totals(derived.chunk_rows(spark, d), ["phase"], ["sgd_fired", "n_chunks"])


@query(_CHOSEN + " select chunk_id // 4 as step, round(avg(regret), 6) as regret, round(avg(least(mape_cost_frac * 100, 200.0::double)), 6) as error_pct, count(*) as chunks from chosen group by all")
def regret_series(spark, d):
    return rounded(telemetry.series_by_step(_chosen(spark, d), chunking.whole(F.col("chunk_id"), 4)))


@query(_CHOSEN + """ select case when chunk_id % 2 = 0 then 'even' else 'odd' end as dataset, chunk_id // 8 as step, round(avg(least(mape_cost_frac * 100, 200.0::double)), 6) as error_pct from chosen group by all""")
def convergence_by_dataset(spark, d):
    """Error in percent, clipped at 200, over the steps of two datasets."""
    c = _chosen(spark, d).withColumn("dataset", F.when(F.col("chunk_id") % 2 == 0, "even").otherwise("odd"))
    out = c.groupBy("dataset", chunking.whole(F.col("chunk_id"), 8).alias("step")).agg(F.avg(F.least(F.col("mape_cost_frac") * 100, F.lit(200.0))).alias("error_pct"))
    return rounded(out)


@query(f"with {_ROWS} select timestep as epoch, phase, round(avg(ratio), 6) as ratio, round(avg(comp_ms), 6) as comp_ms, sum(sgd_fired)::bigint as sgd_fired from rows group by all")
def epoch_series(spark, d):
    return rounded(telemetry.epoch_series(derived.chunk_rows(spark, d).withColumnRenamed("timestep", "epoch"), ["phase"], ["ratio", "comp_ms"], ["sgd_fired"]))


@query(f"with {_ROWS} select timestep as epoch, rank as tensor, chunk, round(avg(ratio), 6) as ratio, round(avg(comp_ms), 6) as comp_ms, sum(sgd_fired)::bigint as sgd_fired from rows group by all")
def inline_group_metrics(spark, d):
    """Metrics by (epoch, tensor, chunk)."""
    rows = derived.chunk_rows(spark, d).withColumnsRenamed({"timestep": "epoch", "rank": "tensor"})
    return rounded(telemetry.epoch_series(rows, ["tensor", "chunk"], ["ratio", "comp_ms"], ["sgd_fired"]))


_SIZES = "sum(chunk_bytes)::bigint as bytes, round(avg(greatest(0.001::double, least(100.0::double, real_ratio))), 6) as ratio, round(avg(real_psnr), 6) as psnr_db, round(sum(chunk_bytes) / sum(real_comp_ms), 6) as bytes_per_ms"


@query(_TRACE + f" select error_bound, {_SIZES} from trace group by all")
def rate_distortion(spark, d):
    return rounded(telemetry.size_series(trace(spark, d), ["error_bound"]))


@query(_TRACE + f" select comp_lib, chunk_bytes, {_SIZES} from trace group by all")
def size_series(spark, d):
    return rounded(telemetry.size_series(trace(spark, d), ["comp_lib", "chunk_bytes"]))


@query(_CHOSEN + """, best as (select chunk_id, max(real_ratio) as best_ratio from trace group by all)
select comp_lib, round(avg(abs(real_ratio - best_ratio)), 6) as ratio_regret from chosen join best using (chunk_id) group by all""")
def metric_regret(spark, d):
    """Mean absolute distance of the chosen configuration's ratio from the chunk's best."""
    best = trace(spark, d).groupBy("chunk_id").agg(F.max("real_ratio").alias("best_ratio"))
    return rounded(_chosen(spark, d).join(best, "chunk_id").groupBy("comp_lib").agg(F.avg(telemetry.metric_regret(F.col("real_ratio"), F.col("best_ratio"))).alias("ratio_regret")))


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``lineitem`` in the form of generator rows."""
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.when(F.col("l_linenumber") % 2 == 0, "LZ4").otherwise("Zstd").alias("algorithm"), (F.col("l_linenumber") % 3 == 0).alias("quantized"),
        (F.col("l_linenumber") % 2 * 4).cast("int").alias("shuffle_bytes"), F.lit(0.01).alias("error_bound"), (q * 1024).cast("long").alias("original_bytes"), (q / 8).alias("entropy_bits"), (p / 1e5).alias("mad"),
        (p / 2e5).alias("second_derivative"), (q / 10).alias("comp_time_ms"), (q / 20).alias("decomp_time_ms"), (1 + q / 50).alias("compression_ratio"), F.lit(60.0).alias("psnr_db"), F.lit(1.0).alias("ssim"),
        F.lit(0.0).alias("rmse"), F.lit(0.0).alias("max_abs_error"), F.lit(0.0).alias("mean_abs_error"), (F.col("l_linenumber") != 5).alias("success"),
    )


_GENERATED = """gen as (select l_orderkey::varchar as file, case when l_linenumber % 2 = 0 then 'lz4' else 'zstd' end as algorithm, case when l_linenumber % 3 = 0 then 'linear' else 'none' end as quantization,
  (l_linenumber % 2 * 4)::int as shuffle, (l_quantity::double * 1024)::bigint as original_size, l_quantity::double / 8 as entropy, l_extendedprice::double / 1e5 as mad, l_extendedprice::double / 2e5 as deriv,
  l_quantity::double / 10 as compression_time_ms from lineitem where l_linenumber <> 5)"""


@query(f"with {_GENERATED} select algorithm, quantization, shuffle, count(*) as n, count(distinct file) as files, sum(original_size)::bigint as bytes, round(avg(compression_time_ms), 6) as ms from gen group by all")
def canonical_rows(spark, d):
    """Generator rows in the canonical schema, failed ones left out, counted by configuration."""
    c = mlprep.canonical(_generated(spark, d))
    return rounded(c.groupBy("algorithm", "quantization", "shuffle").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.sum("original_size").alias("bytes"), F.avg("compression_time_ms").alias("ms")))


@query(f"""with {_GENERATED} select case algorithm when 'lz4' then 0 else 4 end as algo_idx, (quantization = 'linear')::int as quant, (shuffle > 0)::int as shuffle_on, count(*) as n,
round(avg(ln(1 + original_size) * entropy), 6) as size_entropy, round(avg(ln(1 + original_size) * mad), 6) as size_mad, round(avg(ln(1 + original_size) * deriv), 6) as size_deriv from gen group by all""")
def encoded_features(spark, d):
    """Integer labels and size interactions, averaged by label."""
    c = mlprep.size_interactions(mlprep.label_encode(mlprep.canonical(_generated(spark, d))))
    return rounded(c.groupBy("algo_idx", "quant", "shuffle_on").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in ("size_entropy", "size_mad", "size_deriv")]))


def _shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster shares; one of this process only where none is set and the master is local."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (own or "file://" + tempfile.mkdtemp(prefix="sparkloom-")).rstrip("/")


@query("select l_orderkey, l_linenumber, round(l_quantity::double, 6) as quantity, l_returnflag from lineitem")
def csv_round_trip(spark, d):
    """``lineitem`` written as CSV and read again with typed columns."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), "l_returnflag")
    path = f"{_shared_dir(spark)}/sparkloom-csv-{uuid.uuid4().hex}"
    write_csv(rows, path)
    return rounded(read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes)))


@query(_CHOSEN + " select round(avg(case when isnan(regret) then null else regret end), 6) as mean_regret, (sum((regret > 0)::int))::bigint as positive from chosen")
def nan_skipping_mean(spark, d):
    return rounded(_chosen(spark, d).agg(telemetry.nan_mean(F.col("regret")).alias("mean_regret"), F.sum((F.col("regret") > 0).cast("long")).alias("positive")))


@query(f"with {_ROWS}, o as (select phase, comp_ms, row_number() over (partition by phase, timestep, chunk order by comp_ms) as k, count(*) over (partition by phase, timestep, chunk) as n, timestep, chunk from rows) select phase, timestep, chunk, comp_ms as median from o where k = n // 2 + 1")
def upper_medians(spark, d):
    return telemetry.upper_median(derived.chunk_rows(spark, d), ["phase", "timestep", "chunk"], "comp_ms")


# -- codecs, network, learning ----------------------------------------------------------------


def _coded(spark: SparkSession, d: str) -> DataFrame:
    arrays = codec.chunk_arrays(chunks(spark, d))
    configs = dimensions.config64(spark).select("action64", F.element_at(F.array(*[F.lit(n) for n in dimensions.ALGORITHMS[1:]]), F.col("algo_idx") + 1).alias("comp_algo"), (F.col("shuffle_bytes") / 4).cast("int").alias("shuffle"), "error_bound")
    return codec.encode(arrays.crossJoin(F.broadcast(configs)), ["field_id", "chunk_id", "action64"])


@query()
def codec_roundtrip(spark, d):
    """Every chunk through every configuration and back: largest error against the bound."""
    arrays = codec.chunk_arrays(chunks(spark, d)).select("chunk_id", F.col("values").alias("original"))
    back = codec.decode(_coded(spark, d), ["chunk_id", "action64", "error_bound"])
    worst = F.expr("array_max(zip_with(original, values, (a, b) -> abs(cast(a as double) - b)))")
    rows = back.join(arrays, "chunk_id").select("chunk_id", "action64", "error_bound", F.col("values").isNotNull().alias("measured"), worst.alias("max_error"))
    return rows.withColumn("within", F.when(F.col("measured"), F.col("max_error") <= F.col("error_bound")))


@query()
def codec_ratio_by_chunk(spark, d):
    return codec.compression_stats(_coded(spark, d), ["chunk_id", "action64"])


@query()
def byte_shuffle_roundtrip(spark, d):
    @F.pandas_udf("struct<same: boolean, planes: binary>")
    def both(x: pd.Series) -> pd.DataFrame:
        planes = [codec.shuffle(b) for b in x]
        return pd.DataFrame({"same": [codec.unshuffle(p) == b for p, b in zip(planes, x, strict=True)], "planes": planes})

    docs = read(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("raw"))
    return docs.select("doc_id", both("raw").alias("s")).select("doc_id", "s.same", F.crc32("s.planes").alias("planes_crc32"))


@query("""with x as (select a::int as algo_id, k::int as kind, p::int as precision_code, (k > 0)::int as enabled from range(1, 9) a(a), range(2) k(k), range(3) p(p))
select kind | (precision_code << 4) | (enabled << 8) | (algo_id << 9) as flags, kind, precision_code, enabled, algo_id from x""")
def header_pack_unpack(spark, d):
    x = spark.range(1, 9).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("k"))).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("p")))
    f = x.select(scalar.quant_flags(F.col("k"), F.col("p"), F.col("k") > 0, F.col("a")).alias("flags"))
    return f.select("flags", *[c.alias(n) for n, c in scalar.unpack_quant_flags(F.col("flags")).items()])


@query()
def array_write_read(spark, d):
    """A field written under the model's choice and read back: nothing is lost within the bound."""
    f, options = derived.field(spark, d), arrays.Options(error_bound=0.01, chunk=CHUNK)
    coded = arrays.write_field(f, options, predict.seeded_weights())
    return rounded(arrays.verify(f, arrays.read_field(coded, CHUNK), 0.01))


@query()
def exhaustive_selection(spark, d):
    table = arrays.chunk_table(derived.field(spark, d), CHUNK)
    return arrays.infer(table, arrays.Options(selector="exhaustive", error_bound=0.01), predict.seeded_weights())


@query()
def mlp_predict(spark, d):
    s = stats.features(chunks(spark, d)).select("chunk_id", (F.col("n") * 4).alias("n_bytes"), "entropy", "mad", "deriv")
    rows = select.candidates(s, dimensions.config32(spark)).withColumn("error_bound", F.lit(0.01))
    return rounded(predict.predict(rows, predict.seeded_weights()).select("chunk_id", "action32", *[f"pred_{n}" for n in predict.OUTPUT_NAMES]))


@query()
def online_learning_trace(spark, d):
    s = stats.features(chunks(spark, d)).select("field_id", "chunk_id", (F.col("n") * 4).alias("n_bytes"), "entropy", "mad", "deriv")
    return rounded(learn.learn(s.crossJoin(F.broadcast(learn.modes(spark))), predict.seeded_weights()))

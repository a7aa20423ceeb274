import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import dimensions, scalar
from sparkloom.operators import chunking, codec, predict, quality, select, stats, telemetry


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def chunk_of(spark, values, field="f"):
    rows = [(field, i, float(v)) for i, v in enumerate(values)]
    return chunking.chunk_1d(spark.createDataFrame(rows, "field_id string, idx long, value float"), max(len(values), 1))


def float_of_bytes(b):
    return np.frombuffer(bytes(b), "<f4").tolist()


# closed-form facts of byte entropy


def test_entropy_of_equal_bytes_is_zero():
    assert stats.entropy_bytes(b"\x00" * 4096) == 0


def test_entropy_of_two_equally_frequent_bytes_is_one():
    assert stats.entropy_bytes(b"\x00" * 512 + b"\xff" * 512) == 1


def test_entropy_of_all_bytes_is_eight():
    assert stats.entropy_bytes(bytes(range(256)) * 16) == 8
    assert 7.9 < stats.entropy_bytes(bytes(range(256)) * 16 + b"\x01\x02\x03") <= 8


def test_relational_entropy_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500).astype(np.float32)
    got = stats.byte_entropy(chunk_of(spark, x)).first()["entropy"]
    assert math.isclose(got, stats.entropy_bytes(x.tobytes()), abs_tol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 257])
def test_statistics_three_ways(spark, n):
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    c = chunk_of(spark, x)
    f = stats.features(c).first()
    assert math.isclose(f["mad"], stats.mean_abs_deviation(c).first()["mad"], abs_tol=1e-9)
    assert math.isclose(f["deriv"], stats.second_difference(c).first()["deriv"], abs_tol=1e-9)
    assert math.isclose(f["sum"], stats.basic(c).first()["sum"], abs_tol=1e-6)
    a = stats.array_features(codec.chunk_arrays(c)).drop("values").first()
    assert tuple(a) == tuple(f)


def test_second_difference_of_a_ramp_is_zero(spark):
    assert stats.second_difference(chunk_of(spark, range(100))).first()["deriv"] == 0


def test_nan_is_left_out_of_the_range(spark):
    b = stats.basic(chunk_of(spark, [1.0, float("nan"), 3.0])).first()
    assert (b["min"], b["max"], b["n"]) == (1, 3, 3)


# configurations


def test_action_spaces(spark):
    c = {r["action32"]: r for r in dimensions.config32(spark).collect()}
    assert sorted(c) == list(range(32)) and c[4]["name"] == "zstd" and c[28]["name"] == "zstd+shuf+quant"
    rows = dimensions.config64(spark).withColumn("back", scalar.to_nn_index(F.col("action64"), F.col("error_bound"))).collect()
    assert all(r["back"] == r["nn_idx"] for r in rows) and len({r["action64"] for r in rows}) == 64


def test_action_names(spark):
    names = [("ZSTD+Shuf", 20), ("lz4", 0), ("17", 17), ("32", -1), ("nope", -1), ("zstd+what", -1), (" zstd+quant+shuf ", 28), (None, None)]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [r[0] for r in df.select(F.when(F.col("n").isNotNull(), scalar.action_index(F.col("n")))).collect()] == [i for _, i in names]
    assert one(spark, scalar.action_name(F.lit(-1))) == "none"


def test_algorithm_ids(spark):
    assert one(spark, scalar.algorithm_id(F.lit("ZstD"))) == 5 and one(spark, scalar.algorithm_id(F.lit("?"))) == 1
    with pytest.raises(Exception, match="unknown algorithm"):
        one(spark, scalar.algorithm_id(F.lit("?"), unknown="raise"))


# scalar functions


@pytest.mark.parametrize("entropy, want", [(0.0, "zstd"), (3.5, "gdeflate"), (5.49, "gdeflate"), (5.5, "lz4"), (8.0, "lz4")])
def test_heuristic(spark, entropy, want):
    assert one(spark, scalar.heuristic_algorithm(F.lit(entropy))) == want


def test_rounding_is_away_from_zero(spark):
    got = spark.createDataFrame([(2.5,), (-2.5,), (0.49,)], "x double").select(scalar.quantize(F.col("x"), F.lit(0.0), F.lit(1.0), F.lit(8))).collect()
    assert [r[0] for r in got] == [3, -3, 0]


def test_cost_floor_cap_and_no_ratio(spark):
    c = lambda ct, dt, r, **k: one(spark, scalar.cost(F.lit(ct), F.lit(dt), F.lit(r), F.lit(1000), 1, 1, 1, **k))
    assert c(0.1, 0.1, 1.0, bandwidth=1000.0) == 3
    assert c(0.1, 0.1, 1.0, bandwidth=1000.0, time_floor_ms=5.0) == 11
    assert math.isclose(c(1.0, 1.0, 1e9, bandwidth=10.0), 3)
    assert c(1.0, 1.0, 0.0) == 1e30


def test_sizes_and_psnr(spark):
    assert one(spark, scalar.max_compressed_size(F.lit(800).cast("long"))) == 800 + 100 + 1088
    assert one(spark, scalar.max_compressed_size(F.lit(2**63 - 1).cast("long"))) == 0
    assert math.isclose(one(spark, scalar.analytical_psnr(F.lit(1.0), F.lit(0.1))), 10 * math.log10(300))
    assert one(spark, scalar.analytical_psnr(F.lit(0.0), F.lit(0.1))) is None
    assert one(spark, scalar.analytical_psnr(F.lit(1e9), F.lit(1e-9))) == 120


def test_explore_modes_and_errors(spark):
    assert [one(spark, scalar.explore_mode(F.lit(x))) for x in (0.3, 0.31, 0.51)] == [0, 1, 2]
    assert one(spark, scalar.fraction_error(F.lit(3.0), F.lit(2.0))) == 0.5 and one(spark, scalar.fraction_error(F.lit(3.0), F.lit(0.0))) == 0


def test_ssim_target_inverts(spark):
    assert math.isclose(one(spark, scalar.ssim_from_target(scalar.ssim_target(F.lit(0.75)))), 0.75, abs_tol=1e-6)


def test_log_grid():
    g = scalar.log_grid(0.05, 1.5, 5)
    assert math.isclose(g[0], 0.05) and math.isclose(g[-1], 1.5) and math.isclose(g[1] / g[0], g[4] / g[3])


# arrays


@pytest.mark.parametrize("dims, chunk", [((7,), (3,)), ((6, 5), (4, 2)), ((5, 4, 3), (2, 3, 2)), ((4, 4), (4, 4))])
def test_gather_and_scatter(spark, dims, chunk):
    n = int(np.prod(dims))
    f = spark.createDataFrame([("f", i, float(i)) for i in range(n)], "field_id string, idx long, value float")
    rows = chunking.gather(f, dims, chunk).collect()
    grid = np.arange(n).reshape(dims)
    counts = chunking.chunk_counts(dims, chunk)
    for c in range(int(np.prod(counts))):
        at = np.unravel_index(c, counts)
        want = grid[tuple(slice(a * s, a * s + s) for a, s in zip(at, chunk, strict=True))].ravel().tolist()
        assert [r["idx"] for r in sorted((r for r in rows if r["chunk_id"] == c), key=lambda r: r["pos"])] == want
    back = chunking.scatter(chunking.gather(f, dims, chunk).drop("idx"), dims, chunk).collect()
    assert all(r["idx"] == r["value"] for r in back)


def test_contiguity():
    assert chunking.is_contiguous((10, 4), (3, 4)) and not chunking.is_contiguous((10, 4), (3, 2))
    assert chunking.is_contiguous((10, 4), (1, 2)) and chunking.choose_2d(12) == (3, 4)


def test_concat_and_pad(spark):
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "tensor_id int, pos long, value float")
    assert [r["value"] for r in chunking.concat_and_pad(t, 5).orderBy("idx").collect()] == [1, 2, 3, 0, 0]
    with pytest.raises(Exception, match="longer"):
        chunking.concat_and_pad(t, 2).collect()


def test_periodic_neighbours(spark):
    dims = (3, 4)
    x = np.arange(12.0).reshape(dims)
    f = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x.ravel())], "idx long, value double")
    got = {r["idx"]: r["neighbours"] for r in chunking.periodic_neighbours(f, dims).collect()}
    want = sum(np.roll(x, s, a) for s in (1, -1) for a in (0, 1)).ravel()
    assert [got[i] for i in range(12)] == want.tolist()


def test_drop_tail(spark):
    f = spark.createDataFrame([("f", i, 0.0) for i in range(10)], "field_id string, idx long, value float")
    assert chunking.chunk_1d(f, 4, drop_tail=True, total=10).count() == 8


# codecs

finite32 = st.floats(width=32, allow_nan=False, allow_infinity=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(width=32), max_size=300), st.sampled_from(sorted(dimensions.HOST_CODECS)), st.booleans())
def test_lossless_round_trip(values, algorithm, shuffled):
    x = np.array(values, np.float32)
    assert codec.decode_chunk(codec.encode_chunk(x, algorithm, shuffled)).tobytes() == x.tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1000, 1000, width=32), min_size=1, max_size=300), st.sampled_from([0.1, 0.01, 1.0]))
def test_error_bound_is_kept(values, bound):
    x = np.array(values, np.float32)
    y = codec.decode_chunk(codec.encode_chunk(x, "zstd", True, bound))
    assert np.abs(x.astype(np.float64) - y).max() <= bound


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from([1, 2, 4, 8]), st.sampled_from([16, 100, 1 << 18]))
def test_shuffle_round_trip(raw, size, block):
    assert codec.unshuffle(codec.shuffle(raw, size, block), size, block) == raw


def test_codecs_without_host_code_are_null():
    assert [codec.encode_chunk(np.zeros(4, np.float32), a, False) for a in ("ans", "cascaded", "gdeflate", "bitcomp")] == [None] * 4


def test_nan_chunks_stay_lossless():
    x = np.array([1, np.nan, 3], np.float32)
    assert codec.decode_chunk(codec.encode_chunk(x, "lz4", True, 0.1)).tobytes() == x.tobytes()


def test_damage_and_passthrough():
    raw = codec.encode_chunk(np.arange(9, dtype=np.float32), "zstd", False)
    with pytest.raises(ValueError):
        codec.decode_chunk(raw[:-1])
    assert codec.original_size(raw) == 36 and codec.decode_chunk(np.float32([1, 2]).tobytes()).tolist() == [1, 2]


def test_column_round_trip(spark):
    rows = [("f", c, [float(x) for x in range(c)], a, 1, b) for c in (0, 1, 50) for a in ("zstd", "ans") for b in (0.0, 0.5)]
    df = spark.createDataFrame(rows, "field_id string, chunk_id long, values array<float>, comp_algo string, shuffle int, error_bound double")
    enc = codec.encode(df, ["field_id", "chunk_id"])
    for r in codec.decode(enc, ["chunk_id", "comp_algo", "error_bound"]).collect():
        if r["comp_algo"] == "ans":
            assert r["values"] is None
        else:
            assert all(abs(v - i) <= r["error_bound"] for i, v in enumerate(r["values"])) and len(r["values"]) == r["chunk_id"]
    assert all(codec_ok is None or codec_ok for (codec_ok,) in enc.select(codec.is_encoded(F.col("encoded"))).collect())


# quality


def test_quality_of_a_perfect_copy(spark):
    p = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "original double, restored double")
    m = quality.metrics(p).first()
    assert (m["psnr"], m["ssim"], m["max_error"], m["mse"]) == (120, 1, 0, 0)


def test_quality_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200) * 0.1
    m = quality.metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "original double, restored double")).first()
    mse = ((x - y) ** 2).mean()
    assert math.isclose(m["rmse"], mse**0.5) and math.isclose(m["psnr"], 10 * math.log10(np.ptp(x) ** 2 / mse)) and math.isclose(m["mae"], np.abs(x - y).mean())


def test_mismatch_counts_nan(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("a", float("nan"), float("nan")), ("a", 1.0, 1.5)], "k string, original double, restored double")
    r = quality.mismatches(p, ["k"], F.lit(0.4)).first()
    assert r["mismatches"] == 2


# selection


def test_weights_select_what_they_weigh(spark):
    rows = [(0, a, 1.0 + a, 10.0 - a, float(a + 1), 1000) for a in range(8)]
    df = spark.createDataFrame(rows, "chunk_id int, action32 int, ct double, dt double, ratio double, n_bytes long")
    pick = lambda *w: select.best(select.with_cost(df, *w), ["chunk_id"], []).first()["action32"]
    assert (pick(1, 0, 0), pick(0, 1, 0), pick(0, 0, 1)) == (0, 7, 7)


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(0, a, 1.0) for a in (16, 1, 3)], "chunk_id int, action32 int, cost double")
    assert select.best(df, ["chunk_id"], []).first()["action32"] == 1
    assert [r["action32"] for r in select.ranked(df, ["chunk_id"]).orderBy("rank").collect()] == [1, 3, 16]


def test_lossless_mask(spark):
    assert select.mask_lossless(dimensions.config32(spark), 0.0).count() == 16 and select.mask_lossless(dimensions.config32(spark), 0.1).count() == 32


# network


def test_weights_round_trip_and_checks():
    w = predict.seeded_weights()
    raw = predict.to_bytes(w)
    assert sum(a.size + b.size for a, b in w.layers) == 13_576
    assert predict.to_bytes(predict.from_bytes(raw)) == raw
    for bad in (raw[:-1], raw + b"x", b"XXXX" + raw[4:], raw[:10]):
        with pytest.raises(ValueError):
            predict.from_bytes(bad)


def test_forward_by_hand():
    w = predict.seeded_weights()
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = (x - w.x_mean) / w.x_std
    for a, b in w.layers[:-1]:
        h = np.array([[max(0.0, float(r @ n + c)) for n, c in zip(a, b, strict=True)] for r in h])
    a, b = w.layers[-1]
    y = h @ a.T + b
    assert np.allclose(predict.forward(w, x)[:, 3], np.clip(y[:, 3] * w.y_std[3] + w.y_mean[3], 0, 120))


# telemetry properties


def test_tau_properties(spark):
    rng = np.random.default_rng(4)
    orders = [list(range(1, 9)), list(range(8, 0, -1)), *[(rng.permutation(8) + 1).tolist() for _ in range(20)]]
    rows = [(c, i + 1, int(r)) for c, order in enumerate(orders) for i, r in enumerate(order)]
    df = spark.createDataFrame(rows, "chunk_id int, pred_rank int, real_rank int")
    got = {r["chunk_id"]: r["tau"] for r in telemetry.kendall_tau(df, ["chunk_id"]).collect()}
    for c, order in enumerate(orders):
        assert math.isclose(got[c], sum(1 if b > a else -1 for i, a in enumerate(order) for b in order[i + 1 :]) / 28)
    assert (got[0], got[1]) == (1, -1)


def test_r2_is_not_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 11.0), (2.0, 12.0), (3.0, 13.5)], "p double, r double")
    r = telemetry.mape_mae_r2(df, [], F.col("p"), F.col("r")).first()
    real = np.array([11, 12, 13.5])
    assert math.isclose(r["r2"], 1 - ((real - [1, 2, 3]) ** 2).sum() / ((real - real.mean()) ** 2).sum())
    one_row = telemetry.mape_mae_r2(df.limit(1), [], F.col("p"), F.col("r")).first()
    assert one_row["r2"] == 0


def test_upper_median_and_final_mean(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([4, 1, 3, 2])], "k string, t int, v double")
    assert telemetry.upper_median(df, ["k"], "v").first()["median"] == 3
    assert telemetry.final_fraction_mean(df, ["k"], "t", "v", 0.5).first()["final_mean"] == 2.5


def test_shares_add_up(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 7 else "c") for i in range(10)], "t int, lib string")
    s = telemetry.share_by_window(df, "t", "lib", 4).groupBy("win").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r["s"], 1) for r in s) and len(s) == 3


def test_warm_up_and_preference(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "phase string, timestep int")
    assert {tuple(r) for r in telemetry.drop_warm_up(df).collect()} == {("a", 1), ("b", 0)}
    assert telemetry.prefer_phase(df, "b", "timestep").first()["phase"] == "b" and telemetry.prefer_phase(df, "z", "timestep").first() is not None

"""Models and preparation against values worked out by hand, and rows with nulls."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import chunking, mlprep, ordering, stats, telemetry


def test_settings_stand_on_top_of_each_other(spark):
    df = spark.createDataFrame([("a", 100.0, 30.0), ("b", 10.0, 90.0)], "workload string, compute_ms double, io_ms double")
    got = {(r["workload"], r["setting"]): (r["modelled_io_ms"], r["modelled_total_ms"]) for r in telemetry.whatif_io(df).collect()}
    for w, compute, io in (("a", 100.0, 100.0), ("b", 10.0, 90.0)):  # a's I/O is below half of both, so it becomes as much as compute
        want = {"compressed": io, "tiering": io / 1.8, "async": io / 1.8 / 1.5, "lossy_low": io / 1.8 / 1.5 / 1.05, "lossy_mid": io / 1.8 / 1.5 / 1.01, "lossy_high": io / 1.8 / 1.5 / 1.08}
        for s, x in want.items():
            assert np.allclose(got[w, s], (x, compute + x))


def test_best_library_by_clipped_ratio(spark):
    rows = [("x", 1, 1.0, 3e6, 1e6), ("x", 2, 3.0, 3e6, 1e6), ("y", 1, 9.0, 3e6, 5.0)]
    df = spark.createDataFrame(rows, "comp_lib string, action64 int, real_comp_ms double, chunk_bytes double, real_ratio double")
    r = telemetry.best_static(df).first()
    assert r["comp_lib"] == "x" and math.isclose(r["mean_ms"], 2 + 3e6 / 100 / 300_000) and r["ratio"] == 100 and r["comp_ms"] == 2


def test_profiled_steps(spark):
    steps = lambda total: [r["id"] for r in spark.range(total).where(telemetry.profiled_timesteps(F.col("id"), F.lit(total))).collect()]
    assert steps(9) == list(range(9))
    assert steps(20) == sorted({0, 5, 10} | {19 * p // 100 for p in range(10, 101, 10)})
    assert steps(101) == sorted({0, 5} | set(range(10, 101, 10)))


def test_sweep_by_hand(spark):
    rows = [(1, 0, 1000.0, 0.5, 1.0, 2.0, 5.0, 10.0, 2.0), (1, 1, 1000.0, 0.5, 3.0, 4.0, 4.0, 8.0, 4.0)]
    df = spark.createDataFrame(rows, "chunk_id long, action64 int, chunk_bytes double, mape_cost_frac double, pred_cost double, x double, real_cost double, real_comp_ms double, real_ratio double")
    got = {(r["x1"], r["delta"]): r for r in telemetry.threshold_sweep(df, [0.2, 0.6], [0.1, 0.5]).collect()}
    assert math.isclose(got[0.6, 0.1]["regret"], 0.25) and math.isclose(got[0.6, 0.1]["error_frac"], 0.5)
    assert math.isclose(got[0.6, 0.1]["rate"], 1000 / (10 + 1000 / 2 / 307.2) / 1024 * (1 - 0.4 * 0.22))
    assert math.isclose(got[0.2, 0.5]["regret"], 0.125) and math.isclose(got[0.2, 0.5]["rate"], 1000 / (13 + 1000 / 2 / 307.2) / 1024)
    assert got[0.2, 0.1]["regret"] == 0 and math.isclose(got[0.2, 0.1]["rate"], 1000 / (43 + 1000 / 4 / 307.2) / 1024)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 0.0), ("a", 0.0), ("a", 4.0), ("b", None)], "k string, v double")
    got = sorted(((r["k"], r["v"]) for r in mlprep.impute_zero(df, ["k"], "v").collect()), key=str)
    assert got == sorted([(None, 1.0), (None, 1.0), ("a", 4.0), ("a", 4.0), ("b", None)], key=str)
    ids = {(r["k"], r["group_id"]) for r in mlprep.group_ids(df, ["k"]).collect()}
    assert ids == {(None, 1), ("a", 2), ("b", 3)}
    assert mlprep.shuffled_split(df, "k").where("train is null").count() == 0


def test_numbers_follow_the_order(spark):
    for values in (["b", "a", "", None, "aaaaaaaaz", "aaaaaaaab", "ä"], [2**62, 2**62 + 1, -5, None, 0]):
        kind = "string" if isinstance(values[0], str) else "long"
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
        got = [r["v"] for r in ordering.dense_number(df, ["v"], "n").orderBy("n").collect()]
        assert got == sorted(values, key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0))


def test_null_values_and_chunks_are_alike_in_both_forms(spark):
    rows = [("f", 0, i, v) for i, v in enumerate([1.0, None, 3.0, 2.0])] + [("f", None, i, float(i)) for i in range(3)] + [("f", 2, 0, None)] + [("f", 3, i, float("nan")) for i in range(2)]
    df = spark.createDataFrame(rows, "field_id string, chunk_id long, pos int, value float")
    key = lambda r: r["chunk_id"]
    whole = {key(r): r for r in stats.features(df).collect()}
    basic = {key(r): r for r in stats.basic(df).collect()}
    entropy = {key(r): r["entropy"] for r in stats.byte_entropy(df).collect()}
    mad = {key(r): r["mad"] for r in stats.mean_abs_deviation(df).collect()}
    deriv = {key(r): r["deriv"] for r in stats.second_difference(df).collect()}
    assert set(whole) == set(basic) == {0, None, 3}
    same = lambda a, b: a is b is None or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, abs_tol=1e-12)))
    for k, r in whole.items():
        assert r["n"] == basic[k]["n"] and all(same(r[c], basic[k][c]) for c in ("sum", "min", "max", "range"))
        assert same(r["entropy"], entropy[k]) and same(r["mad"], mad[k]) and same(r["deriv"], deriv[k])
    assert whole[0]["sum"] == 6 and whole[3]["min"] is None


def test_places_beyond_2_to_53(spark):
    idx = 2**60 + 7
    df = spark.createDataFrame([("f", idx, 1.0)], "field_id string, idx long, value double")
    r = chunking.chunk_1d(df, 10).first()
    assert (r["chunk_id"], r["pos"]) == (idx // 10, idx % 10)
    g = chunking.gather(df, (2**40, 2**21), (3, 5)).first()
    i, j = divmod(idx, 2**21)
    assert g["chunk_id"] == i // 3 * -(-(2**21) // 5) + j // 5


def test_epoch_milestones_with_null_keys(spark):
    df = spark.createDataFrame([(k, e) for k in ("a", None) for e in range(12)], "k string, epoch int")
    got = sorted((r["k"] or "", r["epoch"]) for r in telemetry.epoch_milestones(df, ["k"]).collect())
    assert got == sorted((k, e) for k in ("a", "") for e in (0, 2, 4, 6, 8, 10, 11))

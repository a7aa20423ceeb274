import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dimensions
from sparkloom.operators import chunking, mlprep, predict, select, telemetry
from sparkloom.plans import arrays
from sparkloom.sources import fields
from sparkloom.sources import telemetry as tables


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(np.float32(v))) for i, v in enumerate(np.cumsum(rng.normal(size=300)))]
    return arrays.chunk_table(spark.createDataFrame(rows, "field_id string, idx long, value float"), 100)


def test_lifetime_summary(spark):
    r = tables.lifetime_summary(spark.createDataFrame([(100, 50), (100, 30)], "original_bytes long, encoded_bytes long")).first()
    assert tuple(r) == (2, 200, 80, 2.5)


def test_masked_metrics_slice(spark):
    df = spark.createDataFrame([(1.0, 2.0, "none"), (3.0, 4.0, "linear"), (5.0, 0.001, "linear")], "p double, r double, quantization string")
    got = {r["slice"]: r for r in mlprep.masked_metrics(df, "p", "r").collect()}
    assert math.isclose(got["all"]["mape_pct"], (50 + 25) / 2) and got["lossy"]["n"] == 2 and math.isclose(got["lossy"]["mape_pct"], 25)


def test_fold_summary_and_nan_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in mlprep.fold_summary(df, ["k"], "v").collect()}
    assert (got["a"]["mean"], got["a"]["std"]) == (2, 1)
    means = {r["k"]: r["m"] for r in df.groupBy("k").agg(telemetry.nan_mean(F.col("v")).alias("m")).collect()}
    assert means == {"a": 2, "b": None}


def test_ranking_profile(table):
    rows = arrays.profile_ranking(table, arrays.Options(error_bound=0.01), predict.seeded_weights())
    ranked = telemetry.ranks(rows, ["field_id", "chunk_id"], "action32")
    tau = telemetry.kendall_tau(ranked, ["field_id", "chunk_id"]).collect()
    assert len(tau) == 3 and all(-1 <= r["tau"] <= 1 and r["n"] == 16 for r in tau)
    regret = telemetry.top_regret(ranked, ["field_id", "chunk_id"]).collect()
    assert all(r["top1_regret"] >= 1 for r in regret)


def test_enrichment_takes_the_first_source(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    one, two = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id int, v string")
    assert sorted((r["id"], r["v"]) for r in telemetry.enriched(base, [one, two], ["id"], "v").collect() if r["v"]) == [(1, "x"), (2, "z")]


def test_hdf5_is_gated(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(NotImplementedError):
            fields.load_hdf5(spark, "x.h5")


def test_random_actions_are_reproducible(table, spark):
    a = select.random_actions(table, dimensions.config64(spark), 5, 1).select("chunk_id", "action64")
    b = select.random_actions(table.repartition(3), dimensions.config64(spark), 5, 1).select("chunk_id", "action64")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 15


def test_explored_order_and_adoption(spark):
    df = spark.createDataFrame([(0, 1, False, 1.0), (0, 2, True, 5.0), (0, 3, False, 0.5)], "chunk_id int, action32 int, is_primary boolean, cost double")
    assert [r["action32"] for r in select.explored_order(df, ["chunk_id"]).orderBy("place").collect()] == [2, 3, 1]
    assert spark.range(1).select(select.adopt(F.lit(2.0), F.lit(1.0), F.lit(True)).alias("x")).first()["x"]


def test_epochs_and_sub_chunks(spark):
    df = spark.createDataFrame([(e, 1.0) for e in range(11)], "epoch int, v double")
    assert sorted(r["epoch"] for r in telemetry.epoch_milestones(df).collect()) == [0, 2, 4, 6, 8, 10]
    assert telemetry.epoch_series(df, [], ["v"], []).count() == 11
    assert [r[0] for r in spark.createDataFrame([(0,), (65536,)], "p long").select(chunking.sub_chunk(F.col("p"), 4, 256 * 1024)).collect()] == [0, 1]


def test_fold_grid(spark):
    rows = spark.range(10)
    grid = spark.createDataFrame([(0.1,), (0.2,)], "lr double")
    out = mlprep.fold_grid(rows, mlprep.hash_fold("id", 2), 2, grid)
    assert out.count() == 40 and out.where("not is_train").count() == 20


def test_groups_and_features(spark):
    df = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 0)], "k string, v int")
    assert {r["k"] for r in telemetry.complete_groups(df, ["k"]).collect()} == {"a"}
    imp = mlprep.mean_abs_by_group(spark.createDataFrame([(1.0, -3.0, 2.0)], "x double, y double, z double"), {"xy": ["x", "y"], "z": ["z"]})
    assert {tuple(r) for r in imp.collect()} == {("xy", 4.0), ("z", 2.0)}

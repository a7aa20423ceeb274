import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkloom.operators import mlprep, ordering, predict, stats
from sparkloom.plans import derived, queries
from sparkloom.sources import fields, telemetry
from sparkloom.streaming import learn, replay

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    return sorted(map(repr, df.astype(object).where(df.notna(), None)[sorted(df.columns)].itertuples(index=False, name=None)))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_round_trips_keep_their_bounds(spark):
    rows = queries.codec_roundtrip(spark, SF)
    assert rows.where("measured and not within").count() == 0 and rows.where("measured").count() > 0
    assert queries.byte_shuffle_roundtrip(spark, SF).where("not same").count() == 0


@needs_data
def test_text_entropy_like_numpy(spark):
    docs = derived.read(spark, SF, "documents").limit(20)
    for r in stats.text_entropy(docs, "doc_id", "text").join(docs, "doc_id").collect():
        assert abs(r["entropy"] - stats.entropy_bytes(r["text"].encode())) < 1e-9


# -- learning ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(0)
    rows = [("f", i, 1024, float(rng.uniform(1, 8)), float(rng.uniform(0, 5)), float(rng.uniform(0, 5))) for i in range(12)]
    return spark.createDataFrame(rows, "field_id string, chunk_id long, n_bytes long, entropy double, mad double, deriv double").crossJoin(learn.modes(spark))


def test_updates_move_toward_the_target():
    w = predict.seeded_weights(3)
    learner = learn.Learner(w)
    x = np.random.default_rng(0).normal(size=(1, 8))
    h = predict.hidden(w, x)
    real = predict.outputs(w, h)[:, :4] * np.array([[2.0, 1, 1, 1]])
    before = abs(predict.outputs(w, h)[0, 0] - real[0, 0])
    for _ in range(20):
        learner.update(h, predict.outputs(learner.weights, h), real)
    assert abs(predict.outputs(learner.weights, h)[0, 0] - real[0, 0]) < before


def test_small_errors_do_not_fire():
    w = predict.seeded_weights(3)
    h = predict.hidden(w, np.ones((1, 8)))
    y = predict.outputs(w, h)
    assert not learn.Learner(w).update(h, y, y[:, :4] * 1.05)


def test_snapshot_and_restore():
    w = predict.seeded_weights(1)
    a = learn.Learner(w)
    h = predict.hidden(w, np.ones((2, 8)))
    a.update(h, predict.outputs(w, h), predict.outputs(w, h)[:, :4] * 3)
    b = learn.Learner(w)
    b.restore(a.snapshot())
    assert b.snapshot() == a.snapshot() and b.calls == 1


def test_off_mode_never_learns(chunks):
    rows = learn.learn(chunks, predict.seeded_weights()).collect()
    assert len(rows) == 72 and not any(r["sgd_fired"] or r["explored"] for r in rows if r["mode"] == "off")
    assert all(r["regret"] >= 0 and (r["final_action32"] == r["action32"]) == (r["regret"] == 0) for r in rows)


def test_stream_equals_batch(spark, chunks, tmp_path):
    src = str(tmp_path / "in")
    for lo in range(0, 12, 3):
        chunks.where(F.col("chunk_id").between(lo, lo + 2)).coalesce(1).write.mode("append").parquet(src)
    w = predict.seeded_weights()
    q = learn.learn_stream(replay.replay(spark, src), w).writeStream.format("memory").queryName("learned").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("learned").collect(), learn.learn(chunks, w).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_back_fill(spark):
    a = spark.createDataFrame([(1, -1.0), (2, 5.0)], "chunk_id long, decomp_ms double")
    assert sorted(map(tuple, learn.back_fill(a, a.where("chunk_id = 1").withColumn("decomp_ms", F.lit(9.0))).collect())) == [(1, 9.0), (2, 5.0)]


# -- whole arrays -----------------------------------------------------------------------------


@pytest.mark.parametrize("options", [
    dict(), dict(selector="heuristic"), dict(selector="zstd", shuffle=True), dict(selector="ans"), dict(selector="exhaustive", error_bound=0.1), dict(error_bound=0.1, policy="ratio"), dict(mode="bypass"),
])
def test_write_and_read(spark, options):
    from sparkloom.plans import arrays

    rng = np.random.default_rng(0)
    rows = [("a", i, float(np.float32(v))) for i, v in enumerate(np.cumsum(rng.normal(size=700)))] + [("b", 0, float("nan")), ("b", 1, 1.0)]
    f = spark.createDataFrame(rows, "field_id string, idx long, value float")
    o = arrays.Options(chunk=128, **options)
    coded = arrays.write_field(f, o, predict.seeded_weights())
    back = arrays.read_field(coded, 128)
    v = {r["field_id"]: r for r in arrays.verify(f, back, o.error_bound).collect()}
    assert v["a"]["lost"] == v["b"]["lost"] == 0 and v["a"]["violations"] == 0 and v["b"]["mismatches"] == 1
    assert all(r["encoded_bytes"] <= r["original_bytes"] or not r["passed_through"] for r in coded.collect())


def test_unknown_options(spark):
    from sparkloom.plans import arrays

    with pytest.raises(ValueError):
        arrays.Options(policy="fastest").weights()
    f = spark.createDataFrame([("a", 0, 1.0)], "field_id string, idx long, value float")
    with pytest.raises(ValueError):
        arrays.write_field(f, arrays.Options(selector="magic"), predict.seeded_weights())


def test_command_line(spark, tmp_path, capsys):
    from sparkloom import cli

    np.cumsum(np.ones(300, "<f4")).astype("<f4").tofile(tmp_path / "x.f32")
    assert cli.main(["compress", str(tmp_path / "x.f32"), str(tmp_path / "c"), "--chunk", "64", "--verify"], spark) == 0
    assert "verified" in capsys.readouterr().out
    assert cli.main(["decompress", str(tmp_path / "c"), str(tmp_path / "d"), "--chunk", "64"], spark) == 0
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "d")).orderBy("idx").collect()] == list(range(1, 301))
    assert cli.main(["predict", str(tmp_path / "x.f32")], spark) == 0


def test_doubles_in_halves(spark):
    from sparkloom.functions import scalar

    df = spark.createDataFrame([(0.001,), (-2.5e300,), (0.0,)], "x double")
    low, high = scalar.double_halves(F.col("x"))
    assert all(r["x"] == r["y"] for r in df.withColumn("y", scalar.double_of_halves(low, high)).collect())


def test_observed_counts(spark):
    from sparkloom.operators import telemetry as t

    rows, seen = t.observed(spark.range(10), "cache", hits=F.col("id") < 3, misses=F.col("id") >= 3)
    rows.count()
    assert seen.get == {"hits": 3, "misses": 7}


# -- preparation ------------------------------------------------------------------------------


def test_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "file")
    share = df.where(mlprep.hash_split("file")).count() / 1000
    assert 0.75 < share < 0.85
    exact = mlprep.shuffled_split(df, "file")
    keys = list(range(1000))
    np.random.RandomState(42).shuffle(keys)
    assert {r["file"] for r in exact.where("not train").collect()} == set(keys[:200])


def test_statistics_of_training_rows_only(spark):
    df = spark.createDataFrame([(1.0, 7.0, True), (3.0, 7.0, True), (100.0, 7.0, False)], "a double, b double, t boolean")
    z = mlprep.standardise(df, ["a", "b"], F.col("t")).orderBy("a").collect()
    assert [(r["a_z"], r["b_z"]) for r in z] == [(-1, 0), (1, 0), (98, 0)]


def test_dense_number(spark):
    df = spark.range(0, 500, 7)
    assert [r["n"] for r in ordering.dense_number(df, ["id"], "n").orderBy("id").collect()] == list(range(1, df.count() + 1))


def test_canonical_rows_and_targets(spark):
    row = dict(chunk_id=1, success=True, algorithm="ZSTD", quantized=True, shuffle_bytes=4, error_bound=0.1, original_bytes=100, entropy_bits=5.0, mad=1.0, second_derivative=1.0, comp_time_ms=0.5, decomp_time_ms=2.0, compression_ratio=3.0, psnr_db=float("inf"), ssim=1.0, rmse=0.0, max_abs_error=0.0, mean_abs_error=0.0)
    df = spark.createDataFrame([row, row | {"success": False}])
    r = mlprep.targets(mlprep.label_encode(mlprep.canonical(df))).collect()
    assert len(r) == 1 and (r[0]["algo_idx"], r[0]["quant"], r[0]["shuffle_on"], r[0]["y_psnr"]) == (4, 1, 1, 120)
    assert np.isclose(r[0]["y_comp"], np.log(2))


def test_raw_fields(spark, tmp_path):
    np.arange(10, dtype="<f4").tofile(tmp_path / "b.f32")
    np.arange(5, dtype="<f4").tofile(tmp_path / "a.f32")
    (tmp_path / "c.txt").write_text("no")
    assert [r["path"][-5:] for r in fields.discover(spark, str(tmp_path), ".f32").collect()] == ["a.f32", "b.f32"]
    df = fields.load_field(spark, str(tmp_path / "b.f32"))
    assert [r["value"] for r in df.orderBy("idx").collect()] == list(range(10))
    with pytest.raises(Exception, match="short read"):
        fields.load_raw(spark, str(tmp_path / "a.f32"), expected_bytes=40).collect()
    (tmp_path / "bad.f32").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        fields.load_raw(spark, str(tmp_path / "bad.f32")).collect()


def test_names(spark):
    df = spark.createDataFrame([("/d/f32_high_entropy_p0.10_w4.0_random.bin",), ("/d/odd.bin",)], "path string")
    a, b = fields.parse_names(df).collect()
    assert (a["dtype"], a["palette"], a["perturbation"], a["bin_width"], a["fill"]) == ("f32", "high_entropy", 0.1, 4.0, "random")
    assert (b["dtype"], b["palette"], b["perturbation"]) == (None, None, None)


def test_csv_and_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("e2e_ms,vol_ms\n1.5,2\nbad,3\n")
    assert [tuple(r) for r in telemetry.read_csv(spark, str(tmp_path / "a.csv"), telemetry.TIMING).collect()] == [(1.5, 2.0)]
    assert telemetry.first_present(spark, [str(tmp_path / "no.csv"), str(tmp_path / "a.csv")]) == str(tmp_path / "a.csv")
    df = spark.createDataFrame([(1048576.0, None), (None, 7.0)], "file_bytes double, file_mb double")
    assert [r["file_mib"] for r in telemetry.aliased(df).collect()] == [1, 7]
    col = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in telemetry.load_column(col, "v", 2.0).collect()] == [3.0]


def test_logs_and_sentinels(spark, tmp_path):
    (tmp_path / "cv.log").write_text("noise\nFold 1: ratio MAPE = 12.5%\nFold 2: ratio MAPE = 10\nMean ratio MAPE: 11.25 +/- 1.2\n")
    rows = {(r["fold"], r["metric"]): r["value"] for r in telemetry.parse_cv_log(spark, str(tmp_path / "cv.log")).collect()}
    assert rows == {(1, "ratio MAPE"): 12.5, (2, "ratio MAPE"): 10.0, (None, "ratio MAPE"): 11.25}
    df = spark.createDataFrame([(99999.0,), (1.0,)], "cost double")
    back = telemetry.from_sentinels(df, {"cost": 99999.0})
    assert [r[0] for r in back.collect()] == [None, 1.0] and [r[0] for r in telemetry.to_sentinels(back, {"cost": 99999.0}).collect()] == [99999.0, 1.0]


def test_chunk_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "zstd", b"x"), ("a", 0, "lz4", b"y"), ("b", 0, "lz4", b"z")], "field_id string, chunk_id long, comp_algo string, encoded binary")
    fields.write_chunks(df, str(tmp_path / "c"))
    assert fields.read_chunks(spark, str(tmp_path / "c"), "a").count() == 2
    assert {tuple(r) for r in fields.algorithms_attribute(df).collect()} == {("a", "lz4,zstd"), ("b", "lz4")}


def test_step_files(spark, tmp_path):
    f = spark.range(10).select(F.col("id").alias("idx"), F.col("id").cast("float").alias("value"))
    replay.step_files(f, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10


def test_pandas_version_is_there():
    assert pd.__version__

import numpy as np

from sparkloom.plans import queries


def test_grid_queries_take_every_vector_whole(spark, tmp_path):
    rows, width = 620, 70
    values = np.arange(rows * width, dtype=float).reshape(rows, width)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.nd_gather(spark, str(tmp_path)).toPandas()
    i, j = np.divmod(np.arange(rows * width), width)
    want = {(c, p): k for c, p, k in zip((i // 48 * 4 + j // 20).tolist(), (i % 48 * np.minimum(20, width - j // 20 * 20) + j % 20).tolist(), range(rows * width), strict=True)}
    assert len(want) == rows * width
    assert {(r.chunk_id, r.pos): r.idx for r in got.itertuples()} == want and (got["idx"] == got["value"]).all()
    back = queries.nd_scatter(spark, str(tmp_path)).toPandas()
    assert back["back"].all() and sorted(back["idx"]) == list(range(rows * width))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.nd_gather(spark, f"{tmp_path}/none").count() == 0 == queries.nd_scatter(spark, f"{tmp_path}/none").count()

import corpus_pipeline
from sparkloom.llm import quality

from .conftest import write


def test_stages_on_odd_rows(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 0), (6, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    write(docs, tmp_path, "documents")
    write(labels, tmp_path, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "mixing", "packing"]
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if k < 3:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_run_equals_its_stages(spark, tmp_path, docs):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    write(docs, tmp_path, "documents")
    write(labels, tmp_path, "labels")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    field = quality.fit_field(table, labels)
    kept = {r["doc_id"] for r in quality.score_documents(table, field).collect() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in out} <= kept
    assert not {1, 2} <= {r["doc_id"] for r in out}

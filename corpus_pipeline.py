"""Corpus pipeline: quality filter, near-duplicate removal, source mixing, packing.

``STAGES`` lists the stages; each is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, near_dup, packing, quality
from sparkloom.llm.common import drop_scratch, materialize, scratch_scope, small_batches, table
from sparkloom.llm.tokens import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is fitted on labelled rows of ``docs``."""
    return quality.keep_good(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return near_dup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed at weights 5, 2, 1 in turn to 150 % of all words; repeats are rows of their own."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of 2048 tokens; one row a piece.

    Queues keep the order of the mix, that of its files and of the rows in them; a table that is not read
    from files is taken by doc_id.
    """
    try:
        docs.select("_metadata.row_index")
        order = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    except AnalysisException:
        order = None
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, order=order)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fitted weights, signatures and byte-pair ids have no SQL form; the tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    When a stage is written, the tables it worked with and the one before it go; the last stage's stay
    as long as its result may be read.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        with scratch_scope() as written, small_batches(spark):
            docs = materialize(out, f"stage-{name}")
        drop_scratch(spark, made + before)
        before = written
    return docs

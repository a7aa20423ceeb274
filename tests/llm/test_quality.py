import itertools

import numpy as np
import pytest

from sparkloom.llm import quality

GOOD = "the cat sat on the mat and then it went away to sleep for a while"
BAD = "### $$$ ||| ### &&& *** ### $$$"


def test_marginals_like_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    unary, stay = rng.normal(size=8), np.array([0.7, -0.4])
    good, pairs = quality.marginals(unary, stay, lines)
    at = 0
    for n in lines.tolist():
        total, marg, both = 0.0, np.zeros(n), np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[at + i] * y[i] for i in range(n)) + sum(stay[y[i]] for i in range(n - 1) if y[i] == y[i + 1]))
            total += w
            marg += w * np.array(y)
            for i in range(n - 1):
                if y[i] == y[i + 1]:
                    both[i, y[i]] += w
        assert np.allclose(good[at : at + n], marg / total) and np.allclose(pairs[at : at + n], both / total)
        at += n


def test_features_of_lines():
    f, length, lines = quality.line_features([b"", GOOD.encode() + b"\n" + BAD.encode(), b"\n\n"])
    assert lines.tolist() == [1, 2, 3] and f.shape == (6, quality.WIDTH) and length.sum() == len(GOOD) + len(BAD) + 2 + 1 + 3
    assert np.isfinite(f).all()


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    words = GOOD.split()
    rows, labels = [], []
    for d in range(400):
        bad = d % 4 == 0
        text = "\n".join((BAD if bad and rng.random() < 0.8 else " ".join(rng.permutation(words))) for _ in range(int(rng.integers(1, 6))))
        rows.append((d, text if d % 4 or "#" in text else BAD, "en", "a", len(text)))
        labels.append((d, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97


def test_held_out_labels_are_not_read(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_field(docs, labels), quality.fit_field(docs, flipped)
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_odd_rows(spark, docs, no_docs, tables):
    _, labels = tables
    odd = labels.unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, None)], "doc_id long, quality int, toxic int"))
    rows = quality.quality(docs, odd).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(no_docs, labels).count() == 0
    alone = quality.quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5} and all(r["predicted"] == 1 for r in alone)


def test_keep_good(tables, docs):
    rows, labels = tables
    field = quality.fit_field(rows, labels)
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and kept.count() >= 1
    assert {r["doc_id"] for r in quality.keep_good(rows, field).collect()} == {r["doc_id"] for r in quality.score_documents(rows, field).collect() if r["score"] >= 0.3}

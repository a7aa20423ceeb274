import time
import numpy as np

from sparkloom.llm import quality


def test_long_documents_are_drawn(spark):
    rng = np.random.default_rng(4)
    good, bad = "the cat sat on the mat and then it went away to sleep".split(), ["###", "$$$", "|||", "&&&", "***"]
    rows = [(k, "\n".join(" ".join(rng.permutation(good if k % 2 else bad)) for _ in range(quality.FIT_LINES + 20 + k)), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality.fit_field(df, df)
    score = {r["doc_id"]: r["score"] for r in quality.score_documents(df, field).collect()}
    assert all((score[k] >= quality.THRESHOLD) == bool(label) for k, _, label in rows)


def test_windows_stay_inside():
    for n in (1, quality.FIT_LINES, quality.FIT_LINES + 1, 1000):
        at = {quality._window(str(k).encode(), n) for k in range(200)}
        assert min(at) >= 0 and max(at) + min(n, quality.FIT_LINES) <= n and (len(at) > 1) == (n > quality.FIT_LINES)


def test_long_texts_in_pieces_equal_one_after_the_other(monkeypatch):
    rng = np.random.default_rng(8)
    lines = np.array([1, 700, 3, 1025, 512, 40, 513])
    unary, stay = rng.normal(0, 2, int(lines.sum())), np.array([0.7, 1.9])
    pieces = quality.marginals(unary, stay, lines)
    monkeypatch.setattr(quality, "PIECE", 10**6)
    whole = quality.marginals(unary, stay, lines)
    assert np.allclose(pieces[0], whole[0], atol=1e-9) and np.allclose(pieces[1], whole[1], atol=1e-9)


def test_a_text_of_very_many_lines_is_quick():
    field = quality.Field(np.ones(quality.WIDTH), np.array([0.5, 0.5]), 1.0, 0.0)
    begin = time.time()
    field.scores([b"a line of it\n" * 200_000])
    assert time.time() - begin < 10

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import packing
from sparkloom.llm.tokens import vocabulary_path

from .conftest import SCHEMA


def round_robin(queues, window):
    """The plain simulation: window after window, deficits carried, a dry queue's share dealt on."""
    dealt, sent, out = dict.fromkeys(queues, Fraction(0)), dict.fromkeys(queues, 0), []
    while any(sent[s] < n for s, (n, _) in queues.items()):
        budget = Fraction(window)
        while budget and (active := [s for s in queues if dealt[s] < queues[s][0]]):
            weight = sum(queues[s][1] for s in active)
            until_dry = min((queues[s][0] - dealt[s]) / queues[s][1] for s in active) * weight
            part = min(budget, until_dry)
            for s in active:
                dealt[s] += queues[s][1] * part / weight
            budget -= part
        row = []
        for s in queues:
            whole = int(dealt[s])
            row += [(s, t) for t in range(sent[s], whole)]
            sent[s] = whole
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_closed_form_equals_round_robin(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    queues = {s: (int(rng.integers(1, 400)), Fraction(int(rng.integers(1, 50)), 100)) for s in range(n)}
    if seed % 3 == 0:  # a queue that empties early
        queues[0] = (5, Fraction(1, 2))
    window = int(rng.integers(1, 90))
    want = round_robin(queues, window)
    rounds = packing.Rounds(queues, window)
    got = [[] for _ in want]
    for s, (total, _) in queues.items():
        for start in range(0, total, 37):
            for at, length, w in rounds.spans(s, total, start, min(37, total - start)):
                got[w] += [(s, t) for t in range(at, at + length)]
    assert got == want


def test_queues_without_a_target_share_by_size():
    sizes, named = {"a": 90, "b": 30}, {"x": (200, Fraction(1, 2))}
    rounds = packing.Rounds(named | {packing.REST: (120, Fraction(1, 2))}, 40)
    want = round_robin({"x": named["x"], "a": (90, Fraction(3, 8)), "b": (30, Fraction(1, 8))}, 40)
    for s, total in sizes.items():
        got = [(at + k, w) for at, length, w in rounds.spans(packing.REST, total, 0, total) for k in range(length)]
        assert got == [(t, w) for w, row in enumerate(want) for q, t in row if q == s]


def packed(spark, rows, parts, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("!")).repartition(parts)
    return packing.pack(df, vocabulary_path("word_bpe_49k.json"), 1, 16, 64, **options).collect()


def test_targets_fill_windows_and_reruns_agree(spark):
    rows = [(i, "one two three four five six", "en", ["a", "b", None][i % 3], 0) for i in range(300)]
    options = {"targets": {"a": 0.6, None: 0.1}}
    first, again = packed(spark, rows, 2, **options), packed(spark, rows, 5, **options)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    source = {i: s for i, _, _, s, _ in rows}
    total = sum(r["length"] for r in first)
    assert total == sum({r["doc_id"]: r["doc_tokens"] for r in first}.values())
    # until the first queue runs dry every window of 64 tokens has 38 or 39 of a, 6 or 7 of none, the rest of b
    for w in range(int(total / 3 / 0.6 / 64) - 1):
        own = [r for r in first if r["sequence_id"] // 4 == w]
        share = {s: sum(r["length"] for r in own if source[r["doc_id"]] == s) for s in ("a", "b", None)}
        assert abs(share["a"] - 38.4) < 2.5 and abs(share[None] - 6.4) < 2.5 and abs(share["b"] - 19.2) < 2.5
    with pytest.raises(ValueError, match="targets"):
        packed(spark, rows, 2, targets={"a": 1.5})


def test_a_given_order_is_kept(spark):
    rows = [(i, "w " * (i % 7), "en", "a", 100 - i) for i in range(40)]
    got = packed(spark, rows, 3, order=[F.col("n_chars")])
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0] == list(range(39, -1, -1))

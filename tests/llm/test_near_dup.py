import random
import re

import numpy as np
import pytest

from sparkloom.llm import near_dup, shingles

from .conftest import SCHEMA

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text, k):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent=80):
    """(size, component) of each (id, text), by comparing all pairs."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for d in range(n):
        kind = rng.random()
        if rows and kind < 0.5:  # a copy with some edits
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((d, " ".join(w)))
        else:
            passage = words[:50] if kind < 0.7 else []
            rows.append((d, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(1, 150))])))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_components_like_all_pairs(spark, k):
    rows = corpus(k, 300)
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3)
    want = brute(rows, k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, k).collect()}
    assert got == want
    assert len(set(c for _, c in want.values())) < len(rows)


def test_hot_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "KEY_ROWS", 16)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(near_dup, "STAR", 8)
    monkeypatch.setattr(near_dup, "CENTRES", 1)  # so that much is left for the comparison across classes
    rng = random.Random(5)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(d % 7):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(1000)
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, 4).collect()}
    assert got == brute(rows, 4)


def test_far_members_of_a_group_link_through_others(spark, monkeypatch):
    """A chain of texts, each near the next and far from the centre, is one class."""
    monkeypatch.setattr(near_dup, "KEY_ROWS", 16)
    base = ["c%d" % i for i in range(100)]
    rows = []
    for d in range(60):
        w = list(base)
        w[: d // 3] = ["y%d" % i for i in range(d // 3)]
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, 4).collect()}
    assert got == brute(rows, 4)


def test_odd_rows(docs, no_docs):
    rows = near_dup.near_duplicates(docs, 4).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert (by[1][0]["component_id"], by[2][0]["component_id"], by[2][0]["kept"]) == (1, 1, False)
    for d in (3, 4, 5):
        assert (by[d][0]["n_shingles"], by[d][0]["component_id"], by[d][0]["kept"]) == (0, d, True)
    assert by[6][0]["n_shingles"] == 1
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert [r["component_id"] for r in by[9]] == [9, 9]
    assert near_dup.near_duplicates(no_docs).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(docs, 4, percent=70)


def test_keep_one(docs, no_docs):
    from pyspark.sql import functions as F

    docs = docs.withColumns({c: F.lit(7) for c in ("key_", "id_", "no_id_", "nth_", "text_key", "doc", "no_id")})
    kept = near_dup.keep_one(docs, 5)
    assert all(r["nth_"] == 7 and r["key_"] == 7 and r["doc"] == 7 for r in kept.collect())
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, None]
    assert near_dup.keep_one(no_docs).count() == 0


def test_rows_that_repeat_an_id(spark):
    """An id with two texts links by each of them, as a centre and as a member."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b") + " x"), (0, text("z")), (9, text("z") + " x"), (9, text("q")), (10, text("q") + " y")]
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(2)
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df, 4).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (0, 0), (9, 0), (10, 0)}


def test_chain_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["id"]: r["component"] for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_pigeonhole_guarantee():
    """Any two signatures within the threshold share a key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dup.SLOTS).astype("<u2")
        b = a.copy()
        at = rng.choice(near_dup.SLOTS, near_dup.ERRORS, replace=False)
        b[at] ^= 1
        keys = near_dup.keys_of(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_intersections_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(12)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:7]]
    monkeypatch.setattr(near_dup, "CELLS", 64)
    assert near_dup.intersections(sets[:7], sets[5:]).tolist() == want


def test_shingles_like_regex():
    texts = ["", " ", "A b c", "a B c d a b c d", "\n x  y\tz w v\x0b", "É é ß", "one"]
    for k in (1, 4, 5):
        for t, s in zip(texts, shingles.shingle_sets([x.encode() for x in texts], k), strict=True):
            assert len(s) == len(shingle_set(t, k))

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import iblt

from .conftest import ROWS


def sets(lists):
    keys = [np.array(sorted(set(x)), np.uint64) for x in lists]
    return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.array([len(k) for k in keys], np.int64)


_set = lambda n: st.sets(st.integers(0, 2**64 - 1), max_size=n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(_set(60), _set(60), _set(200)), min_size=1, max_size=5))
def test_differences_are_recovered_from_stored_strings(docs_):
    a, b = [x | c for x, _, c in docs_], [y | c for _, y, c in docs_]
    x, y = iblt.sketches(*sets(a)), iblt.sketches(*sets(b))
    found, sizes, cells = iblt.differences(x, y)
    for (only_a, only_b), n, p, q in zip(found, sizes.tolist(), a, b, strict=True):
        assert set(only_a.tolist()) == p - q and set(only_b.tolist()) == q - p and n == len(p) + len(q)
    keys, counts = iblt.read_sketches(x).inverted()
    assert [set(k.tolist()) for k in np.split(keys, np.cumsum(counts)[:-1])] == a
    assert (cells % 6 == 0).all()


def test_most_differences_peel_at_the_stored_size():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 120, 2000)
    a = [set(rng.integers(0, 2**63, k).tolist()) for k in n]
    b = [set(list(x)[: len(x) // 2]) | set(rng.integers(0, 2**63, len(x) - len(x) // 2).tolist()) for x in a]
    x, y = iblt.sketches(*sets(a)), iblt.sketches(*sets(b))
    _, _, cells = iblt.differences(x, y)
    stored = 3 * np.maximum(iblt.read_sketches(x).third, iblt.read_sketches(y).third)
    assert (cells == stored).mean() > 0.95


def test_digests():
    keys, counts = iblt.paragraph_digests([b"", b"one two three\nfour", b"one two three\nfour", b"  "])
    assert counts[0] == counts[3] == 0 and counts[1] == counts[2] > 0
    assert (keys[: counts[1]] == keys[counts[1] :]).all()


def brute(rows):
    """(doc_id, text) -> what follows, in descending doc_id, none last; equal ids as they come."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (d, t) in enumerate(order):
        text, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((d, text, other, text[: len(text) - half] + other[:half]))
    return out


def likeness(a, b):
    keys = [set(iblt.paragraph_digests([t.encode()])[0].tolist()) for t in (a, b)]
    n = len(keys[0]) + len(keys[1])
    return 1 - len(keys[0] ^ keys[1]) / n if n else 1.0


def test_fingerprints_equal_brute_force(docs, no_docs):
    rows = iblt.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    for d, text, other, changed in brute([(d, t) for d, t, *_ in ROWS]):
        assert got[d]["n_chars"] == len(text)
        if d == 9:  # two equal rows: one is the other's next
            continue
        assert got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert np.isclose(got[d]["near_edited"], likeness(text, changed)) and np.isclose(got[d]["near_next"], likeness(text, other))
        if changed == text:
            assert got[d]["near_edited"] == 1 and got[d]["fingerprint"] == got[d]["edited_fingerprint"]
    assert got[2]["near_next"] == 1 and got[1]["fingerprint"] == got[2]["fingerprint"]
    assert iblt.fingerprints(no_docs).count() == 0


def test_one_row_follows_itself(spark):
    df = spark.createDataFrame([(5, "only one row here")], "doc_id long, text string")
    r = iblt.fingerprints(df).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"only one only one").hexdigest()


def test_many_rows_of_one_id_and_of_none(spark):
    """A third of the rows without id, a third of one id: no piece holds them, and every row has its next."""
    rows = [([None, 7, 2**62 - i, -i, 2**53 + i, i][min(i % 12, 5) if i % 12 > 7 else i % 2], f"text {i} of these") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = iblt.in_pieces(df).where("copy = 0").groupBy("piece").count().collect()
    assert max(r["count"] for r in pieces) < 300 and sum(r["count"] for r in pieces) == len(rows)
    got = iblt.fingerprints(df).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in rows)
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = {hashlib.sha256(iblt.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (_, t) in enumerate(order)}
    assert {r["edited_sha256"] for r in got} == want

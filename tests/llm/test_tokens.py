import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing, simple8b, token_counts
from sparkloom.llm.tokens import ChunkEncoder, vocabulary_path

from .conftest import ROWS

ODD = ["", " ", "a  b", "a\n\nb c", " lead x", "trail ", "x \n y", "don't <|endoftext|> x's", "é́ ́a b", "a 　b", "ΑΣ ΣΑΣ. Σ", "a\x1c b", "1 22 333", "\x01 a \x01"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(name):
    small = ChunkEncoder(vocabulary_path(name), "<u4", cache_chunks=8)
    large = ChunkEncoder(vocabulary_path(name), "<u4")
    texts = [t or "" for _, t, *_ in ROWS] + ODD
    want = large._whole(texts)
    assert large.encode(texts) == want
    assert large.encode(texts) == want
    assert small.encode(texts) == want


ADDED = ["<|endoftext|>", "one <|endoftext|> two", "<|startoftext|>a b", "x <|ENDOFTEXT|> y", "a <|endof text|> b", "a<|endoftext|>b c  d", "Ünï <|StartOfText|> ç"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_encode_as_in_a_plain_encoder(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(name))
    texts = [*ADDED, "plain words", *ODD]
    want = [plain.encode(t, add_special_tokens=False) for t in texts]
    enc = ChunkEncoder(vocabulary_path(name), "<u4")
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [e.ids for e in want]
    spans = token_counts.SpanEncoder(vocabulary_path(name))
    for _ in range(2):
        assert [x.tolist() for x in spans.encode(texts)] == [[list(o) for o in e.offsets] for e in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n.\t'S3", max_size=40), max_size=6))
def test_random_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = _shared(name)
        assert enc.encode(texts) == (enc._whole(texts) if texts else [])


_encoders = {}


def _shared(name):
    return _encoders.setdefault(name, ChunkEncoder(vocabulary_path(name), "<u4"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000), st.sampled_from([5, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    a = np.array(ids, np.uint64)
    words, offsets, escapes = simple8b.pack(a, block)
    assert (simple8b.unpack(words, offsets, len(a), escapes, block) == a).all()
    assert len(escapes) == int((a >= 2**60).sum())


def test_simple8b_packs_densely():
    words, _, _ = simple8b.pack(np.ones(60_000, np.uint64))
    assert len(words) <= 60_000 / 60 * 1.06


def test_damaged_record():
    raw = simple8b.write_record([1, None], [2, 1], np.array([5, 6, 7]))
    ids, lengths, values = simple8b.read_record(raw)
    assert ids == [1, None] and lengths.tolist() == [2, 1] and values.tolist() == [5, 6, 7]
    with pytest.raises(ValueError):
        simple8b.read_record(raw + b"x")
    with pytest.raises(ValueError):
        simple8b.read_record(b"XXXX" + raw[4:])


def _brute(name, end_id):
    enc = _shared(name)
    return [(d, enc._whole([t or ""])[0] + np.array([end_id], "<u4").tobytes()) for d, t, *_ in ROWS]


def test_token_files(spark, docs, no_docs):
    path = simple8b.write_token_files(docs, vocabulary_path("byte_bpe_50k.json"), 2, record_ids=50)
    got = sorted(simple8b.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(_brute("byte_bpe_50k.json", 2), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    for r, (_, raw) in zip(got, want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert simple8b.read_token_files(spark, simple8b.write_token_files(no_docs, vocabulary_path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("sequence, window", [(16, 64), (2048, 64 * 2048)])
def test_packing(docs, sequence, window):
    rows = packing.pack(docs, vocabulary_path("word_bpe_49k.json"), 1, sequence, window).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s, pieces in by_seq.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == sequence or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for d, raw in _brute("word_bpe_49k.json", 1):
        if d == 9:
            continue
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(raw) // 4
            assert r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(raw) // 4
    assert sum(r["length"] for r in by_doc[9]) == 2 * by_doc[9][0]["doc_tokens"]


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, vocabulary_path("word_bpe_49k.json")).count() == 0


def test_section_counts(docs, no_docs):
    enc = _shared("byte_bpe_50k.json")
    got = {}
    for r in token_counts.section_token_counts(docs, vocabulary_path("byte_bpe_50k.json")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in ROWS:
        text = t or ""
        rows = sorted(got[d], key=lambda r: (r["section"]))
        if d == 9:
            continue
        assert len(rows) == text.count("\n") + 1
        assert "".join(text[r["start"] : r["end"]] for r in rows) == text
        assert sum(r["n_tokens"] for r in rows) == rows[0]["doc_tokens"] == len(enc.tokenizer.encode(text).ids)
        want = [0] * len(rows)
        for a, b in enc.tokenizer.encode(text).offsets:
            share = [min(r["end"], max(b, a + 1)) - max(r["start"], a) for r in rows]
            want[share.index(max(share))] += 1
        assert [r["n_tokens"] for r in rows] == want
    assert token_counts.section_token_counts(no_docs, vocabulary_path("byte_bpe_50k.json")).count() == 0


def test_given_sections(spark):
    text = "title here\nbody of the text goes on"
    rows = [(1, text, [(11, 19), (0, 10)]), (2, text, None), (3, None, []), (4, "abc", [(0, 2), (2, 3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start: int, end: int>>")
    got = sorted((r["doc_id"], r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]) for r in token_counts.section_token_counts(df, vocabulary_path("byte_bpe_50k.json"), "parts").collect())
    enc = _shared("byte_bpe_50k.json").tokenizer
    inside = sum(b <= 10 for _, b in enc.encode(text).offsets)
    assert got[0] == (1, 0, 0, 10, inside, 0) and got[1][:4] == (1, 1, 11, 19)
    assert [g[:4] for g in got[2:]] == [(4, 0, 0, 2), (4, 1, 2, 3)] and sum(g[4] for g in got[2:]) == len(enc.encode("abc").ids)
    odd = spark.createDataFrame([(1, "a b c d", [(4, 99), (0, 3), None, (2, 4), (5, None), (6, 6), (-3, 1)])], df.schema)
    rows = token_counts.section_token_counts(odd, vocabulary_path("byte_bpe_50k.json"), "parts").orderBy("section").collect()
    assert [(r["start"], r["end"], r["n_tokens"], r["bad"]) for r in rows] == [
        (0, 3, 2, False), (4, 99, 2, False), (None, None, 0, True), (-3, 1, 0, True), (2, 4, 0, True), (5, None, 0, True), (6, 6, 0, True),
    ]


def test_spans_like_whole_texts():
    enc = token_counts.SpanEncoder(vocabulary_path("byte_bpe_50k.json"), cache_chunks=8)
    texts = [t or "" for _, t, *_ in ROWS] + ODD
    for got, want in zip(enc.encode(texts), enc._whole(texts), strict=True):
        assert np.asarray(got, "<i4").tobytes() == want


def test_attribution_rule():
    spans = np.array([[0, 4], [4, 8], [8, 9], [20, 22]])
    own, crossing = token_counts.attribute(spans, np.array([0, 6, 8]), np.array([6, 8, 10]))
    assert own.tolist() == [0, 0, 2, -1] and crossing.tolist() == [False, True, False, False]


def test_attribution_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, 2 * int(rng.integers(1, 8)), replace=False)).reshape(-1, 2)
        at = np.sort(rng.choice(60, 20, replace=False))
        spans = np.stack([at, at + rng.integers(0, 9, 20)], axis=1)
        own, crossing = token_counts.attribute(spans, cuts[:, 0], cuts[:, 1])
        for (a, b), o, c in zip(spans.tolist(), own.tolist(), crossing.tolist(), strict=True):
            b = max(b, a + 1)
            share = [max(0, min(e, b) - max(s, a)) for s, e in cuts.tolist()]
            assert o == (share.index(max(share)) if max(share) else -1) and c == (0 < max(share) < b - a)


def test_a_damaged_record_is_one_row(spark, docs):
    from pyspark.sql import functions as F

    path = simple8b.write_token_files(docs, vocabulary_path("byte_bpe_50k.json"), record_ids=64)
    files = spark.read.parquet(path)
    first = files.orderBy("part_id", "part_start").first()
    hurt = F.when((F.col("part_id") == first["part_id"]) & (F.col("part_start") == first["part_start"]), F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    files.withColumn("payload", hurt).write.parquet(f"{path}-hurt")
    whole = {r["doc_id"]: r for r in simple8b.read_token_files(spark, path).collect()}
    got = simple8b.read_token_files(spark, f"{path}-hurt").collect()
    assert sum(r["error"] is not None for r in got) == 1
    assert all(whole[r["doc_id"]]["start"] == r["start"] for r in got if r["error"] is None and r["doc_id"] != 9)

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import ogg

from .conftest import ROWS


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_page_checksum(data):
    assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 400))
def test_sample_round_trip(data, times):
    raw = data * times
    media = ogg.write_samples(ogg.padded(raw), len(raw))
    payload, n, at = ogg.read_samples(media)
    assert payload[:n] == raw and set(payload[n:]) <= {255}
    assert at == [(k + 1) * ogg.PACKET / ogg.RATE for k in range(len(payload) // ogg.PACKET)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"", b"x", b"y" * 255, b"z" * 510, b"q" * 70_000]), min_size=1, max_size=6))
def test_packets_span_pages_and_streams_interleave(packets):
    one, two = ogg.StreamWriter(7), ogg.StreamWriter(9)
    a = one.pages([b"head"], [0], 2) + one.pages(packets, list(range(len(packets))), 0, 4)
    b = two.pages([b"other"], [0], 2, 4)
    raw = b"".join(a[:1] + b + a[1:])
    got = ogg.demultiplex(raw)
    assert got[7][0] == [b"head", *packets] and got[9][0] == [b"other"]


def test_damage_is_found():
    media = ogg.write_samples(ogg.padded(b"abc" * 40_000), 120_000)
    for at in (30, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.read_samples(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.demultiplex(media[:-5])
    page = 27 + 1 + 16
    with pytest.raises(ValueError):
        ogg.read_samples(media[page:])
    assert ogg.demultiplex(b"") == {}


def test_media_column(docs, no_docs):
    got = {r["doc_id"]: r for r in ogg.read_media(ogg.to_media(docs)).collect()}
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert {c: got[1][c] for c in ("media_sha256", "feature")} == {c: got[2][c] for c in ("media_sha256", "feature")}
    assert ogg.read_media(ogg.to_media(no_docs)).count() == 0


def test_null_and_damaged_media(spark):
    good = ogg.write_samples(ogg.padded(b"some text of it" * 90), 1350)
    cut, wrong, none = good[:-5], good[:60] + b"?" + good[61:], b""
    rows = [(1, good), (2, None), (3, cut), (4, wrong), (5, none), (6, b"OggS"), (7, good)]
    got = {r["doc_id"]: r for r in ogg.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["n_bytes"] == 1350 and got[7]["payload_sha256"] == got[1]["payload_sha256"]
    assert got[1]["packet_seconds"] == [k * ogg.PACKET / ogg.RATE for k in range(1, 4)]
    for d in (2, 3, 4, 5, 6):
        assert got[d]["error"] and got[d]["n_bytes"] is None and got[d]["feature"] is None

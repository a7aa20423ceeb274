"""Media columns: Ogg pages with checksums, lacing, logical streams and granule times.

The writer stores 8-bit samples losslessly: one logical stream of sample packets and one small
stream that holds the unpadded size, multiplexed into one physical stream.  The reader verifies
each page's checksum and sequence number, reassembles packets from lacing values (packets may
span pages), keeps logical streams apart by serial number and derives times from granules.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices, tidy

#: Samples of a packet; payloads are padded to a positive multiple.
PACKET = 576
#: Sample rate of the granule clock.
RATE = 8000
PAD = b"\xff"
#: Lacing values of a page at most.
SEGMENTS = 255
_PAGE = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, most significant bit first, no inversions).

    zlib has the same polynomial bit-reversed, so bytes and result are reversed around it.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


class StreamWriter:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = _PAGE.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(lacing)) + lacing
        self.sequence += 1
        crc = page_crc(head + body)
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + body

    def pages(self, packets: list[bytes], granules: list[int], flags: int = 0, last: int = 0) -> list[bytes]:
        """Pages of packets; a page's granule is that of the last packet that ends on it, -1 if none."""
        lacing, ends = bytearray(), {}
        for p, g in zip(packets, granules, strict=True):
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            ends[len(lacing) - 1] = g
        body, at, out = b"".join(packets), 0, []
        for k in range(0, len(lacing), SEGMENTS):
            some = bytes(lacing[k : k + SEGMENTS])
            done = [i for i in range(k + len(some) - 1, k - 1, -1) if lacing[i] < 255][:1]
            size = sum(some)
            more = k > 0 and lacing[k - 1] == 255
            end = k + SEGMENTS >= len(lacing)
            out.append(self.page(some, body[at : at + size], ends[done[0]] if done else -1, flags | _CONTINUED * more | last * end))
            at += size
        return out


def padded(data: bytes, packet: int = PACKET) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``packet``."""
    return data + PAD * (-len(data) % packet or (0 if data else packet))


def write_samples(payload: bytes, n_bytes: int, packet: int = PACKET, rate: int = RATE) -> bytes:
    """A physical stream of ``payload`` as 8-bit samples; the same payload gives the same bytes."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    sound, meta = StreamWriter(serial), StreamWriter(serial | 1)
    out = sound.pages([b"PCM8" + struct.pack("<III", 1, rate, packet)], [0], _FIRST)
    out += meta.pages([b"META" + struct.pack("<I", 1)], [0], _FIRST)
    per_page = SEGMENTS // (packet // 255 + 1)
    for k in range(0, len(payload), packet * per_page):
        some = payload[k : k + packet * per_page]
        packets = [some[i : i + packet] for i in range(0, len(some), packet)]
        ends = [k + i + packet for i in range(0, len(some), packet)]
        out += sound.pages(packets, ends, 0, _LAST * (k + len(some) == len(payload)))
        if not k:
            out += meta.pages([struct.pack("<Q", n_bytes)], [0], 0, _LAST)
    return b"".join(out)


def demultiplex(data: bytes) -> dict[int, tuple[list[bytes], list[int]]]:
    """Packets of each logical stream and, for each packet, its granule (that of its page's last packet).

    A wrong checksum, a gap in page numbers, a broken continuation or a cut page raises ValueError.
    Empty bytes have no streams.
    """
    at, n = 0, len(data)
    open_part: dict[int, list[bytes]] = {}
    number: dict[int, int] = {}
    ended: set[int] = set()
    streams: dict[int, tuple[list[bytes], list[int]]] = {}
    while at < n:
        if n - at < _PAGE.size:
            raise ValueError("a page's head is cut")
        magic, version, flags, granule, serial, sequence, crc, count = _PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page begins here")
        lacing = data[at + 27 : at + 27 + count]
        begin = at + 27 + count
        end = begin + sum(lacing)
        if end > n or len(lacing) < count:
            raise ValueError("a page is cut")
        if page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        if flags & _FIRST:
            if serial in number:
                raise ValueError("a stream begins twice")
            number[serial], streams[serial], open_part[serial] = 0, ([], []), []
        if serial in ended or number.get(serial) != sequence:
            raise ValueError("a page is missing")
        number[serial] += 1
        if bool(flags & _CONTINUED) != bool(open_part[serial]):
            raise ValueError("a packet's continuation is missing")
        packets, granules = streams[serial]
        done, size = len(packets), 0
        for x in lacing:
            size += x
            if x < 255:
                body = data[begin : begin + size]
                if open_part[serial]:
                    body = b"".join([*open_part[serial], body])
                    open_part[serial] = []
                packets.append(body)
                begin, size = begin + size, 0
        if count and lacing[-1] == 255:
            open_part[serial].append(data[begin : begin + size])
        granules += [granule] * (len(packets) - done)
        if flags & _LAST:
            ended.add(serial)
        at = end
    if any(open_part.values()):
        raise ValueError("a packet is cut")
    return streams


def read_samples(data: bytes) -> tuple[bytes, int, list[float]]:
    """(payload, unpadded size, seconds at the end of each packet) of :func:`write_samples`."""
    sound = meta = None
    for packets, granules in demultiplex(data).values():
        if not packets:
            continue
        if packets[0].startswith(b"PCM8"):
            sound = packets, granules
        elif packets[0].startswith(b"META"):
            meta = packets
    if sound is None or not meta or len(meta) < 2 or len(sound[0]) < 2:
        raise ValueError("a logical stream is missing")
    _, rate, packet = struct.unpack_from("<III", sound[0][0], 4)
    body = sound[0][1:]
    if sound[1][-1] != sum(map(len, body)):
        raise ValueError("the last granule is not the number of samples")
    # a page tells the time of its last packet; its others lie whole packets before it
    times = [0.0] * len(body)
    page, end = -1, 0
    for k in range(len(body) - 1, -1, -1):
        g = sound[1][k + 1]
        end = end - packet if g == page else g
        page = g
        times[k] = end / rate
    return b"".join(body), struct.unpack("<Q", meta[1])[0], times


def features(payload: bytes, times: list[float]) -> str:
    """Duration, mean, root mean square and zero crossings around the middle of the read samples."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256).astype(np.int64)
    v = np.arange(256, dtype=np.int64) - 128
    mean, rms = float((hist * v).sum()) / len(x), (float((hist * v * v).sum()) / len(x)) ** 0.5
    high = x >= 128
    cross = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"packets={len(times)};seconds={times[-1]:.4f};mean={mean:.4f};rms={rms:.4f};crossings={cross}"


@tidy
def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            texts = [(t or "").encode() for t in rows.column(1).to_pylist()]
            media = [write_samples(padded(t), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(media, pa.large_binary()).cast(pa.binary())], names=["doc_id", "media"])


_SAMPLES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("packet_seconds", pa.list_(pa.float64())), ("error", pa.string())]
)


def _read_one(media: bytes | None) -> tuple:
    if media is None:
        return (*[None] * 8, "no media")
    stored = len(media), hashlib.sha256(media).hexdigest()
    try:
        payload, n_bytes, times = read_samples(media)
    except (ValueError, IndexError, struct.error) as damage:
        return (*[None] * 4, *stored, None, None, str(damage) or "damaged")
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, features(payload, times), times, None


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in text_slices(batch):
            cols = list(zip(*[_read_one(raw.as_py()) for raw in some.column(1)], strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(cols, _SAMPLES.types[1:], strict=True))], schema=_SAMPLES)


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: every whole text (null: empty) as an Ogg stream.

    Other columns are not read; equal texts have equal streams, and repeated rows have one each.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_write, "doc_id long, media binary")


def store_media(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The streams of :func:`to_media` written to a folder (default: a scratch table) and read again."""
    media = to_media(docs)
    if path is None:
        return materialize(media, "media")
    media.write.parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


def read_media(media: DataFrame) -> DataFrame:
    """Sizes, digests, features and packet times of each ``media`` value, from its reassembled packets.

    ``packet_seconds`` are the times at which packets end, derived from granule positions.  A null value, or a
    damaged one (checksum, page number, cut page or packet, missing stream), has nulls and says so in ``error``.
    """
    return media.select("doc_id", "media").mapInArrow(
        _read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packet_seconds array<double>, error string",
    )

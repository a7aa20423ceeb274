"""Token-id files: Simple-8b words with escapes and per-block offsets.

A 64-bit word holds a selector in its top four bits and, below it, as many ids of one width as
fit in sixty bits.  Selector 0 is an escape: its payload is an index into the record's list of
values that need more than sixty bits.  Ids are cut into blocks of :data:`BLOCK`; a block starts
at a word of its own, whose place is in the offset table, so that blocks are coded and decoded
side by side with numpy instead of one id after the other.

A record is a run of documents.  Its bytes, little-endian:

    4s magic "S8B1" | u32 documents | u64 ids | u32 block | u32 blocks | u64 words | u64 escapes
    i64 doc_id[documents] | u8 has_id[documents] | u64 length[documents]
    u32 offset[blocks] | u64 word[words] | u64 escape[escapes]

Records travel in a Parquet container (one row each), so that any file system that Spark can
write is fit for them and a reader can start at any record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_partitions, text_slices, tidy
from .tokens import encoder

#: Ids a word holds and their width, by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 0
#: Ids of a block.
BLOCK = 1024
#: Chunks a worker remembers: this tokenizer tells case and spaces apart, so there are more of them.
CACHE_CHUNKS = 2_500_000
#: A record ends with the document that reaches so many ids.
RECORD_IDS = 1 << 19
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_HEAD = struct.Struct("<4sIQIIQQ")
_SHIFT = np.uint64(60)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offset of each block's first word, escaped values) of non-negative ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "<u8")
    lanes, reach = -(-n // block), int(COUNTS.max())
    stride = block + reach
    small = int(ids.max()) < len(_BITS)
    values = np.zeros((lanes, stride), np.uint32 if small else np.uint64)
    whole = n // block
    values[:whole, :block] = ids[: whole * block].reshape(whole, block)
    if whole < lanes:
        values[whole, : n - whole * block] = ids[whole * block :]
    bits = _BITS[values] if small else np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    # a window that fits a selector also fits all with fewer and wider ids, so their number tells the best
    widest, span = {1: bits}, 1
    while 2 * span <= reach:
        w = widest[span].copy()
        np.maximum(w[:, :-span], widest[span][:, span:], out=w[:, :-span])
        widest[2 * span] = w
        span *= 2
    best = (bits[:, :block] <= 60).astype(np.uint8)
    for s in range(13, 0, -1):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        half = 1 << (count.bit_length() - 1)
        fits = np.maximum(widest[half][:, :block], widest[half][:, count - half : count - half + block]) <= width
        if not fits.any():
            break
        best += fits
    best = np.where(best == 0, ESCAPE, 15 - best).ravel()
    size = np.full(lanes, block, np.int64)
    size[-1] = n - (lanes - 1) * block
    at, lane = np.zeros(lanes, np.int64), np.arange(lanes)
    hit_lane, hit_at, hit_sel = [], [], []
    while len(lane):
        s = best[lane * block + at]
        hit_lane.append(lane)
        hit_at.append(at)
        hit_sel.append(s)
        at = at + COUNTS[s]
        on = at < size[lane]
        lane, at = lane[on], at[on]
    # a lane's k-th word was found in step k: words go to their places without a sort
    step = np.repeat(np.arange(len(hit_lane)), list(map(len, hit_lane)))
    found = np.concatenate(hit_lane)
    n_words = np.bincount(found, minlength=lanes)
    offsets = np.cumsum(n_words) - n_words
    to = offsets[found] + step
    place, sel = np.empty(len(to), np.int64), np.empty(len(to), best.dtype)
    place[to], sel[to] = found * stride + np.concatenate(hit_at), np.concatenate(hit_sel)
    words = sel.astype(np.uint64) << _SHIFT
    flat = values.ravel()
    for s in range(1, len(COUNTS)):
        own = np.flatnonzero(sel == s)
        if len(own):
            p = place[own]
            got = flat[p].astype(np.uint64)
            for j in range(1, int(COUNTS[s])):
                got |= flat[p + j].astype(np.uint64) << np.uint64(j * int(WIDTHS[s]))
            words[own] |= got
    own = np.flatnonzero(sel == ESCAPE)
    escapes = flat[place[own]].astype(np.uint64)
    words[own] |= np.arange(len(own), dtype=np.uint64)
    return words.astype("<u8"), offsets.astype("<u4"), escapes.astype("<u8")


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of :func:`pack`, all blocks at once."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> _SHIFT).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    counts = COUNTS[sel]
    before = np.cumsum(counts) - counts
    per_block = np.diff(np.append(offsets.astype(np.int64), len(words)))
    first = np.arange(len(offsets), dtype=np.int64) * block
    start = before + np.repeat(first - before[offsets], per_block)
    end = np.repeat(np.minimum(first + block, n), per_block)
    out = np.zeros(n, np.uint64)
    for s in range(1, len(COUNTS)):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        b, to, limit, width = body[own], start[own], end[own], int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        cut = np.flatnonzero(to + int(COUNTS[s]) > limit)  # the last words of blocks may hold fewer
        if len(cut):
            for j in range(int(COUNTS[s])):
                inside = cut[to[cut] + j < limit[cut]]
                out[to[inside] + j] = (b[inside] >> np.uint64(j * width)) & mask
            full = to + int(COUNTS[s]) <= limit
            b, to = b[full], to[full]
        for j in range(int(COUNTS[s])):
            out[to + j] = (b >> np.uint64(j * width)) & mask
    own = np.flatnonzero(sel == ESCAPE)
    out[start[own]] = escapes[body[own].astype(np.int64)]
    return out


def write_record(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One record's bytes."""
    words, offsets, escapes = pack(ids)
    return b"".join(
        (
            _HEAD.pack(b"S8B1", len(doc_ids), len(ids), BLOCK, len(offsets), len(words), len(escapes)),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is not None for i in doc_ids], "u1").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            offsets.tobytes(),
            words.tobytes(),
            escapes.tobytes(),
        )
    )


def read_record(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of :func:`write_record`."""
    magic, docs, n, block, blocks, n_words, n_escapes = _HEAD.unpack_from(raw)
    if magic != b"S8B1":
        raise ValueError("not a token-id record")
    at = _HEAD.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, dtype, count, at)
        at += got.nbytes
        return got

    doc_ids, known, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
    offsets, words, escapes = take("<u4", blocks), take("<u8", n_words), take("<u8", n_escapes)
    if at != len(raw) or int(lengths.sum()) != n:
        raise ValueError("a token-id record is damaged")
    return [int(i) if k else None for i, k in zip(doc_ids, known, strict=True)], lengths, unpack(words, offsets, n, escapes, block)


_FILE = "part_id int, part_start long, n_docs int, n_ids long, payload binary"


def _to_records(batches: Iterator[pa.RecordBatch], path: str, end_id: int, record_ids: int) -> Iterator[pa.RecordBatch]:
    part, start = TaskContext.get().partitionId(), 0
    enc = encoder(path, cache_chunks=CACHE_CHUNKS)
    tail = np.array([end_id], "<u4").tobytes()
    doc_ids: list[int | None] = []
    pieces: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal start, held
        ids = np.frombuffer(b"".join(pieces), "<u4")
        raw = write_record(doc_ids, [len(p) // 4 for p in pieces], ids)
        out = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(doc_ids)], pa.int32()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())],
            names=["part_id", "part_start", "n_docs", "n_ids", "payload"],
        )
        start, held = start + held, 0
        doc_ids.clear()
        pieces.clear()
        return out

    for batch in batches:
        for rows in text_slices(batch):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            for doc_id, ids in zip(rows.column(0).to_pylist(), enc.encode(texts), strict=True):
                doc_ids.append(doc_id)
                pieces.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= record_ids:
                    yield flush()
    if doc_ids:
        yield flush()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None, record_ids: int = RECORD_IDS) -> str:
    """Encode every whole text (null: empty), append ``end_id`` and write the ids; returns the folder.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read.  The files hold the documents in
    ascending ``doc_id`` order (null first; repeated ids side by side, ordered by a hash of the text).
    An empty table makes an empty folder of files.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInArrow(partial(_to_records, path=vocabulary, end_id=end_id, record_ids=record_ids), _FILE).write.option("compression", "none").parquet(path)
    return path


_READ = ["part_id", "in_part", "doc_id", "n_tokens", "ids_crc32", "error"]


@tidy
def _from_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, begin, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            try:
                doc_ids, lengths, ids = read_record(raw.as_py())
            except (ValueError, IndexError, struct.error) as damage:
                none = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *none, pa.array([str(damage) or "damaged"])], names=_READ)
                continue
            body = memoryview(ids.astype("<u4")).cast("B")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(doc_ids), pa.int32()), pa.array(begin + starts, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.nulls(len(doc_ids), pa.string())],
                names=_READ,
            )


def read_token_files(spark, path: str) -> DataFrame:
    """What the files hold of each document: ``doc_id, start, n_tokens, ids_crc32, error``.

    ``start`` counts the ids of all documents before it.  The parts' sizes (one row a file part) are
    summed in order; documents are never brought together.  A damaged record has one row, with its ``error`` alone;
    the places of other documents do not change.
    """
    files = spark.read.schema(_FILE).parquet(path)
    parts = files.groupBy("part_id").agg(F.sum("n_ids").alias("ids"))
    order = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part_id", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    docs = files.select("part_id", "part_start", "payload").mapInArrow(_from_records, "part_id int, in_part long, doc_id long, n_tokens long, ids_crc32 long, error string")
    return docs.join(base, "part_id").select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "error")

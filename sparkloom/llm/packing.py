"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens and has a weight.  A window of :data:`WINDOW`
tokens is dealt to the queues that still have tokens, in proportion to their weights; a queue sends
whole tokens of what it has been dealt, and the rest of a token is its deficit, carried to the next
window and the next partition.  When a queue runs dry, the others share what it would have got, from
that very token on.

Because tokens may be cut anywhere, the rounds have a closed form.  Call ``v`` the tokens that a unit
of weight has been dealt: a queue of ``T`` tokens and weight ``w`` has sent ``min(T, floor(w v))`` and
runs dry at ``v = T / w``.  What all have been dealt, ``F(v) = sum of min(T, w v)``, is piecewise linear,
and window ``k`` ends where ``F(v) = (k + 1) window``.  So each document finds its own windows from its
queue's total and the few points where a queue runs dry; nothing is handed from task to task.

Queues that no target names form one class that shares the class's weight by size, hence they run dry
together: there are as many such points as named targets, however many sources.  What each window takes of
each queue is summed, running sums over windows and queues give the places, and the windows, end to end,
are cut into sequences; only the very last sequence needs padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running, shuffle_partitions, small_batches, text_slices, tidy
from .tokens import encoder

#: Tokens of a sequence.
SEQUENCE = 2048
#: Tokens of a round over all queues.
WINDOW = 64 * SEQUENCE
#: Chunks a worker remembers.
CACHE_CHUNKS = 1_300_000

_IDS = "part_id int, source string, doc_id long, n long, in_part long, ids binary"
_SPANS = "source string, doc_id long, start long, length long, doc_tokens long, window long, at long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@tidy
def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    part, enc = TaskContext.get().partitionId(), encoder(path, dtype, CACHE_CHUNKS)
    tail, size = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
    now, sent = None, 0  # rows come sorted by source
    for batch in batches:
        for rows in text_slices(batch):
            ids = [x + tail for x in enc.encode([t or "" for t in rows.column(1).to_pylist()])]
            counts, before = [len(x) // size for x in ids], []
            for source, n in zip(rows.column(2).to_pylist(), counts, strict=True):
                if source != now:
                    now, sent = source, 0
                before.append(sent)
                sent += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), rows.column(2), rows.column(0), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                names=["part_id", "source", "doc_id", "n", "in_part", "ids"],
            )


class Rounds:
    """The rounds in closed form, for classes of queues ``name -> (tokens, weight)`` that run dry together."""

    def __init__(self, classes: dict[object, tuple[int, Fraction]], window: int = WINDOW):
        self.classes = {c: (t, Fraction(w)) for c, (t, w) in classes.items() if t}
        self.window = window
        # (v, F(v), weight of those with tokens after it) where classes run dry, from the start on
        order = sorted((t / w, w) for t, w in self.classes.values())
        active = sum((w for _, w in order), Fraction(0))
        self.dry, self.at, self.active = [Fraction(0)], [Fraction(0)], [active]
        for v, w in order:
            self.at.append(self.at[-1] + self.active[-1] * (v - self.dry[-1]))
            self.dry.append(v)
            self.active.append(self.active[-1] - w)

    def dealt(self, v: Fraction) -> Fraction:
        """``F(v)``: tokens that all queues have been dealt."""
        k = max(0, bisect_left(self.dry, v) - 1)
        return self.at[k] + self.active[k] * (v - self.dry[k])

    def reached(self, tokens: int) -> Fraction:
        """The ``v`` with ``F(v) = tokens``."""
        k = max(0, bisect_left(self.at, tokens) - 1)
        return self.dry[k] + (tokens - self.at[k]) / self.active[k] if self.active[k] else self.dry[k]

    def sent(self, window: int, name: object, total: int) -> int:
        """Whole tokens that a queue of ``total`` tokens in class ``name`` has sent before a window."""
        tokens, weight = self.classes[name]
        if window * self.window >= self.at[-1]:
            return total
        return min(total, int(total * weight * self.reached(window * self.window) / tokens))

    def window_of(self, token: int, name: object, total: int) -> int:
        """The window that sends a queue's token ``token``."""
        tokens, weight = self.classes[name]
        v = Fraction((token + 1) * tokens, total) / weight
        return max(0, -int(-self.dealt(v) // self.window) - 1)

    def spans(self, name: object, total: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(token of the queue, tokens, window) for ``n`` tokens of a queue, in order."""
        at, end = start, start + n
        window = self.window_of(at, name, total) if n else 0
        while at < end:
            stop = min(end, self.sent(window + 1, name, total))
            if stop > at:
                yield at, stop - at, window
            at, window = max(at, stop), window + 1


@tidy
def _windows(batches: Iterator[pa.RecordBatch], rounds: Rounds, size: int) -> Iterator[pa.RecordBatch]:
    """Documents cut where a window ends; their ids, the last column if there, are cut along."""
    types = [pa.string(), *[pa.int64()] * 6, pa.binary()]
    names = [*[c.split()[0] for c in _SPANS.split(", ")], "ids"]
    seen: dict[str | None, tuple[int, int, int]] = {}  # of a queue: its last window and the tokens it begins and ends at
    for batch in batches:
        out: list[tuple] = []
        sources, named, totals, docs, starts, counts = (batch.column(i).to_pylist() for i in range(6))
        bodies = batch.column(6) if batch.num_columns > 6 else [None] * batch.num_rows
        for source, own, total, doc_id, at, n, raw in zip(sources, named, totals, docs, starts, counts, bodies, strict=True):
            ids, cls = raw.as_py() if raw is not None else b"", source if own else REST
            window, begin, end = seen.get(source, (-1, 0, -1))
            if begin <= at and at + n <= end:
                spans = [(at, n, window)]
            else:
                spans = list(rounds.spans(cls, total, at, n))
                window = spans[-1][2]
                if len(seen) > 4096:
                    seen.clear()
                seen[source] = window, rounds.sent(window, cls, total), rounds.sent(window + 1, cls, total)
            for a, length, w in spans:
                b = a - at
                out.append((source, doc_id, b, length, n, w, a, ids[b * size : (b + length) * size]))
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        k = len(names) if batch.num_columns > 6 else len(names) - 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types[:k], strict=True)], names=names[:k])


@tidy
def _sequences(batches: Iterator[pa.RecordBatch], dtype: str, sequence: int) -> Iterator[pa.RecordBatch]:
    """Window pieces cut where a sequence ends."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        docs, starts, counts, places = (batch.column(i).to_pylist() for i in range(4))
        for doc_id, start, n, place, raw in zip(docs, starts, counts, places, batch.column(4), strict=True):
            view = memoryview(np.frombuffer(raw.as_py(), dtype).astype("<u4")).cast("B")
            a, end = 0, len(view) // 4
            while a < end:
                take = min(end - a, sequence - place % sequence)
                out.append((doc_id, start + a, take, zlib.crc32(view[4 * a : 4 * (a + take)]), n, place // sequence, place % sequence))
                a, place = a + take, place + take
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


class _Rest:
    """The class of queues that no target names."""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Rest)

    def __hash__(self) -> int:
        return 0


REST = _Rest()


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    targets: dict[str | None, float] | None = None,
    order: list[Column] | None = None,
    dtype: str = "<u2",
) -> DataFrame:
    """Pack all documents (null text: only the end id) into sequences; one row a piece.

    ``docs`` has ``doc_id, text, source``; a null source is a queue of its own.  ``targets`` gives sources
    their share of every window (between 0 and 1; together at most 1, and below 1 if there are others); all
    others share the rest by size.  Without targets each queue has its own share of all tokens, so all run
    dry together.  A queue's documents stand in ``order`` (ascending columns of ``docs``; default: doc_id, then a
    hash of the text), so reruns agree whatever the partitioning; repeated rows are packed each.  In a window
    queues stand in code-point order, null last.  Every id lies in one piece; offsets in a sequence have no
    gaps; all sequences but the last are full.  An empty table has no pieces.
    """
    spark, size = docs.sparkSession, np.dtype(dtype).itemsize
    weights = {s: Fraction(w) for s, w in (targets or {}).items()}
    if any(w <= 0 for w in weights.values()) or sum(weights.values()) > 1:
        raise ValueError("targets are above 0 and together at most 1")
    order = order or [F.col("doc_id").cast("long"), F.xxhash64("text")]
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("source"), *[c.alias(f"order_{k}") for k, c in enumerate(order)]]
    keys = [F.col("source").asc_nulls_last(), *[F.col(f"order_{k}").asc_nulls_first() for k in range(len(order))]]
    ordered = docs.select(*columns).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text", "source")
    with small_batches(spark):
        ids = materialize(ordered.mapInArrow(partial(_encode, path=vocabulary, end_id=end_id, dtype=dtype), _IDS), "packing-ids")
        # a source's tokens by part: at most as many rows as sources and parts together
        parts = ids.groupBy("source", "part_id").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("source")
        base = parts.select(
            "source", "part_id", F.coalesce(F.sum("n").over(own.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(own).alias("total")
        )
        base = materialize(base, "packing-base")
        if weights:
            is_named = F.col("source").isin(*[s for s in weights if s is not None]) if set(weights) - {None} else F.lit(False)
            is_named = F.when(F.col("source").isNull(), F.lit(None in weights)).otherwise(is_named)
        else:
            is_named = F.lit(False)
        base = base.withColumn("named", is_named)
        first = base.where("base = 0").select("source", "named", "total").distinct()
        classes: dict[object, tuple[int, Fraction]] = {r["source"]: (r["total"], weights[r["source"]]) for r in first.where("named").collect()}
        rest = first.where("not named").agg(F.sum("total")).first()[0]
        if rest:
            left = 1 - sum(weights.values())
            if left <= 0:
                raise ValueError("targets leave nothing for other sources")
            classes[REST] = (rest, left)
        rounds = Rounds(classes, window)
        placed = ids.alias("i").join(base.alias("b"), (F.col("i.part_id") == F.col("b.part_id")) & F.col("i.source").eqNullSafe(F.col("b.source")))
        rows = placed.select("i.source", "named", "total", "doc_id", (F.col("base") + F.col("in_part")).alias("at"), "n", "ids")
        cut = partial(_windows, rounds=rounds, size=size)
        # what each window takes of each queue, and where that begins in the stream
        takes = rows.drop("ids").mapInArrow(cut, _SPANS).groupBy("window", "source").agg(F.sum("length").alias("length"), F.min("at").alias("begin"))
        takes = running(materialize(takes, "packing-takes"), [F.col("window").asc(), F.col("source").asc_nulls_last()], {"place": F.col("length")}, "packing-places")
    # the takes grow with the tokens: dealt by key at every size, and hashed, so the ids are not sorted
    pieces = rows.mapInArrow(cut, f"{_SPANS}, ids binary").alias("p").join(takes.hint("shuffle_hash").alias("t"), (F.col("p.window") == F.col("t.window")) & F.col("p.source").eqNullSafe(F.col("t.source")))
    stream = pieces.select("doc_id", "start", "doc_tokens", (F.col("place") + F.col("at") - F.col("begin")).alias("place"), "ids")
    return stream.select("doc_id", "start", "doc_tokens", "place", "ids").mapInArrow(partial(_sequences, dtype=dtype, sequence=sequence), _PIECES)

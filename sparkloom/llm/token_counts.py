"""Token counts of sections: whole texts are encoded once, tokens are joined to character spans.

A token is the half-open span of characters that the tokenizer reports for it (tokens that share one
character, because it takes several bytes, all have its span).  Sections are sorted spans that do not
overlap.  Allocation rule: a token counts for the section that holds most of its characters; of equal
shares the earlier section gets it; a token outside all sections counts for none (section -1).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, tidy
from .tokens import ChunkEncoder


class SpanEncoder(ChunkEncoder):
    """A :class:`ChunkEncoder` whose values are (start, end) pairs of 32-bit characters, not ids.

    Spans in the cache count from the space before the chunk.
    """

    def __init__(self, path: str, cache_chunks: int = 1_000_000):
        super().__init__(path, "<u4", cache_chunks)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.offsets, "<i4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        if len(self._new) + len(chunks) > self.cache_chunks // 2:
            self._old, self._new = self._new, {}
        good = []
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace():
                self._new[c] = False
            else:
                good.append(c)
        for k in range(0, len(good), 512):
            some = good[k : k + 512]
            spans = np.array(self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False).offsets, "<i4").reshape(-1, 2)
            base = np.cumsum([0] + [len(c) + 1 for c in some])
            at = np.searchsorted(spans[:, 0], base[:-1])
            # a chunk's first token starts at its space; none may reach into the next chunk
            of = np.repeat(np.arange(len(some)), np.diff(np.append(at, len(spans))))
            if np.array_equal(spans[at, 0], base[:-1]) and (spans[:, 1] <= base[of + 1]).all():
                relative = (spans - base[of][:, None]).astype("<i4")
                raw, cuts = relative.tobytes(), (np.append(at, len(spans)) * 8).tolist()
                self._new.update((c, raw[a:b]) for c, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))
            else:
                self._new.update(zip(some, self._whole([" " + c for c in some]), strict=True))

    def _some(self, texts: list[str], out: list, base: int) -> None:
        parts = [["", ""] if self._has_added(t) else t.split(" ") for t in texts]
        found = [list(map(self._new.get, p)) for p in parts]
        holes = [[i for i, x in enumerate(got) if x is None and i] for got in found]
        missing = {p[i] for p, hole in zip(parts, holes, strict=True) for i in hole}
        if missing:
            known = {w: self._old[w] for w in missing if w in self._old}
            self._learn([w for w in missing if w not in known])
            self._new.update(known)
            for p, got, hole in zip(parts, found, holes, strict=True):
                for i in hole:
                    got[i] = self._new[p[i]]
        heads, whole = [], []
        for j, (p, got) in enumerate(zip(parts, found, strict=True)):
            first = p[0]
            bad = len(p) > 1 and (not first or first[0].isspace() or first[-1].isspace()) or any(x is False for x in got[1:])
            (whole if bad else heads).append(j)
        for j, head in zip(heads, self._whole([parts[j][0] for j in heads]) if heads else [], strict=True):
            p, got = parts[j], found[j]
            got[0] = head
            begin = np.cumsum([0] + [len(w) + 1 for w in p[:-1]]) - 1
            begin[0] = 0
            spans = np.frombuffer(b"".join(got), "<i4").reshape(-1, 2)
            counts = np.array(list(map(len, got))) // 8
            out[base + j] = spans + np.repeat(begin, counts)[:, None]
        for j, spans in zip(whole, self._whole([texts[j] for j in whole]) if whole else [], strict=True):
            out[base + j] = np.frombuffer(spans, "<i4").reshape(-1, 2)


@lru_cache(maxsize=4)
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, -1 for none; whether it crosses a section's edge)."""
    a, b = spans[:, 0].astype(np.int64), np.maximum(spans[:, 1], spans[:, 0] + 1).astype(np.int64)
    if not len(starts):
        return np.full(len(a), -1), np.zeros(len(a), bool)
    first = np.searchsorted(ends, a, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(starts, b, side="left") - 1  # the last that starts before its end
    own = np.where(first <= last, first, -1)
    held = np.minimum(first, len(starts) - 1)
    crossing = (first <= last) & ((starts[held] > a) | (ends[held] < b))
    i = np.flatnonzero(crossing)
    if len(i):
        n = last[i] - first[i] + 1
        token, begin = np.repeat(i, n), np.cumsum(n) - n
        s = np.repeat(first[i] - begin, n) + np.arange(len(token))
        share = np.minimum(ends[s], b[token]) - np.maximum(starts[s], a[token])
        most = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, begin), n))
        hit, at = np.unique(token[most], return_index=True)  # the earliest of equal shares
        own[hit] = s[most[at]]
    return own, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines, each with its line end."""
    lengths = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    lengths[-1] -= 1
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def _sorted(spans: list[dict | None] | None) -> tuple[np.ndarray, list[tuple[int | None, int | None]]]:
    """Spans in order, and those that are null, open, empty, before the text or over an earlier one."""
    known = [(None, None) if x is None else (x["start"], x["end"]) for x in spans or []]
    good: list[tuple[int, int]] = []
    bad = []
    for a, b in sorted(known, key=lambda x: tuple((v is not None, v or 0) for v in x)):
        if a is None or b is None or a < 0 or a >= b or good and a < good[-1][1]:
            bad.append((a, b))
        else:
            good.append((a, b))
    return np.array(good, np.int64).reshape(-1, 2), bad


_OUT = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long, bad boolean"


@tidy
def _rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = span_encoder(path)
    for batch in batches:
        for rows in text_slices(batch):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            if rows.num_columns > 2:
                good, bad = zip(*map(_sorted, rows.column(2).to_pylist()), strict=True)
            else:
                good, bad = [np.stack(line_sections(t), axis=1) for t in texts], [[]] * len(texts)
            tokens = [np.asarray(x).reshape(-1, 2) for x in enc.encode(texts)]
            n_good, n_tokens, n_bad = (np.array(list(map(len, x)), np.int64) for x in (good, tokens, bad))
            # all texts on one axis, each beyond the last character or section end of the one before
            reach = np.array([max(len(t), int(g[-1, 1]) if len(g) else 0) + 1 for t, g in zip(texts, good, strict=True)], np.int64)
            base = np.cumsum(reach) - reach
            sections = np.concatenate(good)
            shift = np.repeat(base, n_good)
            own, crossing = attribute(np.concatenate(tokens) + np.repeat(base, n_tokens)[:, None], sections[:, 0] + shift, sections[:, 1] + shift)
            n = len(sections)
            counts, crossed = np.bincount(own[own >= 0], minlength=n), np.bincount(own[crossing & (own >= 0)], minlength=n)
            doc = np.repeat(np.arange(len(texts)), n_good)
            values = [np.arange(n) - np.repeat(np.cumsum(n_good) - n_good, n_good), sections[:, 0], sections[:, 1], counts, crossed, n_tokens[doc]]
            columns = [pa.array(v.astype(np.int64)) for v in values]
            columns = [rows.column(0).take(pa.array(doc)), columns[0].cast(pa.int32()), *columns[1:], pa.array(np.zeros(n, bool))]
            names = [c.split()[0] for c in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if n_bad.any():
                doc = np.repeat(np.arange(len(texts)), n_bad)
                section = n_good[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_bad) - n_bad, n_bad)
                a, b = zip(*[x for some in bad for x in some], strict=True)
                none = pa.array(np.zeros(len(doc), np.int64))
                columns = [rows.column(0).take(pa.array(doc)), pa.array(section.astype(np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, pa.array(n_tokens[doc]), pa.array(np.ones(len(doc), bool))]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def section_token_counts(docs: DataFrame, vocabulary: str, spans: str | None = None) -> DataFrame:
    """Tokens of every section of every whole text (null: empty); one row a section.

    Sections are the text's lines (an empty text is one empty line), or those in the column ``spans``, an array
    of structs ``start, end`` of characters (null: none), which may leave gaps and end beyond the text.  A null or
    open span, an empty one, one that starts below 0 or inside an earlier one is ``bad``: it has no tokens, and its
    number follows those of the others.  ``n_crossing`` of the counted tokens also touch what is outside;
    ``doc_tokens`` is the text's total, which the ``n_tokens`` of lines add up to.  Repeated rows count each.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    if spans is not None:
        columns.append(F.transform(spans, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))).alias("spans"))
    return docs.select(*columns).mapInArrow(partial(_rows, path=vocabulary), _OUT)

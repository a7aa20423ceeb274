"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line has features of its own and those of its neighbours.  The field labels each line good
or bad; forward-backward gives each line's probability of being good, which is weighted by the
line's length and averaged.  A logistic map from that average to the document's label makes the
score.  Lines take their document's label in training: lines that look alike in good and bad
documents then cancel out, and the transitions carry what a bad line says to its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices, tidy
from .shingles import lowered, words_in

#: Labelled documents that the field is fitted on at most (those with the least hash of their id).
FIT_DOCS = 3000
#: Lines in a row that fitting takes of a longer labelled document; all documents are scored whole.
FIT_LINES = 100
THRESHOLD = 0.3
#: Lines of a document that run one after the other.
PIECE = 512

_LETTER, _DIGIT, _SPACE, _STOP, _BAR, _MARK, _SHOUT, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.int32)
_CLASS[128:] = _LETTER
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", _LETTER), (b"0123456789", _DIGIT), (b" \t\n\x0b\x0c\r", _SPACE), (b".,;:?'\"()-", _STOP), (b"!", _SHOUT), (b"|", _BAR), (b"#$%&*", _MARK)):
    _CLASS[list(_chars)] = _c
#: Features of a line itself.
OWN = 16
#: With those of both neighbours and a constant.
WIDTH = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line with its end, lines of each text)."""
    raw = lowered(texts, b"\n")
    lines_of = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    ends = np.flatnonzero(raw == 10)
    n = len(ends)
    begins = np.append(0, ends[:-1] + 1)
    length = ends - begins + 1
    line = np.repeat(np.arange(n, dtype=np.int32 if n < 1 << 27 else np.int64), length)
    counts = np.bincount(line * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8).astype(np.float64)
    upper = np.bincount(line, np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) != raw, n)
    digest, wb, we = words_in(raw)
    words = np.zeros(n)
    again, short, long = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(wb):
        at = line[wb]
        words = np.bincount(at, minlength=n).astype(np.float64)
        same = np.zeros(len(wb))
        same[1:] = (digest[1:] == digest[:-1]) & (at[1:] == at[:-1])
        again = np.bincount(at, same, n)
        size = we - wb
        short, long = np.bincount(at, size <= 3, n), np.bincount(at, size >= 12, n)
    some = np.maximum(words, 1)
    chars = np.maximum(length - 1, 1)
    doc = np.repeat(np.arange(len(texts)), lines_of)
    whole = np.zeros(n, np.uint64)
    if len(wb):
        np.add.at(whole, at, digest * (np.uint64(2) * (np.arange(len(at)) - np.searchsorted(at, at)).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((whole, doc))
    twin = (doc[order][1:] == doc[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    copied = np.zeros(n)
    copied[order[1:]] += twin
    copied[order[:-1]] += twin
    own = np.stack(
        [
            np.minimum(np.log1p(length) / 5, 2), counts[:, _LETTER] / chars, 5 * counts[:, _DIGIT] / chars, counts[:, _STOP] / chars * 5,
            np.minimum(counts[:, _BAR] / some, 1), np.minimum(counts[:, _MARK] / some, 2), counts[:, _OTHER] / chars * 5, again / some,
            np.minimum(2 * again, 1), short / some, long / some, np.minimum((length - 1) / some / 10, 3), words == 0, (copied > 0) & (words > 0),
            np.minimum(counts[:, _SHOUT] / some, 2), upper / chars * 2,
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.concatenate([own, before, after, np.ones((n, 1))], axis=1), length, lines_of


class Field:
    """The fitted field: good-against-bad weights, two transition weights and the logistic map."""

    def __init__(self, weights: np.ndarray, stay: np.ndarray, slope: float, offset: float):
        self.weights, self.stay, self.slope, self.offset = weights, stay, slope, offset

    def good(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return marginals(features @ self.weights, self.stay, lines)[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        features, length, lines = line_features(texts)
        return _sigmoid(self.slope * average(self.good(features, lines), length, lines) + self.offset)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def average(good: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean probability of good lines, for each document."""
    first = np.cumsum(lines) - lines
    share = np.add.reduceat(good * length, first) / np.add.reduceat(length, first)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _forward(unary: np.ndarray, stay: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward scores of pieces of lines, side by side; ``entry`` is what comes to a piece's first line.

    Fills ``out`` (each line's two scores, the higher 0); returns a piece's last ones and what was taken off.
    """
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[0]]) if len(size) else 0
    alive = np.searchsorted(-size[order], -np.arange(steps), side="left")  # pieces with more than t lines
    sb, sg = stay
    a, scale, last = entry[order], np.zeros(len(size)), np.zeros((len(size), 2))
    for t in range(steps):
        k = alive[t]
        at = first[order[:k]] + t
        if t:
            x, y = a[:k, 0], a[:k, 1]
            a = np.stack([np.logaddexp(x + sb, y), np.logaddexp(x, y + sg)], axis=1)
        a = a[:k] + np.stack([np.zeros(k), unary[at]], axis=1)
        top = a.max(axis=1)
        a -= top[:, None]
        scale[order[:k]] += top
        out[at] = last[order[:k]] = a
    return last, scale


def _backward(unary: np.ndarray, stay: np.ndarray, first: np.ndarray, size: np.ndarray, exit_: np.ndarray, out: np.ndarray) -> None:
    """Backward scores of pieces; ``exit_`` is what comes to a piece's last line from beyond it."""
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[0]]) if len(size) else 0
    alive = np.searchsorted(-size[order], -np.arange(steps), side="left")
    sb, sg = stay
    out[first + size - 1] = exit_
    for t in range(steps - 2, -1, -1):
        at = first[order[: alive[t + 1]]] + t
        nb, ng = out[at + 1, 0], out[at + 1, 1] + unary[at + 1]
        v = np.stack([np.logaddexp(nb + sb, ng), np.logaddexp(nb, ng + sg)], axis=1)
        out[at] = v - v.max(axis=1, keepdims=True)


def _ends(unary: np.ndarray, stay: np.ndarray, lines: np.ndarray, first: np.ndarray, size: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes to the first and to the last line of each piece of documents with several.

    A piece takes the scores before it to those of its last line by a matrix of 2 x 2, found for all pieces
    side by side; the matrices of a document are joined in order, forwards and backwards.
    """
    n, spare = len(first), np.zeros((len(unary), 2))
    matrix = np.zeros((n, 2, 2))
    for e, row in enumerate(([stay[0], 0.0], [0.0, stay[1]])):
        last, scale = _forward(unary, stay, first, size, np.where(opens[:, None], 0.0, np.array(row)), spare)
        matrix[:, e] = last + scale[:, None]
    entry, exit_ = np.zeros((n, 2)), np.zeros((n, 2))
    sb, sg = stay
    of_doc = np.flatnonzero(opens)
    pieces = np.diff(np.append(of_doc, n))
    state = np.zeros((len(of_doc), 2))
    for k in range(int(pieces.max(initial=0))):
        on = np.flatnonzero(pieces > k)
        at = of_doc[on] + k
        if k:
            x, y = state[on, 0], state[on, 1]
            entry[at] = np.stack([np.logaddexp(x + sb, y), np.logaddexp(x, y + sg)], axis=1)
            new = np.logaddexp(x[:, None] + matrix[at, 0], y[:, None] + matrix[at, 1])
        else:
            new = matrix[at, 0]
        state[on] = new - new.max(axis=1, keepdims=True)
    state = np.zeros((len(of_doc), 2))
    for k in range(int(pieces.max(initial=0)) - 1, 0, -1):
        on = np.flatnonzero(pieces > k)
        at = of_doc[on] + k
        exit_[at] = state[on]
        new = np.logaddexp(matrix[at, :, 0] + state[on, 0][:, None], matrix[at, :, 1] + state[on, 1][:, None])
        state[on] = new - new.max(axis=1, keepdims=True)
    exit_[of_doc] = state
    return entry, exit_


def marginals(unary: np.ndarray, stay: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good for each line, expected [bad-bad, good-good] transitions of each line with its next).

    Documents run side by side, and so do pieces of :data:`PIECE` lines of longer ones, so a text of very many
    lines takes few steps.  ``unary`` scores good against bad; ``stay`` scores two bad or two good lines in a row.
    """
    first = np.cumsum(lines) - lines
    parts = -(-lines // PIECE)
    sb, sg = stay
    if len(parts) and parts.max() > 1:
        number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + number * PIECE
        size = np.minimum(np.repeat(first + lines, parts) - begin, PIECE)
        entry, exit_ = _ends(unary, stay, lines, begin, size, number == 0)
    else:
        begin, size, entry, exit_ = first, lines, np.zeros((len(lines), 2)), np.zeros((len(lines), 2))
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    _forward(unary, stay, begin, size, entry, forward)
    _backward(unary, stay, begin, size, exit_, backward)
    both = forward + backward
    good = _sigmoid(both[:, 1] - both[:, 0])
    pairs = np.zeros((len(unary), 2))
    last = np.zeros(len(unary), bool)
    last[np.cumsum(lines) - 1] = True
    at = np.flatnonzero(~last)
    if len(at):
        nb, ng = backward[at + 1, 0], backward[at + 1, 1] + unary[at + 1]
        f = forward[at]
        four = np.stack([f[:, 0] + sb + nb, f[:, 0] + ng, f[:, 1] + nb, f[:, 1] + sg + ng], axis=1)
        four = np.exp(four - four.max(axis=1, keepdims=True))
        pairs[at] = four[:, [0, 3]] / four.sum(axis=1, keepdims=True)
    return good, pairs


def fit(features: np.ndarray, length: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Field:
    """Fit by full-batch ascent (Adam) on the labels' likelihood; deterministic.

    Without both classes the score is a constant: the share of label 1, or 0.5 without labels.
    """
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Field(np.zeros(WIDTH), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    truth = np.repeat(labels, lines).astype(np.float64)
    weight = 1 / np.repeat(lines, lines)  # every document counts the same
    last = np.zeros(len(truth), bool)
    last[np.cumsum(lines) - 1] = True
    seen = np.where(last, 0, 1)[:, None] * np.stack([1 - truth, truth], axis=1)
    theta = np.zeros(features.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    docs = len(lines)
    for step in range(1, steps + 1):
        good, pairs = marginals(features @ theta[:-2], theta[-2:], lines)
        gradient = np.append(features.T @ ((truth - good) * weight), ((seen - pairs) * weight[:, None]).sum(axis=0)) / docs - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-2:] = np.clip(theta[-2:], -4, 4)
    field = Field(theta[:-2], theta[-2:], 1.0, 0.0)
    x = average(field.good(features, lines), length, lines)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic map
        p = _sigmoid(slope * x + offset)
        w = p * (1 - p) + 1e-9
        g = np.array([((labels - p) * x).sum() - 1e-2 * slope, (labels - p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + d[0], offset + d[1]
    field.slope, field.offset = float(max(slope, 0.0)), float(offset)
    return field


def _encoded(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in texts.to_pylist()]


def _window(text: bytes, lines: int) -> int:
    """First of the ``FIT_LINES`` lines taken of a text with more."""
    return zlib.crc32(text) % (lines - FIT_LINES + 1) if lines > FIT_LINES else 0


@tidy
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in text_slices(batch):
            texts = _encoded(some.column(1))
            features, length, lines = line_features(texts)
            begins = np.cumsum(lines) - lines
            rows = [(a + k, a + k + min(n, FIT_LINES)) for a, n, k in zip(begins.tolist(), lines.tolist(), map(_window, texts, lines.tolist()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(2), pa.array([features[a:b].astype("<f8").tobytes() for a, b in rows], pa.binary()), pa.array([length[a:b].astype("<i8").tobytes() for a, b in rows], pa.binary())],
                names=["doc_id", "quality", "features", "length"],
            )


def fit_field(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    ``labels`` has ``doc_id, quality`` (0 or 1; other values and nulls are left out, an id's least label counts).
    The held-out fold, ``crc32(doc_id as text) mod 5 = 0``, is never read.  Features are computed where
    the documents are; the driver gets those of ``fit_docs`` documents; of one with more than ``FIT_LINES`` lines,
    those of so many lines in a row, at a place that its text decides.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    # of rows that repeat a drawn id one text counts, so the driver's share stays bounded
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    with small_batches(docs.sparkSession):
        rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(_sample, "doc_id long, quality int, features binary, length binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    features = np.concatenate([np.frombuffer(r["features"], "<f8") for r in rows] or [np.zeros(0)]).reshape(-1, WIDTH)
    length = [np.frombuffer(r["length"], "<i8") for r in rows]
    return fit(features, np.concatenate(length or [np.zeros(0, np.int64)]), np.array([len(x) for x in length], np.int64), np.array([r["quality"] for r in rows], np.float64))


@tidy
def _score(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [field.scores(_encoded(some.column(1))) for some in text_slices(batch)]
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != 1), pa.array(score, pa.float64())], names=[n for i, n in enumerate(batch.schema.names) if i != 1] + ["score"])


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, score`` of every whole text; a null or empty text is one empty line."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, field=field), "doc_id long, score double")


def keep_good(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with its columns, whose text scores ``threshold`` or more."""
    schema = docs.schema

    @tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            good = [field.scores(_encoded(some.column(at))) >= threshold for some in text_slices(batch, at)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(kept, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    A row without an id is not held out.  A null or empty text is scored as one empty line; repeated rows
    and ties are scored each, the same.  An empty table has no rows.
    """
    scored = score_documents(docs, fit_field(docs, labels))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

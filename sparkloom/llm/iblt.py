"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines; a long one is cut further at words chosen by their own digest, so an
edit changes the paragraphs it touches and no others.  A sketch adds each distinct paragraph's digest to
three cells (count, sum of digests, sum of check digests; sums wrap), one in each third.  Thirds have
2, 4, 8, ... cells, the first such that all cells are 2.5 for each digest and the sketch peels by itself;
if it does not, the next size is taken.  So a fingerprint, the sketch as text, can be inverted: peeling
cells that hold a single digest lists its digests.

Two fingerprints are compared by what they hold, never by the texts: sketches of one size subtract cell
by cell, and peeling recovers the digests that only one has.  Of different sizes, the smaller is inverted
and made again in the size of the larger.  If a difference does not peel, both are inverted and made
again twice as large, until it does.  Likeness is ``1 - recovered / (digests of both)``, 1 if there are none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_slices, tidy
from .shingles import mix64, words_in

#: A word whose digest is a multiple of this ends a paragraph, as a line's end does.
STRETCH = 24
#: Cells of a third for each digest at least.
ROOM = 5 / 6
_SEEDS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F], np.uint64)
_CHECK = np.uint64(0x589965CC75374CC3)
#: Sums of check digests count in their low 32 bits, which is what a fingerprint keeps of them.
_LOW = np.uint64(0xFFFFFFFF)
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct stretch digests, text after text; digests of each text)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, begin, _ = words_in(raw)
    n = len(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    line = np.searchsorted(np.flatnonzero(raw == 10), begin)
    cut = np.ones(len(words), bool)
    cut[1:] = (line[1:] != line[:-1]) | (words[:-1] % np.uint64(STRETCH) == 0)
    first = np.flatnonzero(cut)
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    digest = mix64(np.add.reduceat(words * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), first))
    doc = np.searchsorted(ends, begin[first], side="right")
    order = np.lexsort((digest, doc))
    digest, doc = digest[order], doc[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
    digest, doc = digest[new], doc[new]
    return digest, np.bincount(doc, minlength=n)


class Tables:
    """Tables of several documents (or differences), one after the other; ``third`` cells in each third."""

    def __init__(self, third: np.ndarray):
        self.third = third.astype(np.int64)
        self.first = np.cumsum(3 * self.third) - 3 * self.third
        n = int(3 * self.third.sum())
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def cells(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The three cells of each key (3 x keys)."""
        third = self.third[table]
        return np.stack([self.first[table] + j * third + (mix64(keys ^ s) % third.astype(np.uint64)).astype(np.int64) for j, s in enumerate(_SEEDS)])

    def add(self, table: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add keys (sign 1) or take them away (-1); returns the cells touched."""
        at = self.cells(table, keys).ravel()
        times = sign.astype(np.int64)
        np.add.at(self.count, at, np.tile(times, 3))
        np.add.at(self.key, at, np.tile(keys * times.view(np.uint64), 3))
        np.add.at(self.check, at, np.tile(mix64(keys ^ _CHECK) * times.view(np.uint64), 3))
        return at

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.third)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(table, key, sign) of what peels, and whether each table is empty then; the tables are used up."""
        of_cell = np.repeat(np.arange(len(self.third)), 3 * self.third)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.arange(len(self.count))
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            sign = self.count[at]
            keys = self.key[at] * sign.view(np.uint64)
            single = (mix64(keys ^ _CHECK) * sign.view(np.uint64) - self.check[at]) & _LOW == 0
            at, keys, sign = at[single], keys[single], sign[single]
            if not len(at):
                break
            table = of_cell[at]
            order = np.lexsort((keys, table))
            table, keys, sign = table[order], keys[order], sign[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (table[1:] != table[:-1])
            table, keys, sign = table[new], keys[new], sign[new]
            found.append((table, keys, sign))
            at = np.unique(self.add(table, keys, -sign))
        left = (self.count != 0) | (self.key != 0) | (self.check & _LOW != 0)
        empty = np.bincount(of_cell[left], minlength=len(self.third)) == 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        table, keys, sign = (np.concatenate(x) for x in zip(*(found or [none]), strict=True))
        return table, keys, sign, empty

    def some(self, which: np.ndarray) -> Tables:
        """The tables that a mask names."""
        out, cells = Tables(self.third[which]), np.repeat(which, 3 * self.third)
        out.count, out.key, out.check = self.count[cells], self.key[cells], self.check[cells]
        return out

    def size(self) -> np.ndarray:
        """Digests that each table holds."""
        return np.add.reduceat(self.count, self.first) // 3 if len(self.third) else np.zeros(0, np.int64)

    def inverted(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests, how many of each table) of tables that peel by themselves."""
        table, keys, _, _ = self.peel()
        order = np.argsort(table, kind="stable")
        return keys[order], np.bincount(table, minlength=len(self.third))

    def texts(self) -> list[str]:
        """Each table as text."""
        cells = np.zeros(len(self.count), _CELL)
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check & _LOW
        raw, edges = cells.tobytes(), (np.append(self.first, len(cells)) * _CELL.itemsize).tolist()
        return [base64.b64encode(raw[a:b]).decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def tables_of(keys: np.ndarray, counts: np.ndarray, third: np.ndarray) -> Tables:
    """A table for each document's keys."""
    out = Tables(third)
    out.add(np.repeat(np.arange(len(counts)), counts), keys, np.ones(len(keys), np.int64))
    return out


def sketches(keys: np.ndarray, counts: np.ndarray) -> list[str]:
    """The fingerprint of each document: its table in the first size that peels by itself."""
    third = 2 ** np.ceil(np.log2(np.maximum(2, ROOM * counts))).astype(np.int64)
    while True:
        tables = tables_of(keys, counts, third)
        *_, done = tables.some(np.ones(len(third), bool)).peel()
        if done.all():
            return tables.texts()
        third[~done] *= 2


def read_sketches(texts: list[str]) -> Tables:
    """The tables of fingerprints."""
    raw = [base64.b64decode(t) for t in texts]
    cells = np.frombuffer(b"".join(raw), _CELL)
    out = Tables(np.array([len(r) // (3 * _CELL.itemsize) for r in raw], np.int64))
    out.count, out.key, out.check = (cells[n].copy() for n in ("count", "key", "check"))
    out.count, out.check = out.count.astype(np.int64), out.check.astype(np.uint64)
    return out


def _resized(tables: Tables, third: np.ndarray) -> Tables:
    """The same digests in tables of other sizes."""
    return tables_of(*tables.inverted(), third)


def differences(a: list[str], b: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """What only ``a`` and only ``b`` hold, for each pair of fingerprints; digests of both; cells that it took."""
    one, two = read_sketches(a), read_sketches(b)
    n, sizes = len(a), one.size() + two.size()
    third = np.maximum(one.third, two.third)
    for k, t in enumerate((one, two)):
        small = t.third < third
        if small.any():
            keys, counts = t.some(small).inverted()
            per = np.zeros(n, np.int64)
            per[small] = counts
            grown = tables_of(keys, per, third)  # those of full size stay empty here and are put in as they are
            cells, own = np.repeat(~small, 3 * third), np.repeat(~small, 3 * t.third)
            for name in ("count", "key", "check"):
                getattr(grown, name)[cells] = getattr(t, name)[own]
            if k:
                two = grown
            else:
                one = grown
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * n
    cells, todo = 3 * third, np.arange(n)
    while len(todo):
        table, keys, sign, done = one.minus(two).peel()
        order = np.argsort(table, kind="stable")
        table, keys, sign = table[order], keys[order], sign[order]
        edges = np.searchsorted(table, np.arange(len(todo) + 1))
        for k in np.flatnonzero(done).tolist():
            lo, hi = edges[k], edges[k + 1]
            out[todo[k]] = keys[lo:hi][sign[lo:hi] > 0], keys[lo:hi][sign[lo:hi] < 0]
        todo = todo[~done]
        if len(todo):
            cells[todo] *= 2
            one, two = (_resized(t.some(~done), cells[todo] // 3) for t in (one, two))
    return out, sizes, cells


def likeness(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(likeness of each pair of fingerprints, cells at which their difference peeled)."""
    found, sizes, cells = differences(a, b)
    apart = np.array([len(x) + len(y) for x, y in found], np.float64)
    return np.where(sizes > 0, 1 - apart / np.maximum(sizes, 1), 1.0), cells


def edited(text: str, other: str) -> str:
    """``text`` with its last half (floor) of code points replaced by the first as many of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells long, edited_cells long, next_cells long"


def _pairs(ids: list[int | None], texts: list[str], real: np.ndarray) -> pa.RecordBatch:
    """Results of the rows of a mask, each of which the next row follows."""
    at = np.flatnonzero(real).tolist()
    changed = [edited(texts[i], texts[i + 1]).encode() for i in at]
    own = sketches(*paragraph_digests([t.encode() for t in texts]))
    mine, after, new = [own[i] for i in at], [own[i + 1] for i in at], sketches(*paragraph_digests(changed))
    (near_edited, edited_cells), (near_next, next_cells) = likeness(mine, new), likeness(mine, after)
    columns = [
        pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        pa.array(mine, pa.string()), pa.array(new, pa.string()), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64()),
        pa.array(3 * read_sketches(mine).third), pa.array(edited_cells), pa.array(next_cells),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])


@tidy
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, piece, copy) come in order; the row after one, in its piece, is the next document."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    for batch in batches:
        for some in text_slices(batch):
            ids, texts, piece, copy = (h + some.column(i).to_pylist() for i, h in enumerate(held))
            texts = [t or "" for t in texts]
            pieces = np.array(piece)
            real = np.append(pieces[1:] == pieces[:-1], False) & (np.array(copy) == 0)
            if real.any():
                yield _pairs(ids, texts, real)
            held = ids[-1:], texts[-1:], piece[-1:], copy[-1:]


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``: first among every n-th, then between two of those."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    count = lambda values: F.size(F.filter(values, lambda b: b < value))
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.greatest(count(long([p[0] for p in parts])) - 1, F.lit(0))
    return coarse * step + count(F.element_at(F.array(*[long(p) for p in parts]), coarse + 1))


def in_pieces(docs: DataFrame) -> DataFrame:
    """``doc_id, text, piece, copy``: rows in descending doc_id, cut into pieces of about equal size.

    Rows without an id come last; equal ids stand in the order of a hash of their text.  Pieces are cut at
    quantiles of the ids; an id (or none) that many rows have is cut again at quantiles of the hash.  Each
    piece ends with copies (``copy`` 1) of the row that begins the next, the last with the very first, so every
    row's next row follows it.  Numbers that the driver sees depend on the number of pieces alone.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    pieces = 8 * parts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    shares = [k / pieces for k in range(1, pieces)]
    cuts = rows.select(F.percentile_approx("doc_id", shares, 100 * pieces), F.count("*")).first()
    found, total = list(cuts[0] or []), cuts[1]
    # an id that several quantiles fall on gets a piece of its own
    heavy = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    bounds = sorted({*found, *[x - 1 for x in heavy if x > -(1 << 63)]})
    up = _below(bounds, F.col("doc_id"))
    stretch = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - up)
    rows = rows.withColumn("stretch", stretch)
    many = max(1, 2 * total // pieces)
    sizes = rows.groupBy("stretch").agg(F.count("*").alias("n"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("one"), F.percentile_approx("hash", shares, 100 * pieces).alias("q")).where(F.col("one") & (F.col("n") > many))
    inner = {}
    for r in sizes.collect():
        k = min(pieces, -(-r["n"] * pieces // total))
        inner[r["stretch"]] = sorted({r["q"][i * pieces // k - 1] for i in range(1, k)})
    # the number of a piece: those of all stretches before it, then the place of the hash in its own
    first, at = [], 0
    for s in range(len(bounds) + 2):
        first.append(at)
        at += 1 + len(inner.get(s, []))
    part = F.lit(0)
    for s, hashes in inner.items():
        part = F.when(F.col("stretch") == s, _below(hashes, F.col("hash"))).otherwise(part)
    rows = rows.withColumn("piece", (F.element_at(F.array(*[F.lit(x) for x in first]), F.col("stretch") + 1) + part).cast("int"))
    order = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), (-(F.coalesce("doc_id", F.lit(0)) + 1)).alias("down"), F.col("hash"))
    begins = {r["piece"]: r["b"] for r in rows.groupBy("piece").agg(F.min(order).alias("b")).collect()}
    names = sorted(begins)
    before = {p: names[k - 1] for k, p in enumerate(names)}
    array = lambda f: F.element_at(F.array(*[F.lit(f(p)) for p in range(at)]), F.col("piece") + 1)
    leads = (F.col("order_.hash") == array(lambda p: begins[p]["hash"] if p in begins else 0)) & (F.col("order_.down") == array(lambda p: begins[p]["down"] if p in begins else 0))
    leads = leads & (F.col("order_.none") == array(lambda p: begins[p]["none"] if p in begins else 0))
    to = F.when(leads, F.array("piece", array(lambda p: before.get(p, 0)))).otherwise(F.array("piece"))
    rows = rows.withColumn("order_", order)
    rows = rows.select("doc_id", "text", "hash", "order_", F.posexplode(to).alias("copy", "piece")).withColumn("part", F.expr(f"cast(cast(piece as long) * {parts} div {at} as int)"))
    return rows.repartitionById(parts, "part").sortWithinPartitions("piece", "copy", "order_", "text").select("doc_id", "text", "piece", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text (null: empty) and of its edited text, with likenesses.

    ``docs`` has ``doc_id, text``; other columns are not read.  The next document is the one after it in
    :func:`in_pieces`; repeated rows follow one another, and a single row follows itself.  ``cells`` are those of
    the fingerprint, ``edited_cells`` and ``next_cells`` those at which the difference to the edited text and
    the next document peeled.  An empty table has no rows.
    """
    return in_pieces(docs).mapInArrow(_rows, _OUT)

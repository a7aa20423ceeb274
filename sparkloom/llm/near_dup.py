"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

1. Each different shingle set gets a signature of :data:`SLOTS` MinHash values of b = 16 bits.
   Equal sets are one node from here on.
2. Two sets of similarity 0.8 differ in a slot with probability 0.2; more than :data:`ERRORS` of
   the 48 slots differ with probability below 1e-4 (and ever less above 0.8).  That many errors
   are the signature-distance threshold, and every pair within it is found: by pigeonhole one of
   the 11 chunks has at most one error, so a chunk's keys are the chunk with each one slot
   left out, and such a pair shares a key.
3. In each key the document with the least id is the centre.  Documents within the threshold of their
   centre are confirmed on full shingle sets: stars of at most :data:`STAR` documents with a copy of the
   centre, so a large group of near copies costs one comparison a document, and is one class from then on.
   The documents that a key's class does not hold get a centre of their own, and so on.
4. What is left are keys with documents of several classes.  Only pairs of different classes count: the
   documents outside the centre's class are compared with all others of their key, by signature, in parts
   of :data:`KEY_ROWS`; the names of document blocks with a pair within the threshold leave the task, and
   named block pairs get their documents' full sets, all of whose intersections are counted exactly.
5. Components by label propagation with pointer jumping over the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, scratch_scope, small_batches, text_slices, tidy
from .shingles import mix64, shingle_sets

SLOTS = 48
ERRORS = 21
#: Slots of each chunk: 11 chunks, so that 21 errors leave one chunk with at most one.
CHUNKS = (5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4)
#: Rows of a key that one task compares with as many others.
KEY_ROWS = 1024
#: Groups of a key up to which rows are compared side by side with those of other keys.
SMALL_GROUP = 64
#: Documents of a star, and how often a key gets a new centre.
STAR = 512
CENTRES = 2
#: Documents of a block whose sets are compared with another block's, and shingles of all of them, about.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1 << 19
#: Cells of an incidence matrix at once.
CELLS = 1 << 22

_random = np.random.Generator(np.random.PCG64(48))
_A = _random.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def _left_out() -> list[np.ndarray]:
    out, at = [], 0
    for size in CHUNKS:
        slots = np.arange(at, at + size)
        out += [np.delete(slots, j) for j in range(size)]
        at += size
    return out


#: The slots of each key.
KEYS = _left_out()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The b-bit signature of a non-empty set."""
    u = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(u), 4096):
        np.minimum(least, (u[None, k : k + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """A digest for each row and key of ``signatures`` (rows x slots)."""
    wide = signatures.astype(np.uint64)
    out = np.empty((len(wide), len(KEYS)), np.int64)
    for j, slots in enumerate(KEYS):
        packed = np.full(len(wide), j, np.uint64)
        for s in slots:
            packed = (packed << np.uint64(16) | packed >> np.uint64(48)) ^ wide[:, s]
        out[:, j] = mix64(packed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)).view(np.int64)
    return out


@tidy
def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            sets = shingle_sets([(t or "").encode() for t in rows.column(1).to_pylist()], k)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "sig"],
            )


@tidy
def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = batch.slice(at, 4096)
            sigs = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, SLOTS)
            keys = keys_of(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rows.column(0).to_numpy(), len(KEYS)))], names=["key", "id"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            sets = shingle_sets([(t or "").encode() for t in rows.column(1).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``keys`` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            name = tuple(c[a] for c in cols)
            if name != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _pairs_of_blocks(block: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct (lower, higher) blocks of pairs of rows."""
    both = np.stack([np.minimum(block[a], block[b]), np.maximum(block[a], block[b])], axis=1)
    return np.unique(both, axis=0) if len(both) else both


def near_in_large_group(side: np.ndarray, block: np.ndarray, cls: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Blocks of pairs of different classes between sides 0 and 1 (all, where there is one side) within the threshold."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    found = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(left), 256):
        some = left[k : k + 256]
        if len(some) and len(right) and (cls[right] == cls[some[0]]).all() and (cls[some] == cls[some[0]]).all():
            continue
        same = np.zeros((len(some), len(right)), np.uint8)
        for s in range(SLOTS):
            same += sig[some, s][:, None] == sig[right, s][None, :]
        a, b = np.nonzero((same >= SLOTS - ERRORS) & (cls[some][:, None] != cls[right][None, :]))
        found.append(_pairs_of_blocks(block, some[a], right[b]))
    return np.unique(np.concatenate(found), axis=0)


def near_in_small_groups(first: np.ndarray, size: np.ndarray, block: np.ndarray, cls: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The same for many small groups of consecutive rows: each row against the next, the one after, and so on."""
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, int(size.max(initial=0))):
        more = size > step
        n = size[more] - step
        a = np.repeat(first[more] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        a = a[cls[a] != cls[a + step]]
        for k in range(0, len(a), 1 << 15):
            x = a[k : k + (1 << 15)]
            near = x[(sig[x] == sig[x + step]).sum(axis=1, dtype=np.uint8) >= SLOTS - ERRORS]
            found.append(_pairs_of_blocks(block, near, near + step))
    return np.unique(np.concatenate(found), axis=0)


@tidy
def _near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of block pairs with a pair of signatures within the threshold, for rows sorted by (key, i, j)."""
    held: list[np.ndarray] | None = None

    def found(rows: list[np.ndarray], starts: np.ndarray, end: int) -> pa.RecordBatch:
        _, _, _, side, block, cls, sig = rows
        size = np.diff(np.append(starts, end))
        small = (size <= SMALL_GROUP) & (np.add.reduceat(side[:end], starts) == 0)
        pairs = [near_in_small_groups(starts[small], size[small], block, cls, sig)]
        for a, n in zip(starts[~small].tolist(), size[~small].tolist(), strict=True):
            pairs.append(near_in_large_group(side[a : a + n], block[a : a + n], cls[a : a + n], sig[a : a + n]))
        out = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
        rows.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u2").reshape(-1, SLOTS))
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        key, i, j = rows[:3]
        starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1)
        if len(starts) > 1:  # the last group may go on in the next batch
            yield found(rows, starts[:-1], int(starts[-1]))
        held = [x[starts[-1] :] for x in rows]
    if held is not None:
        yield found(held, np.zeros(1, np.int64), len(held[0]))


def _near(a: np.ndarray, b: np.ndarray, percent: int | None) -> bool:
    if percent is None:
        return np.count_nonzero(a == b) >= SLOTS - ERRORS
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(batches: Iterator[pa.RecordBatch], percent: int | None) -> Iterator[pa.RecordBatch]:
    """(id, centre) of members near their centre, which comes first in rows (centre, part, member, id, value).

    Values are signatures, to be within the threshold, or (with ``percent``) sets, to link.
    """
    now, own, opened = None, [], False  # a centre's values: more than one where rows repeat its id
    for batch in batches:
        out: list[tuple[int, int]] = []
        for centre, part, member, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            value = np.frombuffer(raw.as_py(), "<u2" if percent is None else np.uint64)
            if not member:
                own = [*own, value] if opened and now == (centre, part) else [value]
                now, opened = (centre, part), True
                continue
            opened = False
            if now == (centre, part) and any(_near(x, value, percent) for x in own):
                out.append((doc, centre))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])


def _near_centres(pairs: DataFrame, centres: DataFrame, values: DataFrame, percent: int | None) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (id, centre, part) that are near; ``centres`` (centre, parts), ``values`` (id, value)."""
    members = pairs.join(values, "id").select("centre", "part", F.lit(1).alias("member"), "id", "value")
    heads = centres.join(values.withColumnRenamed("id", "centre"), "centre").select("centre", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("member"), F.col("centre").alias("id"), "value")
    rows = members.unionByName(heads).repartition("centre", "part").sortWithinPartitions("centre", "part", "member")
    return rows.mapInArrow(tidy(partial(_stars, percent=percent)), "u long, v long")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    out = np.zeros((len(left), len(right)), np.float64)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    rows_a, rows_b = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    if not len(common):
        return out.astype(np.int64)
    in_a, in_b = common[np.minimum(at_a, len(common) - 1)] == a, common[np.minimum(at_b, len(common) - 1)] == b
    rows_a, at_a, rows_b, at_b = rows_a[in_a], at_a[in_a], rows_b[in_b], at_b[in_b]
    step = max(64, CELLS // max(len(left), len(right)))
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    rows_a, at_a, rows_b, at_b = rows_a[order_a], at_a[order_a], rows_b[order_b], at_b[order_b]
    for k in range(0, len(common), step):
        width = min(step, len(common) - k)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        lo, hi = np.searchsorted(at_a, (k, k + width))
        x[rows_a[lo:hi], at_a[lo:hi] - k] = 1
        lo, hi = np.searchsorted(at_b, (k, k + width))
        y[rows_b[lo:hi], at_b[lo:hi] - k] = 1
        out += x @ y.T
    return out.astype(np.int64)


@tidy
def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each block pair's links, confirmed on full sets."""
    us: list[int] = []
    vs: list[int] = []
    for (a, b), rows in _groups(batches, 2):
        ids = rows.column("id").to_pylist()
        block = rows.column("block").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        left = np.flatnonzero(block == a).tolist()
        right = left if a == b else np.flatnonzero(block == b).tolist()
        if not left or not right:
            continue
        size = np.array([len(s) for s in sets], np.int64)
        both = intersections([sets[x] for x in left], [sets[x] for x in right])
        union = size[left][:, None] + size[right][None, :] - both
        x, y = np.nonzero(100 * both >= percent * union)
        root = {n: n for n in (*left, *right)}

        def find(n: int, root=root) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            m, n = left[p], right[q]
            if m != n and (r := find(m)) != (s := find(n)):
                root[max(r, s)] = min(r, s)
                us.append(ids[m])
                vs.append(ids[n])
        if len(us) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us, vs = [], []
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``links`` (u, v): the smallest id reachable.

    Each round takes the least label among neighbours and then the label's own label, so long chains
    shorten by more than half; every round's table is written to the shared folder.
    """
    both = materialize(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = materialize(low.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        if new.where("component < was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Rows link when ``100 * intersection >= percent * union`` of their ``k``-word shingle sets; a
    component is named by its smallest doc_id, whose row is kept.  Null and empty texts, and rows
    without an id, link with nothing (component: their own id, kept).  Rows that repeat an id have the
    same component if their texts are alike; other columns are not read.  ``percent`` below 80 would
    need more errors than the signatures allow and is refused.
    """
    if percent < 80:
        raise ValueError("signatures guarantee similarities of 0.8 or more")
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, percent)


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    signed = materialize(texts.mapInArrow(partial(_sign, k=k), "doc_id long, text_key long, n_shingles long, digest binary, sig binary"), "signatures")
    nodes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = materialize(nodes, "nodes")
    with scratch_scope() as made:
        found = materialize(_components_of(docs, nodes, k, percent), "components")
    drop_scratch(spark, [p for p in made if "sparkloom-components-" not in p])
    named = nodes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("of_set"))
    out = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("of_set", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id, shingles`` of the documents of ``ids``; of rows that repeat an id each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.select("id").distinct(), "id", "left_semi")
    return texts.mapInArrow(partial(_sets, k=k), "id long, shingles binary")


def _components_of(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, component`` of all linked nodes (id, sig, n)."""
    spark = docs.sparkSession
    sigs = nodes.select("id", F.col("sig").alias("value"))
    rows = nodes.select("id", "sig").mapInArrow(_key_rows, "key long, id long")
    rows = materialize(rows, "key-rows")
    # keys are counted by partial sums, so the rows of a hot key never meet
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    shared = materialize(rows.join(counts, "key").withColumns({"class": F.col("id"), "centre": F.col("first")}), "keys")
    links = spark.createDataFrame([], "u long, v long")
    found = spark.createDataFrame([], "id long, component long")
    for turn in range(CENTRES):
        # n rows of a key make n / STAR parts, each with a copy of the centre
        parts = F.ceil(F.col("n") / STAR).cast("int")
        todo = shared.where("centre is not null and id <> centre").withColumn("parts", parts)
        pairs = todo.groupBy("id", "centre").agg(F.max("parts").alias("parts")).select("id", "centre", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        pairs = materialize(pairs, "pairs")
        centres = todo.groupBy("centre").agg(F.max("parts").alias("parts"))
        near = materialize(_near_centres(pairs, centres, sigs, None).withColumnsRenamed({"u": "id", "v": "centre"}).join(pairs, ["id", "centre"]), "near")
        sets = _sets_of(docs, near.select("id").unionByName(near.select(F.col("centre").alias("id"))), k)
        sets = materialize(sets.withColumnRenamed("shingles", "value"), "star-sets")
        heads = near.groupBy("centre").agg((F.max("part") + 1).alias("parts"))
        links = materialize(links.unionByName(_near_centres(near, heads, sets, percent)), "links")
        found = materialize(components(links), "classes")
        shared = shared.drop("class", "centre").join(found.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
        shared = materialize(shared, "classed")
        # keys with one class are done; of the others those outside the first's class get the next centre
        per = shared.groupBy("key").agg(F.min(F.struct("id", "class")).alias("f"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high and f is not null").select("key", F.col("f.class").alias("main"))
        shared = shared.drop("main", "outside").join(per, "key").withColumn("outside", F.col("class") != F.col("main"))
        shared = materialize(shared, "open-keys")
        if shared.isEmpty():
            return found
        if turn + 1 < CENTRES:
            next_ = shared.where("outside").groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("strays"))
            shared = shared.join(next_, "key").withColumn("centre", F.when(F.col("outside"), F.col("centre"))).drop("strays")
    forests = _links_across(docs, nodes, shared, k, percent)
    return components(materialize(links.unionByName(forests), "forests"))


def _links_across(docs: DataFrame, nodes: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different classes of rows that share a key: ``key, id, first, class, outside``."""
    counts = shared.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("strays"))
    rows = shared.select("key", "id", "first", "class", "outside").join(counts, "key")
    # documents that meet in keys stand in blocks: by the id that leads most of their keys, then by hash
    lead = rows.groupBy("id", "first").agg(F.count("*").alias("times")).groupBy("id").agg(F.max_by("first", F.struct("times", -F.col("first"))).alias("lead")).join(nodes.select("id", "n", "sig"), "id")
    lead = materialize(lead, "leads")
    size = lead.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    block = materialize(lead.join(size, "lead").select("id", F.xxhash64("lead", F.pmod(F.xxhash64("id"), "parts")).alias("block"), "sig"), "blocks")
    # a small key is one group; of a large one each part of all rows meets each part of the strays
    split = F.col("n") > KEY_ROWS
    own = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / KEY_ROWS)).cast("int")
    rows = rows.withColumns({"parts": F.ceil(F.col("n") / KEY_ROWS).cast("int"), "others": F.ceil(F.col("strays") / KEY_ROWS).cast("int"), "own": F.when(split, own).otherwise(0)})
    rows = rows.withColumn("stray_part", F.pmod(F.xxhash64("id", F.lit(1)), "others").cast("int"))
    small = rows.where(~split).select("key", "id", "class", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    large = rows.where(split)
    left = large.select("key", "id", "class", F.col("own").alias("i"), F.explode(F.expr("sequence(0, others - 1)")).alias("j"), F.lit(0).alias("side"))
    right = large.where("outside").select("key", "id", "class", F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), F.col("stray_part").alias("j"), F.lit(1).alias("side"))
    near = (
        small.unionByName(left).unionByName(right).join(block, "id")
        .select("key", "i", "j", "side", "block", "class", "sig")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInArrow(_near_blocks, "a long, b long").distinct()
    )
    near = materialize(near, "block-pairs")
    wanted = near.select(F.col("a").alias("block")).unionByName(near.select(F.col("b").alias("block"))).distinct()
    members = materialize(block.select("id", "block").join(wanted, "block", "left_semi"), "members")
    sets = materialize(_sets_of(docs, members, k).join(members, "id"), "sets")
    in_pairs = near.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return (
        in_pairs.join(sets, "block")
        .select("a", "b", "block", "id", "shingles")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b")
        .mapInArrow(partial(_links, percent=percent), "u long, v long")
    )


def text_key():
    """A digest of ``text``; 0 for null."""
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, with its columns, for each near-duplicate component.

    It is the row with the smallest doc_id; of rows equal in id and text one stays.  Rows without an id
    stay unless they repeat another one's text.
    """
    columns = docs.columns
    # null ids stand under a number with a mark of their own, so that plain equality joins them
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")
    kept = near_duplicates(docs, k, percent).where("kept").select(id_, F.col("doc_id").isNull().alias("no_id"), "text_key")
    rows = docs.select(id_, F.col("doc_id").isNull().alias("no_id"), text_key().alias("text_key"), F.struct("*").alias("doc"))
    found = rows.join(kept.distinct(), ["id", "no_id", "text_key"], "left_semi").groupBy("id", "no_id", "text_key").agg(F.first("doc").alias("doc"))
    return found.select(*[F.col(f"doc.`{c}`").alias(c) for c in columns])

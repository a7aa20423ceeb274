"""Mixing sources to target weights with a low-discrepancy slot schedule.

Documents of a source stand in a shuffled order (by a seeded digest) on a line of words, which
is read twice at most.  The line is cut into blocks of equal size.  Slot ``i`` of the mix takes
the golden-ratio point ``frac(i / phi)`` through the cumulative target weights to a source, and
the slot's rank within its source says which block it takes.  Because such points cover every
interval evenly, any stretch of the mix holds the sources near their weights.  Slots beyond a
source's target are void, and the few blocks that the points leave over follow at the end, so
each source's total is its target exactly (whole words).  A document's place in the mix is the
slot of its first block; the mixed rows are filed by it.

Everything that grows (documents, slots, sources) is a table: running sums over ranges
(:func:`.common.running`) take the place of windows, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, running, shuffle_partitions

#: Words of a block.
BLOCK = 256
#: Points are whole numbers below this; the step is that much divided by the golden ratio.
CIRCLE = 1 << 62
GOLDEN = 2850178704830799621
_WIDE = "decimal(38,0)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``source, queue, source_size, start, weight, target, give, needs, give_before, needs_before, dense`` of ``source, source_size``.

    ``share`` of all sizes is dealt by weight (sources by code point, null last, weigh ``weights`` in
    turn); a target stops at ``most`` times its source's size, and the excess is dealt again by weight
    to the others until none is above.  Taken by size over weight, a source is capped if its part of
    what the capped ones before it leave would be too much, so two running sums tell all targets.
    ``give`` is the target in whole words; ``start`` and the ``_before`` columns are sums over earlier queues;
    ``dense`` numbers the queues that give anything.
    """
    queues = running(sizes, [F.col("source").asc_nulls_last()], {"queue": F.lit(1), "start": F.col("source_size")}, "mix-queues")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("queue") % len(weights) + 1).cast("int")).cast("long")
    queues = queues.withColumn("weight", turn)
    total, weight = queues.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return queues.select("*", F.lit(0.0).alias("target"), *[F.lit(0).cast("long").alias(c) for c in ("give", "needs", "give_before", "needs_before", "dense")])
    a, b = share
    wide = lambda c: c.cast(_WIDE)
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("queue").asc()]
    ranked = running(queues, order, {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, "mix-ranks")
    left = wide(F.lit(a * total)) - wide(b * most * F.col("size_before"))
    full = wide(b * most * F.col("source_size"))
    ranked = ranked.withColumn("capped", wide(F.col("weight")) * left >= full * wide(F.lit(weight) - F.col("weight_before")))
    capped, open_weight = ranked.agg(F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)), F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0))).first()
    part = wide(F.col("weight")) * wide(F.lit(a * total - b * most * capped))
    ranked = ranked.withColumn("give", F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.expr(f"cast(weight as {_WIDE}) * cast({a * total - b * most * capped} as {_WIDE}) div cast({max(1, b * open_weight)} as {_WIDE})")))
    ranked = ranked.withColumn("target", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(part.cast("double") / F.lit(float(max(1, b * open_weight)))))
    ranked = ranked.withColumn("needs", F.expr(f"(give + {BLOCK - 1}) div {BLOCK}")).drop("size_before", "weight_before", "capped")
    sums = {"give_before": F.col("give"), "needs_before": F.col("needs"), "dense": (F.col("give") > 0).cast("long")}
    return running(ranked, [F.col("queue").asc()], sums, "mix-targets")


def slots(queues: DataFrame) -> DataFrame:
    """``queue, block, slot`` for every block of every queue (of :func:`targets`): the schedule.

    Points and the starts of the queues' intervals are sorted together, and the starts before a point
    say whose it is; sorted by queue and slot, a slot's place among its queue's is its rank.
    """
    spark = queues.sparkSession
    some = queues.where("give > 0")
    n, total = some.agg(F.coalesce(F.sum("needs"), F.lit(0)), F.coalesce(F.sum("give"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "queue long, block long, slot long")
    dense = some.select("dense", "queue", "needs", "needs_before", F.expr(f"cast(give_before as {_WIDE}) * {CIRCLE} div cast({total} as {_WIDE})").alias("point"))
    point = F.expr(f"cast(pmod(cast(id + 1 as {_WIDE}) * cast({GOLDEN} as decimal(20,0)), cast({CIRCLE} as {_WIDE})) as bigint)")
    points = spark.range(n).select(point.alias("point"), F.lit(1).alias("kind"), F.col("id").alias("slot"))
    both = points.unionByName(dense.select("point", F.lit(0).alias("kind"), F.col("dense").alias("slot")))
    seen = running(both, [F.col("point").asc(), F.col("kind").asc(), F.col("slot").asc()], {"seen": 1 - F.col("kind")}, "mix-points")
    dealt = seen.where("kind = 1").select((F.col("seen") - 1).alias("dense"), "slot")
    ranked = running(dealt, [F.col("dense").asc(), F.col("slot").asc()], {"nth": F.lit(1)}, "mix-slots")
    per = ranked.groupBy("dense").agg(F.min("nth").alias("first"), F.count("*").alias("given"))
    placed = ranked.join(per, "dense").join(dense, "dense").withColumn("block", F.col("nth") - F.col("first")).where("block < needs").select("queue", "block", "slot")
    rest = (
        dense.join(per, "dense", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < needs")
        .select("queue", "needs_before", F.explode(F.expr("sequence(given, needs - 1)")).alias("block"))
        .select("queue", "block", (F.lit(n) + F.col("needs_before") + F.col("block")).alias("slot"))
    )
    return placed.unionByName(rest)


class Mix:
    """The plan of one mix: ``docs`` (one row a document, with its place), ``queues`` (targets) and ``rows``.

    ``rows`` (only when asked for) has each document under its ``row`` number, as the struct ``doc``.
    """

    def __init__(self, docs: DataFrame, queues: DataFrame, rows: DataFrame | None = None):
        self.docs, self.queues, self.rows = docs, queues, rows

    def pieces(self) -> DataFrame:
        """``row, doc_id, queue, epoch, start_word, n_words, block, slot``: what each slot takes of each document."""
        spans = (
            self.docs.where("size > 0")
            .select("row", "doc_id", "queue", "size", "give", F.posexplode(F.expr("array(place, place + source_size)")).alias("epoch", "low"))
            .withColumn("high", F.least(F.col("low") + F.col("size"), F.col("give")))
            .where("high > low")
        )
        cut = spans.select("*", F.explode(F.expr(f"sequence(low div {BLOCK}, (high - 1) div {BLOCK})")).alias("block"))
        return cut.join(slots(self.queues), ["queue", "block"]).select(
            "row", "doc_id", "queue", "epoch",
            (F.greatest("low", F.col("block") * BLOCK) - F.col("low")).alias("start_word"),
            (F.least("high", (F.col("block") + 1) * BLOCK) - F.greatest("low", F.col("block") * BLOCK)).alias("n_words"),
            "block", "slot",
        )

    def stretches(self) -> DataFrame:
        """``row, epoch, start_word, n_words, first_slot, slots``: the pieces of one reading of a document together."""
        return self.pieces().groupBy("row", "epoch").agg(
            F.min("start_word").cast("long").alias("start_word"), F.sum("n_words").cast("long").alias("n_words"), F.min("slot").alias("first_slot"), F.count("*").alias("slots")
        )


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", keep_rows: bool = False) -> Mix:
    """Sizes, targets and shuffled places of all documents.

    ``docs`` has ``doc_id, text, source``.  A document's size is its number of words (null text: 0);
    documents without words take no place.  The shuffled order is that of ``md5(seed-doc_id)``, then
    doc_id, size, row; equal rows are equal.  Other columns are not read, unless rows are kept.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("row"),
            F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
            *([F.struct("*").alias("doc")] if keep_rows else []),
        ),
        "mix-sizes",
    )
    queues = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("row").asc()]
    lined = running(sized.select("row", "doc_id", "source", "size", "key"), order, {"before": F.col("size")}, "mix-places").alias("l")
    placed = lined.join(queues.alias("q"), F.col("l.source").eqNullSafe(F.col("q.source")))
    return Mix(placed.select("row", "doc_id", "q.source", "queue", "size", "source_size", "target", "give", (F.col("before") - F.col("start")).alias("place")), queues, sized.select("row", "doc") if keep_rows else None)


def taken(mix: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot, slots`` of every document.

    ``taken`` counts repeats; ``first_slot`` is the document's place in the mix (null: not taken) and
    ``slots`` the number of slots that take from it.
    """
    got = mix.stretches().groupBy("row").agg(F.sum("n_words").alias("got"), F.min("first_slot").alias("first_slot"), F.sum("slots").alias("slots"))
    counts = [F.coalesce(c, F.lit(0)).cast("long") for c in ("got", "slots")]
    return mix.docs.join(got, "row", "left").select("doc_id", "size", "source_size", "target", counts[0].alias("taken"), "first_slot", counts[1].alias("slots"))


def mixed_documents(docs: DataFrame, **plan) -> DataFrame:
    """The mix as rows of ``docs`` with its columns, filed by slot; each reading of a document is a row.

    A stretch that is the whole document keeps its text; the last document of a source is cut to the
    words taken from it, a space between them.  ``n_chars``, if there, is counted again.  Documents not
    taken go.  Partition ``k`` of ``n`` holds that part of the schedule, in the order of slots, so files
    read one after the other give the sources near their weights at every point.
    """
    columns, parts = docs.columns, shuffle_partitions(docs.sparkSession)
    mix = plan_mix(docs, keep_rows=True, **plan)
    spans = materialize(mix.docs.select("row", "size").join(mix.stretches(), "row"), "mix-stretches")
    end = (spans.agg(F.max("first_slot")).first()[0] or 0) + 1
    got = mix.rows.join(spans, "row").withColumn("file", F.expr(f"cast(cast(first_slot as {_WIDE}) * {parts} div {end} as int)"))
    got = got.repartitionById(parts, "file").sortWithinPartitions("first_slot", "row", "epoch")
    words = F.regexp_extract_all("doc.text", F.lit(f"({WORD_PATTERN})"), F.lit(1))
    part = (F.col("start_word") > 0) | (F.col("n_words") < F.col("size"))
    text = F.when(part, F.array_join(F.slice(words, (F.col("start_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")).otherwise(F.col("doc.text"))
    out = {c: F.col(f"doc.`{c}`") for c in columns}
    out["text"] = text
    if "n_chars" in columns:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return got.select(*[c.alias(n) for n, c in out.items()])

"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript comes in parts of lines, with speaker markers of any style or none.  Hidden states are a
role and whether the line begins a turn.  A line is seen as its marker class and a few features;
tables of both, and of transitions, are counted from transcripts with known roles.  Viterbi runs in
blocks of a conversation: each block gives the best score from each state before it to each of its
last states (a max-plus matrix), the matrices of a conversation are joined in order, and with its
outer states known each block is decoded on its own.  So one conversation may fill many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

ROLES = ("system", "user", "assistant")
#: State 2r: role r begins a turn on this line; state 2r + 1: it goes on.
STATES = 2 * len(ROLES)
#: Parts of a conversation that are decoded together.
PARTS = 64
MARKERS = ("none", *ROLES, "named")
_WORDS = {
    "system": "system|sys|instruction|instructions|context",
    "user": "user|human|you|customer|q|question|prompt|me|client",
    "assistant": "assistant|ai|bot|model|agent|a|answer|response|support|gpt",
}
#: A speaker marker at the start of a line: <|role|>, [role], **role:**, ### role, role:, role>
_MARK = re.compile(r"\s*(?:<\|?(\w{1,24})\|?>|\[(\w{1,24})\]:?|\*\*(\w{1,24}):?\*\*:?|#{1,6}\s*(\w{1,24}):?(?=\s*$|\s)|(\w{1,24})\s?[:>](?=\s|$))\s*", re.ASCII)
_ROLE_OF = {w: r for r, words in _WORDS.items() for w in words.split("|")}
#: Line features beside the marker: 4 lengths x question or not x after an empty line or not.
FEATURES = 16
SYMBOLS = len(MARKERS) * FEATURES


def read_line(line: str) -> tuple[int, str, int]:
    """(marker class, text without the marker, length class and question as 0 to 7)."""
    m = _MARK.match(line)
    kind = 0
    if m:
        name = next(g for g in m.groups() if g is not None).lower()
        role = _ROLE_OF.get(name)
        plain = m.group(5) is not None
        if role:
            kind = 1 + ROLES.index(role)
        elif not (plain and not m.group(5)[:1].isupper()):
            kind = len(MARKERS) - 1
        else:
            m = None
    text = line[m.end() :] if m and kind and kind < len(MARKERS) - 1 else line
    n = len(text)
    return kind, text, 2 * (0 if not n else 1 if n < 60 else 2 if n < 240 else 3) + text.rstrip().endswith("?")


def symbols(lines: list[tuple[int, str, int]]) -> np.ndarray:
    """Observed symbols of the lines of one part."""
    out, gap = [], False
    for kind, text, shape in lines:
        out.append(kind * FEATURES + 2 * shape + gap)
        gap = not text and not kind
    return np.array(out, np.int64)


class Model:
    """Log tables: first state, transitions, emissions."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.first, self.step, self.emit = first, step, emit


def count(rows: Iterator[tuple]) -> dict[tuple[str, int, int], int]:
    """Counts over rows ``(group, opening, role, text)`` that come in order: (table, row, column) -> times.

    Tables: ``first`` (state), ``ends`` (state, whether the next line begins a turn), ``nexts`` (role, next role),
    ``kinds`` (state, marker class) and ``shapes`` (state, features).
    """
    out: dict[tuple[str, int, int], int] = {}
    group, before = None, None
    for own, opening, role, text in rows:
        if own != group:
            group, before = own, None
        elif role in ROLES:
            opening = False
        if role not in ROLES:
            continue
        for i, s in enumerate(symbols([read_line(x) for x in (text or "").split("\n")]).tolist()):
            state = 2 * ROLES.index(role) + (i > 0)
            found = [("kinds", state, s // FEATURES), ("shapes", state, s % FEATURES)]
            if before is not None:
                found.append(("ends", before, int(i == 0)))
                if not i:
                    found.append(("nexts", before // 2, state // 2))
            elif opening:
                found.append(("first", state, 0))
            for key in found:
                out[key] = out.get(key, 0) + 1
            before = state
    return out


def tables(counts: dict[tuple[str, int, int], int]) -> Model:
    """The model of such counts, smoothed; no counts give even tables."""
    first, ends, nexts, kinds, shapes = np.full(STATES, 0.1), np.ones((STATES, 2)), np.full((len(ROLES), len(ROLES)), 0.5), np.full((STATES, len(MARKERS)), 0.005), np.full((STATES, FEATURES), 0.01)
    first[1::2] = 1e-6
    for r in range(len(ROLES)):  # what a state that is rarely seen is taken for: its own marker, inner lines without one
        kinds[2 * r, [0, 1 + r]] += 2, 8
        kinds[2 * r + 1, 0] += 10
    named = {"first": first[:, None], "ends": ends, "nexts": nexts, "kinds": kinds, "shapes": shapes}
    for (name, row, column), n in counts.items():
        named[name][row, column] += n
    # a turn ends or goes on by its state; who speaks next is a matter of roles alone
    ends, nexts = ends / ends.sum(axis=1, keepdims=True), nexts / nexts.sum(axis=1, keepdims=True)
    step = np.zeros((STATES, STATES))
    for a in range(STATES):
        step[a, ::2] = ends[a, 1] * nexts[a // 2]
        step[a, a // 2 * 2 + 1] = ends[a, 0]
    shapes = shapes + 8 * shapes.sum(axis=0) / shapes.sum()
    with np.errstate(divide="ignore"):
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        emit = (log(kinds)[:, :, None] + log(shapes)[:, None, :]).reshape(STATES, SYMBOLS)
        return Model(log(first), log(step), emit)


def transfer(model: Model, sym: np.ndarray, opening: bool) -> np.ndarray:
    """Best log score from each state before a block (row) to each state of its last line.

    The block that opens a conversation has the same row for all states before it.
    """
    score = np.tile(model.first + model.emit[:, sym[0]], (STATES, 1)) if opening else model.step + model.emit[:, sym[0]]
    for s in sym[1:]:
        score = (score[:, :, None] + model.step[None]).max(axis=1) + model.emit[:, s]
    return score


def viterbi(model: Model, sym: np.ndarray, entry: int | None, end: int | None) -> np.ndarray:
    """The best states of a block, given the state before it (None: opening) and its last (None: free).  Ties: lowest state."""
    score = (model.first if entry is None else model.step[entry]) + model.emit[:, sym[0]]
    back = np.zeros((len(sym), STATES), np.int64)
    for i, s in enumerate(sym[1:], 1):
        all_ = score[:, None] + model.step
        back[i] = all_.argmax(axis=0)
        score = all_.max(axis=0) + model.emit[:, s]
    out = np.empty(len(sym), np.int64)
    out[-1] = int(score.argmax()) if end is None else end
    for i in range(len(sym) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def join_blocks(matrices: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """(state before, last state) of each block of a conversation, from the blocks' matrices in order."""
    best = matrices[0][0]
    back = []
    for m in matrices[1:]:
        all_ = best[:, None] + m
        back.append(all_.argmax(axis=0))
        best = all_.max(axis=0)
    last = [int(best.argmax())]
    for b in back[::-1]:
        last.append(int(b[last[-1]]))
    last.reverse()
    return list(zip([None, *last[:-1]], last, strict=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, which come sorted by them."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _some(rows: Iterator[tuple], schema: pa.Schema, n: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= n:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _lines(block: list[tuple]) -> tuple[list[tuple[int, str, int]], list[int], np.ndarray]:
    """Lines, their parts and their symbols of rows (conv, no_id, block, part, text, ...)."""
    lines, part, sym = [], [], []
    for row in block:
        own = [read_line(x) for x in (row[4] or "").split("\n")]
        lines += own
        part += [row[3]] * len(own)
        sym.append(symbols(own))
    return lines, part, np.concatenate(sym)


_MATRIX = pa.schema([("conv", pa.int64()), ("no_id", pa.bool_()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))])
_ENDS = pa.schema([("conv", pa.int64()), ("no_id", pa.bool_()), ("block", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())])
_COUNTS = pa.schema([("name", pa.string()), ("row", pa.int32()), ("column", pa.int32()), ("n", pa.int64())])
_TURN = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("piece", pa.int32()), ("first_part", pa.int64()), ("last_part", pa.int64()), ("begins", pa.bool_()), ("role", pa.string()), ("text", pa.string())])
_TURNS = "conv_id long, block long, piece int, first_part long, last_part long, begins boolean, role string, text string"


@tidy
def _summaries(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    yield from _some(((*b[0][:3], transfer(model, _lines(b)[2], b[0][5]).ravel().tolist()) for b in _groups(batches, 3)), _MATRIX)


@tidy
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv in _groups(batches, 2):
            ends = join_blocks([np.array(m).reshape(STATES, STATES) for *_, m in conv])
            yield from ((c, none, b, -1 if entry is None else entry, last) for (c, none, b, _), (entry, last) in zip(conv, ends, strict=True))

    yield from _some(rows(), _ENDS)


def _turns(block: list[tuple], model: Model) -> Iterator[tuple]:
    lines, part, sym = _lines(block)
    conv, no_id, number, _, _, _, entry, last = block[0]
    states = viterbi(model, sym, None if entry < 0 else entry, last)
    starts = [i for i in range(len(states)) if not i or states[i] % 2 == 0]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(states)], strict=True)):
        role, begins = ROLES[states[a] // 2], bool(states[a] % 2 == 0)
        body = "\n".join(lines[i][1] for i in range(a, b)).strip("\n")
        yield None if no_id else conv, number, k, part[a], part[b - 1], begins, role, (f"<|{role}|>\n" if begins else "") + body + "\n<|end|>"


@tidy
def _decoded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    yield from _some((turn for block in _groups(batches, 3) for turn in _turns(block, model)), _TURN)


def parse(parts: DataFrame, model: Model) -> DataFrame:
    """Turns of transcripts ``conv_id, part, text``, recovered and rendered; one row a turn.

    ``part`` orders a conversation's parts (null first; equal ones by their text).  A null or empty text is
    one empty line; rows without conv_id are one conversation; an empty table has no turns.  ``begins`` is
    false where a block's first line goes on with the turn before it (its text then has no opening tag).
    """
    named = parts.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("part").cast("long"), F.lit(-1)).alias("part"), "text")
    # blocks are stretches of part numbers, so that no order over a whole conversation is needed
    rows = named.withColumn("block", F.floor(F.col("part") / PARTS))
    firsts = rows.groupBy("conv", "no_id").agg(F.min("block").alias("first_block"))
    rows = rows.join(firsts, ["conv", "no_id"]).withColumn("opening", F.col("block") == F.col("first_block")).drop("first_block")
    columns = ["conv", "no_id", "block", "part", "text", "opening"]
    together = lambda df, *more: df.select(*columns, *more).repartition("conv", "no_id", "block").sortWithinPartitions("conv", "no_id", "block", "part", "text")
    placed = materialize(rows.select(*columns), "chat-parts")
    matrices = together(placed).mapInArrow(partial(_summaries, model=model), "conv long, no_id boolean, block long, matrix array<double>")
    ends = matrices.repartition("conv", "no_id").sortWithinPartitions("conv", "no_id", "block").mapInArrow(_joined, "conv long, no_id boolean, block long, entry int, last int")
    return together(placed.join(ends, ["conv", "no_id", "block"]), "entry", "last").mapInArrow(partial(_decoded, model=model), _TURNS)


#: Marker styles for transcripts made from rows with roles: {role} and {Role}.
STYLES = ("{Role}: ", "### {Role}\n", "<|{role}|>", "**{Role}:** ", "[{role}] ")


def transcripts(conversations: DataFrame, every: int = 6) -> DataFrame:
    """``conv_id, part, role, text``: turns with markers in a style of their conversation.

    Every ``every``-th turn by hash has no marker, so that only its neighbours and lines tell its role.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    capital = F.initcap("role")
    marked = F.lit("")
    for k, s in enumerate(STYLES):
        text = F.concat(*[capital if p == "{Role}" else F.col("role") if p == "{role}" else F.lit(p) for p in re.split(r"(\{\w+\})", s) if p])
        marked = F.when(style == k, text).otherwise(marked)
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(every)) == 0) | F.col("role").isNull()
    return conversations.select("conv_id", F.col("turn").alias("part"), "role", F.concat(F.when(bare, F.lit("")).otherwise(marked), F.coalesce("text", F.lit(""))).alias("text"))


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (((conv, block), opening, role, text) for b in batches for conv, block, opening, role, text in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True))
    yield _batch([(*key, n) for key, n in count(rows).items()], _COUNTS)


def held_out(conv_id: Column) -> Column:
    """Whether the tables are not counted on a conversation: a fifth of them, by the id's crc32."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % 5 == 0, F.lit(True))


def fit_model(parts: DataFrame) -> Model:
    """The tables, from all transcripts with roles (``conv_id, part, role, text``) that are not held out.

    Lines are counted where they are, in stretches of :data:`PARTS` parts; the driver gets the summed tables,
    whose size is fixed.  A turn is not followed from one stretch to the next.
    """
    rows = parts.where(~held_out(F.col("conv_id"))).select("conv_id", F.coalesce(F.col("part").cast("long"), F.lit(-1)).alias("part"), "role", "text")
    rows = rows.withColumn("block", F.floor(F.col("part") / PARTS))
    firsts = rows.groupBy("conv_id").agg(F.min("block").alias("first_block"))
    rows = rows.join(firsts, "conv_id").select("conv_id", "block", (F.col("block") == F.col("first_block")).alias("opening"), "role", "text", "part")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "text")
    found = rows.mapInArrow(_counted, "name string, row int, column int, n long").groupBy("name", "row", "column").agg(F.sum("n").alias("n"))
    return tables({(r["name"], r["row"], r["column"]): r["n"] for r in found.collect()})

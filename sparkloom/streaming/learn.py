"""Online learning: weights carried from chunk to chunk of a stream.

Order is the chunk id; an update is visible at the next chunk.  Streams (field, mode, policy) are
independent and run in parallel; within one the fold is sequential by nature.  The fold corrects the
last layer from the relative error of the measured cost terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predict import Weights, encode_inputs, hidden, outputs

KEYS = ["field_id", "mode", "policy"]
#: Outputs that learn: compression time, decompression time, ratio and PSNR.
LEARNED = 4
# fixed values: noise gate, error clamp, momentum, step range and gain, weight clamp, gradient clip
GATE, ERROR_CLAMP, MOMENTUM, STEP_LOW, STEP_HIGH, STEP_GAIN, WEIGHT_CLAMP, CLIP = 0.10, 0.5, 0.85, 1e-4, 0.02, 0.08, 10.0, 0.1
# fixed values: the deferred head update's gate, clamps and gain
HEAD_GATE, HEAD_ERROR, HEAD_LOW, HEAD_HIGH, HEAD_GAIN, HEAD_WEIGHT = 0.05, 2.0, 1e-4, 0.05, 0.15, 5.0
MODES = (("off", 1e9, 1e9, 0), ("learn", 0.30, 1e9, 0), ("explore", 0.30, 0.50, 3))
POLICIES = (("balanced", 1.0, 1.0, 1.0), ("ratio", 0.0, 0.0, 1.0))
_SPACE = pd.DataFrame([(a, q, s) for s in (0, 1) for q in (0, 1) for a in range(8)], columns=["algo_idx", "quant", "shuffle"])
OUT = "field_id string, mode string, policy string, chunk_id long, action32 int, pred_cost double, real_cost double, error_frac double, regret double, sgd_fired boolean, explored int, final_action32 int"


def modes(spark: SparkSession) -> DataFrame:
    """The independent learners: three modes by two policies."""
    return spark.createDataFrame([(m, x1, x2, k, p, *w) for m, x1, x2, k in MODES for p, *w in POLICIES], "mode string, x1 double, x2 double, k int, policy string, w0 double, w1 double, w2 double")


def measured(chunk: pd.Series) -> np.ndarray:
    """Deterministic stand-in measurements (comp, decomp, ratio, psnr) of all 32 actions on a chunk."""
    a, q, s = (_SPACE[c].to_numpy(np.float64) for c in ("algo_idx", "quant", "shuffle"))
    size = chunk["n_bytes"] / 4096.0
    return np.stack([1 + 0.5 * a + 0.25 * s + size, 0.5 + 0.25 * a + 0.125 * s + size / 2, (1 + 0.25 * a + 0.5 * s) * (1 + 2 * q) * 8 / (1 + chunk["entropy"]), np.where(q == 1, 60.0, 120.0)], axis=1)


def cost_of(y: np.ndarray, n_bytes: float, w: tuple[float, float, float], bandwidth: float = 5e6) -> np.ndarray:
    return w[0] * np.maximum(y[:, 0], 1) + w[1] * np.maximum(y[:, 1], 1) + w[2] * n_bytes / (np.minimum(y[:, 2], 100) * bandwidth)


@dataclass
class Learner:
    """Weights and momentum of one stream; :meth:`snapshot` and :meth:`restore` carry them."""

    weights: Weights
    momentum: np.ndarray = field(default_factory=lambda: np.zeros(0))
    calls: int = 0

    def snapshot(self) -> bytes:
        w, b = self.weights.layers[-1]
        return np.concatenate([[self.calls, len(self.momentum)], w.ravel(), b, self.momentum.ravel()]).astype("<f8").tobytes()

    def restore(self, raw: bytes) -> None:
        x = np.frombuffer(raw, "<f8")
        w, b = self.weights.layers[-1]
        n = w.size + b.size
        self.calls = int(x[0])
        self.weights = self.weights.with_head(x[2 : 2 + w.size].reshape(w.shape), x[2 + w.size : 2 + n])
        self.momentum = x[2 + n :].reshape(-1, w.shape[1] + 1) if x[1] else np.zeros(0)

    def update(self, h: np.ndarray, y: np.ndarray, real: np.ndarray, head_only_times: bool = False) -> bool:
        """One step from samples (hidden, predicted, real); false if every error is below the gate."""
        w, b = self.weights.layers[-1]
        error = (y[:, :LEARNED] - real) / np.maximum(np.abs(real), 1e-6)
        limit, gate = (HEAD_ERROR, HEAD_GATE) if head_only_times else (ERROR_CLAMP, GATE)
        if head_only_times:
            error = np.log(np.maximum(y[:, :LEARNED], 1e-6) / np.maximum(real, 1e-6))
            error[:, [0, 2, 3]] = 0
        used = np.where(np.abs(error) > gate, np.clip(error, -limit, limit), 0)
        if not used.any():
            return False
        # columns of the gradient: each learned output's hidden weights and bias
        g = used.T @ np.concatenate([h, np.ones((len(h), 1))], axis=1) / len(h)
        norm = np.linalg.norm(g, axis=1, keepdims=True)
        g = g * np.minimum(1, CLIP / np.maximum(norm, 1e-12))
        for i in range(len(g)):  # what pulls against another output is projected off it
            for j in range(len(g)):
                dot, nj = float(g[i] @ g[j]), float(g[j] @ g[j])
                if i != j and nj > 0 and dot < -0.1 * (nj * float(g[i] @ g[i])) ** 0.5:
                    g[i] = g[i] - dot / nj * g[j]
        total = np.linalg.norm(g)
        if not np.isfinite(total) or total < 1e-12:
            return False
        g = g / total
        if self.momentum.size:
            flipped = self.calls > 3 and float((self.momentum * g).sum()) < 0
            g = MOMENTUM * self.momentum + (1 - MOMENTUM) * g
        else:
            flipped = False
        self.momentum, self.calls = g, self.calls + 1
        low, high, gain, top = (HEAD_LOW, HEAD_HIGH, HEAD_GAIN, HEAD_WEIGHT) if head_only_times else (STEP_LOW, STEP_HIGH, STEP_GAIN, WEIGHT_CLAMP)
        step = float(np.clip(gain * np.abs(used).mean(), low, high)) * (0.5 if flipped else 1)
        w, b = w.copy(), b.copy()
        w[:LEARNED] = np.clip(w[:LEARNED] - step * g[:, :-1], -top, top)
        b[:LEARNED] = np.clip(b[:LEARNED] - step * g[:, -1], -top, top)
        self.weights = self.weights.with_head(w, b)
        return True

    def chunk(self, row: pd.Series) -> tuple:
        """Choose, measure, learn, explore; (action, predicted, real, error, regret, learned, explored, final action)."""
        x = encode_inputs(_SPACE.assign(error_bound=0.01, **{c: row[c] for c in ("n_bytes", "entropy", "mad", "deriv")}))
        h = hidden(self.weights, x)
        y = outputs(self.weights, h)
        w = (row["w0"], row["w1"], row["w2"])
        pred, facts = cost_of(y, row["n_bytes"], w), measured(row)
        real = cost_of(facts, row["n_bytes"], w)
        order = np.lexsort((np.arange(32), pred))
        first = int(order[0])
        error = abs(pred[first] - real[first]) / real[first] if real[first] > 1e-6 else 0.0
        fired = bool(error > row["x1"]) and self.update(h[[first]], y[[first]], facts[[first]])
        tried = order[1 : int(row["k"]) + 1] if error > row["x2"] else order[:0]
        final, best = first, real[first]
        for a in tried:
            if real[a] < best:
                final, best = int(a), real[a]
        if len(tried):
            again = tried[np.argsort(real[tried], kind="stable")][:7]
            self.update(h[again], y[again], facts[again])
        return first, float(pred[first]), float(real[first]), float(error), float((real[first] - best) / best) if best > 0 else 0.0, fired, len(tried), final


def _fold(key: tuple, rows: pd.DataFrame, weights: Weights) -> pd.DataFrame:
    learner = Learner(weights)
    out = [(*key, int(r["chunk_id"]), *learner.chunk(r)) for _, r in rows.sort_values("chunk_id", kind="stable").iterrows()]
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def learn(chunks: DataFrame, weights: Weights) -> DataFrame:
    """All chunks of every (field, mode, policy) in order; streams run in parallel."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _fold(key, rows, weights)

    return chunks.groupBy(*KEYS).applyInPandas(fold, OUT)


def _stream(key: tuple, frames: Iterator[pd.DataFrame], state, weights: Weights) -> Iterator[pd.DataFrame]:
    learner = Learner(weights)
    if state.exists:
        learner.restore(bytes(state.get[0]))
    rows = pd.concat(list(frames))
    out = [(*key, int(r["chunk_id"]), *learner.chunk(r)) for _, r in rows.sort_values("chunk_id", kind="stable").iterrows()]
    state.update((learner.snapshot(),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def learn_stream(chunks: DataFrame, weights: Weights) -> DataFrame:
    """:func:`learn` over a stream: each stream's head and momentum are its state between micro-batches.

    A micro-batch is folded in chunk order; batches must come in order, as replay gives them.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        yield from _stream(key, frames, state, weights)

    return chunks.groupBy(*KEYS).applyInPandasWithState(fold, OUT, "head binary", "append", "NoTimeout")


def back_fill(records: DataFrame, reads: DataFrame) -> DataFrame:
    """Records ``chunk_id, decomp_ms`` with decompression times that a later read measured."""
    late = reads.groupBy("chunk_id").agg(F.max("decomp_ms").alias("late_"))
    return records.join(late, "chunk_id", "left").withColumn("decomp_ms", F.coalesce("late_", "decomp_ms")).drop("late_")

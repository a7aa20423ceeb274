"""The cost network: 8 inputs, four hidden layers of 64, 8 outputs, with a NumPy forward pass.

Weights are an argument and travel in the closure (13,576 numbers).  The binary form has a header, normalisation
tables, layers and input limits; it is read with every length checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

INPUTS, HIDDEN, LAYERS, OUTPUTS = 8, 64, 4, 8
FEATURES = ("algo_idx", "quant", "shuffle", "error_bound", "n_bytes", "entropy", "mad", "deriv")
OUTPUT_NAMES = ("comp_ms", "decomp_ms", "ratio", "psnr", "rmse", "max_error", "mae", "ssim")
MAGIC = b"SLNN"
#: Error bound that lossless candidates are encoded with.
NO_BOUND = 1e-7


@dataclass(frozen=True)
class Weights:
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: np.ndarray
    y_std: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    x_min: np.ndarray
    x_max: np.ndarray

    def with_head(self, w: np.ndarray, b: np.ndarray) -> Weights:
        return replace(self, layers=(*self.layers[:-1], (w, b)))


def seeded_weights(seed: int = 42) -> Weights:
    """Deterministic fixture weights of the right shape; they predict nothing real."""
    rng = np.random.default_rng(seed)
    dims = [INPUTS, *[HIDDEN] * LAYERS, OUTPUTS]
    layers = tuple((rng.normal(0, (2 / a) ** 0.5, (b, a)), np.zeros(b)) for a, b in zip(dims[:-1], dims[1:], strict=True))
    return Weights(np.array([3.5, 0.5, 0.5, -8.0, 10.0, 4.0, 1.0, 1.0]), np.array([2.3, 0.5, 0.5, 5.0, 2.0, 2.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0, 80.0, 0.1, 0.1, 0.1, 3.0]), np.array([0.5, 0.5, 0.5, 30.0, 0.1, 0.1, 0.1, 2.0]), layers, np.full(INPUTS, -1e6), np.full(INPUTS, 1e6))


def to_bytes(w: Weights) -> bytes:
    """24-byte header (magic, version, layers, inputs, hidden, outputs), then 32-bit floats."""
    body = [w.x_mean, w.x_std, w.y_mean, w.y_std, *[a for layer in w.layers for a in layer], w.x_min, w.x_max]
    return struct.pack("<4s5I", MAGIC, 2, len(w.layers), INPUTS, HIDDEN, OUTPUTS) + b"".join(np.asarray(a, "<f4").tobytes() for a in body)


def from_bytes(raw: bytes) -> Weights:
    """The inverse of :func:`to_bytes`; wrong magic, version, sizes or length raise ValueError."""
    if len(raw) < 24:
        raise ValueError("weights are cut")
    magic, version, layers, inputs, hidden, outputs = struct.unpack_from("<4s5I", raw)
    if magic != MAGIC or version not in (1, 2) or (inputs, hidden, outputs) != (INPUTS, HIDDEN, OUTPUTS) or layers < 2:
        raise ValueError("not weights of this network")
    at = 24

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        n = int(np.prod(shape))
        if at + 4 * n > len(raw):
            raise ValueError("weights are cut")
        out = np.frombuffer(raw, "<f4", n, at).astype(np.float64).reshape(shape)
        at += 4 * n
        return out

    xm, xs, ym, ys = take(inputs), take(inputs), take(outputs), take(outputs)
    dims = [inputs, *[hidden] * (layers - 1), outputs]
    body = tuple((take(b, a), take(b)) for a, b in zip(dims[:-1], dims[1:], strict=True))
    low, high = (take(inputs), take(inputs)) if version == 2 else (np.full(inputs, -np.inf), np.full(inputs, np.inf))
    if at != len(raw):
        raise ValueError("weights have bytes left over")
    return Weights(xm, xs, ym, ys, body, low, high)


def encode_inputs(f: pd.DataFrame) -> np.ndarray:
    """Network inputs in order; bounds and sizes by logarithm, lossless rows with :data:`NO_BOUND`."""
    bound = np.where(f["quant"] > 0, f["error_bound"], NO_BOUND)
    return np.stack([f["algo_idx"], f["quant"], f["shuffle"], np.log(np.maximum(bound, NO_BOUND)), np.log(np.maximum(f["n_bytes"], 1)), f["entropy"], np.log1p(f["mad"]), np.log1p(f["deriv"])], axis=1).astype(np.float64)


def hidden(w: Weights, x: np.ndarray) -> np.ndarray:
    """Activations before the last layer."""
    h = (np.clip(x, w.x_min, w.x_max) - w.x_mean) / np.maximum(w.x_std, 1e-8)
    for a, b in w.layers[:-1]:
        h = np.maximum(h @ a.T + b, 0)
    return h


def outputs(w: Weights, h: np.ndarray) -> np.ndarray:
    """Denormalised, untransformed and clamped outputs."""
    a, b = w.layers[-1]
    y = (h @ a.T + b) * np.maximum(w.y_std, 1e-8) + w.y_mean
    ct, dt, ratio = (np.expm1(np.clip(y[:, k], -50, 50)) for k in range(3))
    out = np.stack([np.clip(ct, 1e-6, 1e6), np.clip(dt, 1e-6, 1e6), np.clip(ratio, 0.1, 1e5), np.clip(y[:, 3], 0, 120), *[np.maximum(np.expm1(np.clip(y[:, k], -50, 50)), 0) for k in (4, 5, 6)], 1 - np.exp(-np.maximum(y[:, 7], 0))], axis=1)
    return out


def forward(w: Weights, x: np.ndarray) -> np.ndarray:
    return outputs(w, hidden(w, x))


def _predict(batches: Iterator[pd.DataFrame], w: Weights) -> Iterator[pd.DataFrame]:
    for b in batches:
        y = forward(w, encode_inputs(b))
        yield b.assign(**{f"pred_{n}": y[:, k] for k, n in enumerate(OUTPUT_NAMES)})


def predict(rows: DataFrame, w: Weights) -> DataFrame:
    """Adds ``pred_*`` columns to rows that have the features."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(partial(_predict, w=w), schema + "".join(f", pred_{n} double" for n in OUTPUT_NAMES))

"""Words and word shingles of many texts at once, as 64-bit digests, with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z only) text, taken on its UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _random.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base & ((1 << 64) - 1), np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first byte, end) of every word of ``raw``, bytes that end with a gap."""
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    up, down = _grown(len(raw) + 1)
    run = np.empty(len(raw) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
    return mix64((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64) * _STEP), begin, end


def lowered(texts: list[bytes], gap: bytes = b" ") -> np.ndarray:
    """The texts in lower case (A-Z only), each followed by ``gap``."""
    return np.frombuffer(gap.join(texts).translate(_LOWER) + gap, np.uint8)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(digest of every word, words of each text) for UTF-8 texts."""
    digest, begin, _ = words_in(lowered(texts))
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, ends_of), prepend=0)
    return digest, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct digests of each text's ``k``-word shingles.

    A text with fewer words, but some, has its whole sequence as one; without words the set is empty.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    n = len(words)
    shingle = np.zeros(n, np.uint64)
    for j in range(k):
        if n > j:
            shingle[: n - j] += words[j:] * _PLACE[j]
    shingle = mix64(shingle + np.uint64(k))
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(shingle[at : at + c - k + 1]))
        elif c:
            whole = np.uint64(c)
            with np.errstate(over="ignore"):
                for j in range(c):
                    whole = whole + words[at + j] * _PLACE[j]
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out

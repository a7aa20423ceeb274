"""Whole-text encoding with the ``tokenizers`` library, with a cache of space-separated chunks.

Both tokenizer kinds used here split a text before byte-pair merging, and a single space
between two characters that are not white space always ends a piece of that split.  A text is
therefore cut at such spaces, each different chunk is encoded once by the library, and a text's
ids are its chunks' ids in order.  A text with any other use of white space around a space
(doubled, leading, trailing), or with the string of an added token of the vocabulary, is given to the
library whole, so the ids are always exactly those of encoding the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

#: Texts handed to the encoder at once.
TEXTS_AT_ONCE = 256
#: Chunks a Python worker remembers; beyond it the older half is forgotten.
CACHE_CHUNKS = 1_000_000
#: Chunks encoded by one call of the library.
CHUNKS_PER_CALL = 512
#: A control character put between chunks where white space leaves no trace in the ids.
MARK = "\x01"


class ChunkEncoder:
    """Encodes texts to little-endian ids of ``dtype``; equal to ``encode`` of the whole text."""

    def __init__(self, path: str, dtype: str = "<u4", cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._added = sorted({*added, *map(str.lower, added)})
        self.dtype = np.dtype(dtype)
        self.cache_chunks = cache_chunks
        self._new: dict[str, bytes | bool] = {}
        self._old: dict[str, bytes | bool] = {}
        space = self.tokenizer.encode(" a", add_special_tokens=False).ids[0]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{size} ids do not fit {self.dtype}")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        marker = "Ġ"  # how byte-level vocabularies write a space
        self._spaced = names[space].startswith(marker)
        self._starts = np.array([n.startswith(marker) for n in names])
        mark = self.tokenizer.encode(f"a {MARK} a", add_special_tokens=False).ids
        self._mark = mark[1] if len(mark) == 3 else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks as they stand after a space; False marks one that a space cannot bound."""
        if len(self._new) + len(chunks) > self.cache_chunks // 2:
            self._old, self._new = self._new, {}
        good = []
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace():
                self._new[c] = False
            else:
                good.append(c)
        for k in range(0, len(good), CHUNKS_PER_CALL):
            some = good[k : k + CHUNKS_PER_CALL]
            if self._spaced:
                ids = np.array(self._ids(" " + " ".join(some)), dtype=self.dtype)
                at = np.flatnonzero(self._starts[ids])
                if len(at) == len(some) and len(at) and at[0] == 0:
                    raw, ends = ids.tobytes(), np.append(at[1:], len(ids)) * self.dtype.itemsize
                    begins = at * self.dtype.itemsize
                    self._new.update((c, raw[a:b]) for c, a, b in zip(some, begins.tolist(), ends.tolist(), strict=True))
                    continue
            elif self._mark is not None and not any(MARK in c for c in some):
                ids = np.array(self._ids(f" {MARK} ".join(some)), dtype=self.dtype)
                at = np.flatnonzero(ids == self._mark)
                if len(at) == len(some) - 1:
                    raw, size = ids.tobytes(), self.dtype.itemsize
                    begins, ends = np.append(0, at + 1) * size, np.append(at, len(ids)) * size
                    self._new.update((c, raw[a:b]) for c, a, b in zip(some, begins.tolist(), ends.tolist(), strict=True))
                    continue
            self._new.update(zip(some, self._whole([" " + c for c in some]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as bytes."""
        out: list[bytes | None] = [None] * len(texts)
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            self._some(texts[k : k + TEXTS_AT_ONCE], out, k)
        return out  # type: ignore[return-value]

    def _parts(self, text: str) -> list[str]:
        """Chunks of a text: the first as it stands at the begin, the others after a space.

        Where white space leaves no trace and letters become small, that is done first for texts of Latin-1
        characters, for which Python and the tokenizer agree; the first chunk is then the empty one.  A text
        with an added token's string, in any case of letters, is two empty chunks, which no space bounds.
        """
        if self._has_added(text):
            return ["", ""]
        if not self._spaced:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(" ")
            if len(raw.translate(None, b"\x1c\x1d\x1e\x1f")) == len(raw):  # not white space to the tokenizer
                return ["", *text.lower().split()]
        return text.split(" ")

    def _has_added(self, text: str) -> bool:
        small = text.lower()
        return any(a in text or a in small for a in self._added)

    def _some(self, texts: list[str], out: list, base: int) -> None:
        parts = [self._parts(t) for t in texts]
        found = [list(map(self._new.get, p)) for p in parts]
        holes = [[i for i, ids in enumerate(got) if ids is None and i] for got in found]
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
            try:
                if not first and len(p) > 1 and not self._spaced and texts[j][:1] != " ":
                    out[base + j] = b"".join(got[1:])
                elif len(p) > 1 and (not first or first[0].isspace() or first[-1].isspace()):
                    whole.append(j)
                else:
                    out[base + j] = b"".join(got[1:])
                    heads.append(j)
            except TypeError:
                whole.append(j)
        for these, cut in ((heads, True), (whole, False)):
            ids = self._whole([parts[j][0] if cut else texts[j] for j in these]) if these else []
            for j, x in zip(these, ids, strict=True):
                out[base + j] = x + out[base + j] if cut else x


@lru_cache(maxsize=8)
def encoder(path: str, dtype: str = "<u4", cache_chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return ChunkEncoder(path, dtype, cache_chunks)


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine (each machine has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)

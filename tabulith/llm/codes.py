"""Vectorised work on the characters of many texts at once.

Texts of an Arrow batch are laid end to end as one array of code points, so hashing, word
splitting and table look-ups run in numpy over whole batches instead of once per text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters worked on at a time; bounds a Python worker's memory whatever the batch size.
CHUNK_CHARS = 400_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up = np.full(size, _BASE, dtype=np.uint64)
    down = np.full(size, pow(_BASE, -1, _MASK + 1), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    room = 1 << max(19, int(size).bit_length())
    up, down = _powers(room)
    return up[:size], down[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any window of a symbol array in constant time, equal for equal windows."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])

    def windows(self, start: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return mix((self._sums[start + width] - self._sums[start]) * self._down[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of the window of `width` symbols at each position that has one."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    best, done = values, 1
    while done * 2 <= width:
        best = np.minimum(best[: len(best) - done], best[done:])
        done *= 2
    if done < width:
        rest = width - done
        best = np.minimum(best[: len(best) - rest], best[rest:])
    return best


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as code points, and where each begins (one more entry at the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a batch with about `limit` characters each, and their texts (null as '')."""
    values = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
    at, size = 0, 0
    for i, t in enumerate(values):
        if i > at and size + len(t) > limit:
            yield at, i, values[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(values):
        yield at, len(values), values[at:]


def composed(text: str) -> str:
    """The text in composed form; a no-op check for nearly all texts."""
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


#: Kinds of characters for word splitting.
GAP, WORD, IGNORED = 0, 1, 2


@lru_cache(maxsize=1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane (the last entry stands for all others): its kind, and its lower-case form."""
    kind = np.zeros(65537, dtype=np.uint8)
    fold = np.arange(65537, dtype=np.uint32)
    for cp in range(65536):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] in "LNM":
            kind[cp] = WORD
            low = ch.lower()
            if len(low) == 1 and ord(low) < 65536:
                fold[cp] = ord(low)
        elif cat == "Cf":
            kind[cp] = IGNORED
    kind[65536] = WORD
    return kind, fold


class Words:
    """The words of many texts: runs of letters and digits, without case, punctuation and invisible characters."""

    def __init__(self, texts: list[str]):
        codes, starts = code_points(texts)
        kind, fold = word_tables()
        small = np.minimum(codes, 65536)
        kinds = kind[small]
        folded = np.where(codes < 65536, fold[small], codes)
        if (kinds == IGNORED).any():
            keep = kinds != IGNORED
            starts = np.concatenate([[0], np.cumsum(keep)])[starts]
            kinds, folded = kinds[keep], folded[keep]
        inside = np.zeros(len(kinds) + 2, dtype=np.int8)
        inside[1:-1] = kinds == WORD
        edge = np.diff(inside)
        begins = edge[:-1] == 1
        # a word never runs over the end of its text
        at = starts[1:-1][starts[1:-1] < len(kinds)]
        joined = at[(inside[at + 1] == 1) & (inside[at] == 1)]
        begins[joined] = True
        first = np.flatnonzero(begins)
        last = np.flatnonzero(edge == -1)
        if len(joined):
            last = np.sort(np.concatenate([last, np.unique(joined)]))
        self.first, self.last = first, last
        self.hashes = Rolling(folded).windows(first, last - first) if len(first) else np.zeros(0, dtype=np.uint64)
        #: Where each text's words begin, one more entry at the end.
        self.starts = np.searchsorted(first, starts)

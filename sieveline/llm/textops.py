"""Vectorised text primitives for Arrow batches: bounded sub-batches, word spans, rolling hashes.

Everything works on the UTF-8 bytes of whole texts. A sub-batch holds at most ``MAX_BYTES``
of text (or one text, if that is longer), which bounds a task's memory whatever the size of
its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`: in UTF-8 every byte of a longer code point belongs to the word
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z is lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLES = _RNG.integers(1 << 62, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """64-bit hashes of any ranges of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray, which: int = 0):
        size = 1 << max(10, int(len(data)).bit_length())
        up, self.down = _powers(which, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sub_batches(batch: pa.RecordBatch, text: str, max_bytes: int = MAX_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Slices of the rows of ``batch`` and their texts as bytes (null: empty)."""
    column = batch.column(text).cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > max_bytes:
            yield slice(begin, i), [x or b"" for x in column[begin:i].to_pylist()]
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes)), [x or b"" for x in column[begin:].to_pylist()]


@dataclass
class Words:
    """Words of a sub-batch; ``first[d]:first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        return Rolling(self.data, which).ranges(self.starts, self.ends)


def words_of(texts: list[bytes], word: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Maximal runs of bytes in ``word``, within each text. Texts are joined by a space, never a word byte."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = LOWER[data]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lens)])
    inside = word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position that has ``n`` ahead (in the joined sub-batch)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + len(out)]
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a long."""
    return x.view(np.int64)

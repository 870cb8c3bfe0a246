"""Hashes of words and word runs for whole batches of texts, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together until they have so many bytes; one text is never cut.
CHUNK_BYTES = 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(20_260_901))
_LETTERS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
PLACES = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown when a longer chunk comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(n, np.uint64)
            up, down = ones.copy(), ones.copy()
            up[1:], down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = Powers()


def powers_down(n: int) -> np.ndarray:
    return POWERS.upto(n)[1]


def byte_values(data: np.ndarray) -> np.ndarray:
    """The random odd number that stands for each byte."""
    return _LETTERS[data]


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of whole texts; null texts are empty."""
    wide = pa.types.is_large_string(texts.type)
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z counted as a-z, and for each text the number of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    up, down = POWERS.upto(n + 1)
    values = _LETTERS[LOWER[data]] * up[:n]
    values[~inside] = 0
    sums = np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)
    sizes = np.add.reduceat(inside.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return mixed(sums * down[starts] + sizes.astype(np.uint64)), np.searchsorted(starts, offsets)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * PLACES[k]
    return mixed(total + np.uint64(size))

"""Words, their hashes and per-document sums over Arrow text columns, in NumPy.

A word is a maximal run of bytes other than space and the control characters 9 to
13, so of `[^\\x20\\x09-\\x0D]+`; texts are UTF-8, in which those bytes stand only for
themselves. A word's hash is 64 bits wide and depends on its bytes alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
_BASE, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x):
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, one after the other, and the n + 1 places where texts start and end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, "u1"), np.zeros(len(column) + 1, "i8")
    return np.frombuffer(data, "u1")[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    starts: np.ndarray  # in bytes
    ends: np.ndarray
    first: np.ndarray  # words of document i: first[i] .. first[i + 1] - 1
    space: np.ndarray  # of each byte

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes for which gaps isn't set, within documents."""
    space = gaps[data]
    if not len(data):
        return Words(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(len(at), "i8"), space)
    begins, stops = ~space, ~space
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    inner = at[(at > 0) & (at < len(data))]  # a word ends with its document
    begins[inner] = ~space[inner]
    stops[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, at), space)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of byte ranges, in steps of about a MiB, so long texts take no more memory than their words."""
    out = np.zeros(len(starts), _U)
    longest = int((ends - starts).max()) if len(starts) else 0
    powers = np.cumprod(np.full(min(longest, 1 << 16), _BASE, _U)) if longest else None
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP, side="right")))
        lens = ends[i:j] - starts[i:j]
        places = np.concatenate([[0], np.cumsum(lens)])
        within = np.arange(places[-1]) - np.repeat(places[:-1], lens)
        values = (data[within + np.repeat(starts[i:j], lens)].astype(_U) + _U(1)) * powers[within % (1 << 16)]
        far = within >= 1 << 16  # powers come again after 64 KiB
        if far.any():
            values[far] = mix(values[far] + (within[far] >> 16).astype(_U))
        out[i:j] = mix(np.add.reduceat(values, places[:-1]) + lens.astype(_U))
        i = j
    return out


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words within documents, and where (in words) each begins."""
    if len(hashes) < n:
        return np.zeros(0, _U), np.zeros(0, "i8")
    size = len(hashes) - n + 1
    out = np.full(size, _U(n))
    for k in range(n):
        out = mix(out * _BASE + hashes[k : k + size])
    within = np.ones(size, bool)
    for e in first[1:-1]:
        within[max(0, e - n + 1) : min(size, e)] = False
    at = np.flatnonzero(within)
    return out[at], at


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges at[i] .. at[i + 1] - 1."""
    total = np.concatenate([[0], np.cumsum(values, dtype="i8")])
    return total[at[1:]] - total[at[:-1]]

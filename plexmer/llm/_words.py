"""Vectorised word and word-window hashes over the UTF-8 buffer of an Arrow column.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A word's hash depends on
its bytes alone (not on the process), so hashes can be compared across executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.table = base, np.ones(1, _U)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = np.concatenate(([_U(1)], np.cumprod(np.full(max(n, 4096), self.base, _U))))
        return self.table


_powers = Powers(_BASE)
_inverse = Powers(_U(pow(int(_BASE), -1, 1 << 64)))


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offs = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(array: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about `most_bytes` bytes; a longer text comes alone."""
    raw, offs = text_buffers(array)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most_bytes, "right")) - 1)
        yield at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's first word (one more entry at the end)."""
    n = len(raw)
    inside = ~_SPACE[raw]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts_of_texts = offs[:-1][offs[:-1] < n]
    before[starts_of_texts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends_of_texts = offs[1:][offs[1:] > 0] - 1
    after[ends_of_texts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, _U)
    raw = _LOWER[raw] if lower else raw
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    letters = raw[within + np.repeat(starts, lengths)].astype(_U) + _U(1)
    values = letters * _powers.upto(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` consecutive words; empty for fewer words."""
    if len(words) < n:
        return np.zeros(0, _U)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * _U(3) + _U(1)) + words[i : len(words) - n + 1 + i]
    return mix(out)


def rolling_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Like `gram_hashes` for long runs: one pass, whatever `n`."""
    if len(words) < n:
        return np.zeros(0, _U)
    m = len(words) - n + 1
    powers, inverse = _powers.upto(len(words)), _inverse.upto(m)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * powers[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[:m])


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct `n`-word shingles in ascending order; with fewer words the whole sequence as one; empty without words."""
    if not len(words):
        return np.zeros(0, _U)
    if len(words) < n:
        return gram_hashes(np.concatenate(([_U(len(words))], words)), len(words) + 1)
    return np.unique(gram_hashes(words, n))

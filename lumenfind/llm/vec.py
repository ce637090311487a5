"""Vectorised text kernels over Arrow string columns.

Words are runs of letters and digits after lower-casing; everything else separates. In scripts that are written without spaces
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) each character is a word. All kernels work
on the bytes of a whole slice of a column at once with numpy; nothing loops over words in Python.
Hashes depend on the content alone, never on the batch or the partition a text comes in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
_M = (1 << 64) - 1
#: Bytes of text that are looked at together. It bounds memory only; a longer text is a slice of its own.
SLICE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_pw = np.ones(1, U)
_ip = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ip
    if len(_pw) < n:
        n = max(n, 1 << 21)
        a, b = np.full(n, _P & _M, U), np.full(n, pow(_P, -1, 1 << 64), U)
        a[0] = b[0] = 1
        _pw, _ip = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pw, _ip


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def as_strings(col: pa.Array) -> pa.Array:
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    return col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())


def slices(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of a single row."""
    n = len(col)
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield at, to
        at = to


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, each closed by a line feed, and the offset of each row (n + 1 of them)."""
    col = pc.binary_join_element_wise(pc.fill_null(as_strings(col), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8, int(offsets[-1])) if data and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: hash, byte range in ``data``, row; ``first[r]`` is the first word of row r."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


#: First bytes of punctuation, symbols and spaces beyond ASCII, and of characters that are words of their own.
_OTHER, _UNSPACED = np.zeros(256, bool), np.zeros(256, bool)
_OTHER[[0xC2, 0xE2, 0xE3, 0xEF, 0xF0]] = True
_UNSPACED[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True


def lowered(col: pa.Array) -> pa.Array:
    col = pc.utf8_lower(as_strings(col))
    data = col.buffers()[2]
    if data is None:
        return col
    # Texts rarely hold any of these.
    data = np.frombuffer(data, np.uint8)
    if _OTHER[data].any():
        col = pc.replace_substring_regex(col, r"[^\x00-\x7f\p{L}\p{M}\p{N}]+", " ")
    if _UNSPACED[data].any():
        col = pc.replace_substring_regex(col, r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ")
    return col


def words(col: pa.Array) -> Words:
    data, offsets = joined(lowered(col))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    pw, ip = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * pw[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * ip[start] + (end - start).astype(U))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(h, start, end, row, first, data, offsets)


def kgrams(hashes: np.ndarray, first: np.ndarray, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the first of each row's (n + 1 of them).

    A row of fewer than k words has none, or, with ``whole``, one of all its words, if it has any.
    """
    n, rows = len(hashes), np.diff(first)
    out = np.zeros(n, U)
    for j in range(min(k, n)):
        out[: n - j] = out[: n - j] * U(_Q) + hashes[j:]
    keep = np.ones(n, bool)
    for j in range(1, k):  # the last k - 1 words of each row begin none
        at = first[1:] - j
        keep[at[(at >= first[:-1])]] = False
    out = mix(out + U(k))
    count = np.maximum(rows - k + 1, 0)
    if whole and (short := np.flatnonzero((rows > 0) & (rows < k))).size:
        for r in short:
            x = 0
            for h in hashes[first[r] : first[r + 1]].tolist():
                x = x * _Q + h & _M
            out[first[r]] = mix(np.array([x + int(rows[r]) & _M], U))[0]
            keep[first[r]] = True
        count[short] = 1
    return out[keep], np.concatenate([[0], np.cumsum(count)])


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def rows(col: pa.Array) -> list[np.ndarray]:
    """The values of each row of a list column of numbers without nulls."""
    flat, at = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def digest(words: np.ndarray) -> int:
    """A signed 64-bit number of a run of word hashes."""
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)

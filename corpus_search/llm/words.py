"""Hashed words of whole Arrow text columns, in numpy.

A word is a run of bytes that a byte table does not mark as a separator. Words are hashed straight
from the Arrow buffers, about a megabyte of text at a time, so that no Python string is made per
word and a task's memory does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(separators: bytes, lower: bool = True) -> np.ndarray:
    """The value of each byte in a word's hash; 0 marks a separator. Letters A-Z share the values
    of a-z if `lower`."""
    values = mix(np.arange(1, 257, dtype=U) * ODD) | U(1)
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


BLANKS = bytes([0x20, *range(0x09, 0x0E)])
BY_BLANKS = table(BLANKS)
#: All ASCII characters but letters and digits separate.
BY_LETTERS = table(bytes(b for b in range(128) if not chr(b).isalnum()))

_powers = np.cumprod(np.full(4096, U(0xD6E8FEB86659FD93)), dtype=U)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), U(0xD6E8FEB86659FD93)), dtype=U)
    return _powers


@dataclass
class Words:
    """Words of the rows `first` to `last` - 1 of a batch, in the order of the text."""

    first: int
    last: int
    hashes: np.ndarray
    row: np.ndarray  # from `first`
    starts: np.ndarray  # bytes from the block's first byte
    ends: np.ndarray
    data: np.ndarray


def _window(data: np.ndarray, cuts: np.ndarray, values: np.ndarray):
    """Hashes, starts and ends of the words of `data`; no word goes over a cut."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = values[data]
    inside = value != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(starts):
        return np.zeros(0, U), starts, ends
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    place[~inside] = 0
    value *= powers(int((ends - starts).max()))[place]
    return mix(np.add.reduceat(value, starts) ^ (ends - starts).astype(U) * ODD), starts, ends


def _long(data: np.ndarray, values: np.ndarray):
    """The same for one long text, by windows that end at separators."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            back = np.flatnonzero(values[data[max(at, end - 65536) : end]] == 0)
            if len(back):
                end = max(at, end - 65536) + int(back[-1]) + 1
                break
            end = min(len(data), end + BLOCK)  # a word of over 65,536 bytes
        h, s, e = _window(data[at:end], np.zeros(0, np.int64), values)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def hashed_words(column: pa.Array, values: np.ndarray = BY_BLANKS) -> Iterator[Words]:
    """Blocks of whole rows with the words of each."""
    data, offsets = texts(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
        last = min(n, max(last, first + 1))
        block = data[offsets[first] : offsets[last]]
        cuts = offsets[first : last + 1] - offsets[first]
        if last == first + 1 and len(block) > BLOCK:
            h, s, e = _long(block, values)
        else:
            h, s, e = _window(block, cuts, values)
        row = np.searchsorted(cuts, s, "right") - 1
        yield Words(first, last, h, row, s, e, block)
        first = last

"""Words, windows and hashes of Arrow string columns, computed on their bytes with numpy.

The helpers work on slices of a record batch of a few MB, so that memory in a
Python worker does not follow the batch or a document's neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_WORD_BASE = 0xD6E8FEB86659FD95
"""Odd base of the polynomial over word hashes, 5 modulo 8, so that its powers have the longest period."""
LONG_WORD = 4096
"""Longer words are hashed one by one."""
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        ups = np.full(size, base, _U)
        downs = np.full(size, pow(base, -1, 1 << 64), _U)
        ups[0] = downs[0] = 1
        have = _powers[base] = (np.cumprod(ups), np.cumprod(downs))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], eight bytes a step; every step passes the state through ``mix``."""
    size = ends - starts
    h = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15))
    lanes = np.ndarray((len(data) + 1,), _U, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while len(live):
        left = size[live] - done
        block = lanes[starts[live] + done]
        tail = left < 8
        block[tail] &= (_U(1) << (left[tail].astype(_U) << _U(3))) - _U(1)
        h[live] = mix(h[live] ^ block)
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes, then all second ones and so on, so that sorted ones compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    """What ``planes`` took."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def table_of(pattern_bytes: bytes) -> np.ndarray:
    """A lookup of which byte values are among the given."""
    member = np.zeros(256, bool)
    member[list(pattern_bytes)] = True
    return member


LOWER_WORD = table_of(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
"""ASCII digits, small letters and everything beyond ASCII."""
NOT_SPACE = ~table_of(bytes([0x20, *range(0x09, 0x0E)]))


class Words:
    """The words of a slice: starts and ends in its bytes, 64-bit hashes, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        n = len(data)
        inside = member[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = word_hashes(data, self.starts, self.ends)

    def runs(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hash of the ``size`` words from word ``at`` of the slice on."""
        n = len(self.hashes)
        ups, downs = powers(_WORD_BASE, n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hashes * ups[:n], out=sums[1:])
        return mix((sums[at + size] - sums[at]) * downs[at] + size.astype(_U))

    def windows(self, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first word in the slice) of every run of ``width`` words of a row.

        With ``short``, a row of fewer words, but not none, is one window.
        """
        per_row = np.maximum(self.counts - width + 1, 0)
        if short:
            per_row = np.where(self.counts > 0, np.maximum(per_row, 1), 0)
        row = np.repeat(np.arange(len(per_row)), per_row)
        ahead = np.cumsum(per_row) - per_row
        at = np.arange(len(row)) - ahead[row] + self.first[:-1][row]
        to = np.minimum(at + width, self.first[1:][row])
        return self.runs(at, to - at), row, at


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])

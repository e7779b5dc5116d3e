"""Shared byte and word primitives for the training-data operators.

Texts are handled as the UTF-8 bytes that Arrow already holds, so one numpy expression
covers all documents of a block. A block is a run of whole documents: about a quarter of a
megabyte, or a single longer document; no text is ever cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_BASE, _CODE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd
#: Longer spans are named by a cryptographic digest: sums modulo 2**64 have texts of some 500 bytes
#: and more that agree for every base.
_LONG = 255


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_CODE)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_row(base: int, n: int) -> np.ndarray:
    row = _powers.get(base)
    if row is None or len(row) < n:
        size = max(n, BLOCK_BYTES + 1)
        row = np.full(size, base, np.uint64)
        row[0] = 1
        row = np.multiply.accumulate(row)
        if size == BLOCK_BYTES + 1:  # of one very long text: not kept
            _powers[base] = row
    return row[:n]


class Fingerprints:
    """64-bit names of the spans of one buffer: prefix sums modulo 2**64, a digest for long spans."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_codes[data] * _power_row(_BASE, n), out=self.sums[1:])
        self.back = _power_row(pow(_BASE, -1, 1 << 64), n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of data[start:end] for arrays of bounds; the length takes part."""
        out = mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > _LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


class Block(NamedTuple):
    """Documents lo..hi of a batch: their bytes, and where each begins and ends."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of whole texts of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words(NamedTuple):
    """Byte bounds of the words of a block, and of each document's words in that list."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of document i: words first[i] .. first[i + 1]


def words(block: Block) -> Words:
    """Words are maximal runs outside U+0020 and U+0009 to U+000D; they never cross documents."""
    n = len(block.data)
    letter = ~_SPACE[block.data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:n]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | edge[1:n]
    begins = np.flatnonzero(start)
    return Words(begins, np.flatnonzero(end) + 1, np.searchsorted(begins, block.offsets))


def per_document(block: Block, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or count) of byte positions ``at``, for each document of the block."""
    where = np.searchsorted(block.offsets, at, "right") - 1
    # an empty document shares its offset with the next one: 'right' already picks the last
    sums = np.bincount(where, weights, minlength=block.hi - block.lo)
    return sums.astype(np.int64)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of every span of a buffer among the distinct ones, and those. Spans are equal if
    their bytes are: a hash finds them, and every span is compared with the one that leads it."""
    if not len(start):
        return np.zeros(0, np.int64), []
    _, lead, ids = np.unique(Fingerprints(data).spans(start, end), return_index=True, return_inverse=True)
    first = lead[ids]
    equal = end - start == end[first] - start[first]
    size = end - start
    longest = int(size.max())
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    for offset in range(0, min(longest, 64), 8):
        at = np.flatnonzero(size > offset) if offset else slice(None)
        bits = (np.minimum(size[at] - offset, 8) * 8).astype(np.uint64)
        spare = np.uint64(64) - bits
        equal[at] &= eight[start[at] + offset] << spare == eight[np.minimum(start[first[at]] + offset, len(data))] << spare
    for i in np.flatnonzero(size > 64):
        equal[i] &= np.array_equal(data[start[i] : end[i]], data[start[first[i]] : end[first[i]]])
    if equal.all():
        return ids, [data[a:b].tobytes() for a, b in zip(start[lead], end[lead], strict=True)]
    known: dict[bytes, int] = {}
    found = [known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start, end, strict=True)]
    return np.array(found, np.int64), list(known)

"""Suffix-array dedup by distributed prefix doubling over sparse positions.

A position's rank at length h orders its h-byte substring among all others; the rank at a greater
length is that of the pair (rank at the position, rank at an offset). The rank at 8 bytes is the
bytes themselves, packed into a whole number.

A row for every position of the corpus would shuffle over twenty times the input, so the positions
that Spark sorts are anchors: of the 24-byte windows of every 50-byte string the least by a hash,
the first of equals. A string has one anchor at one place, whatever text it stands in, so equal
strings meet under equal anchors.

1. Texts that equal one of a smaller document (SHA-256) are settled whole and take no further part.
2. Anchors that one row alone has drop out: a string with such an anchor stands nowhere else. They
   are told by 32-bit names within ranges of the anchors' hash space; a chance agreement only keeps
   an anchor for the next step. Names travel packed, thousands to a row.
3. Spark sorts the remaining anchors by the pair of 8-byte ranks at offset 8, which is their exact
   rank at 16. With an anchor go the bytes that its strings reach over (up to 26 on either side), so
   doubling stays inside the sorted group: ranks at 8, 16, 32 and, overlapped by offset 18, 50 are
   sorted from pairs. After each, positions whose rank one document alone holds drop out. At 50 the
   least document of a rank keeps its string, and all others lose it.

No decision rests on a fingerprint: step 2 only passes over what cannot repeat, and step 3 compares
bytes. A task sends on one entry for what repeats within its own rows. An anchor with more than
CROWD entries is not held: its strings go on one by one, dealt out by all their bytes, and Spark's
sort brings equal ones next to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bucketed, discard, stored
from .text import Block, blocks, mix

LENGTH = 50
ANCHOR, SORTED = 24, 16  # bytes of an anchor, and those that Spark sorts by
REACH = LENGTH - ANCHOR  # bytes of an anchor's strings on either side of it, at most
LAST_ID = (1 << 63) - 1
#: Anchors of a task that are matched before they are sent, and entries of one anchor that are held.
FLUSH = 300_000
CROWD = 65_536
#: Entries that are ranked at once, or those of one anchor.
SOLVED = 4_096
#: Bytes of text whose anchors form a range of the hash space (about as many bytes are held for it).
RANGE_BYTES = 1 << 20
_ENTRY = np.dtype([("place", "<u4"), ("a", "u1"), ("b", "u1")])  # an anchor; its strings start b to a bytes before it
_SPAN = np.dtype([("first", "<u4"), ("last", "<u4")])  # removed string starts
_LEAD = 0xFFFFFFFF
_FOUND = "key long, payload binary"
_SENT = "range long, direct boolean, n int, payload binary"
_RANKED = "r1 long, r2 long, ab int, doc long, key long, place long, piece binary"
_SENT_ARROW = pa.schema([("range", pa.int64()), ("direct", pa.bool_()), ("n", pa.int32()), ("payload", pa.binary())])
_FOUND_ARROW = pa.schema([("key", pa.int64()), ("payload", pa.binary())])
_RANKED_ARROW = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("ab", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("piece", pa.binary())])


def packed(data: np.ndarray) -> np.ndarray:
    """Rank at 8 bytes of every position: the bytes as one number, whose order is theirs."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(data) - 7, ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last) of a block's anchors: their strings start at first..last."""
    none = np.zeros(0, np.int64)
    size = np.diff(block.offsets)
    if not len(size) or size.max() < LENGTH:
        return none.astype(np.uint64), none, none, none
    eight = packed(block.data)
    least = np.zeros(len(block.data) - ANCHOR + 1, np.uint64)
    for offset in range(0, ANCHOR, 8):
        least = mix(least * np.uint64(0x9E3779B97F4A7C15) + eight[offset : offset + len(least)])
    names, at = least, np.arange(len(least), dtype=np.int32)
    have, width = 1, REACH + 1
    while have < width:
        step = min(have, width - have)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    whole = np.zeros(len(block.data) + 1, np.int8)
    long = size >= LENGTH
    np.add.at(whole, block.offsets[:-1][long], 1)
    np.add.at(whole, block.offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[: len(least)], dtype=np.int8))
    at = at[starts]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    position = at[head].astype(np.int64)
    return names[position], position, starts[head], starts[np.append(head[1:], len(starts)) - 1]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (last first), the heads of runs of equal keys but the first, and run sizes."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for key in keys[1:]:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    if len(new):
        new[0] = True
    head = np.flatnonzero(new)
    return order, head, np.diff(np.append(head, len(order)))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _dealt(keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(key, payload) with key a number of a bucket of rows, and its rows' keys and values packed."""
    to = (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, to))
    keys, values, to = keys[order], values[order], to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    rows = [(int(to[a]), np.diff(keys[a:b], prepend=0).tobytes() + values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return _rows(rows, _FOUND_ARROW)


def _by_row(kind: np.dtype):
    """Buckets of ``_dealt``, each whole in a partition, to (key, payload): a row for each key."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for payload in batch.column(1):
                payload = payload.as_py()
                n = len(payload) // (8 + kind.itemsize)
                held.append((np.cumsum(np.frombuffer(payload, np.int64, n)), np.frombuffer(payload, kind, n, 8 * n)))
        if not held:
            return
        keys, values = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for lo in range(0, len(cuts) - 1, 1000):
            some = cuts[lo : lo + 1001]
            ends = (some - some[0]).astype(np.int32) * kind.itemsize
            payload = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values[some[0] : some[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys[some[:-1]]), payload], schema=_FOUND_ARROW)

    return grouped


def _lists(column: pa.Array, lo: int, hi: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The row (from 0) and value of all entries of rows lo..hi of a binary column, none where null."""
    part = column.slice(lo, hi - lo)
    if part.null_count == len(part):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    part = pc.fill_null(part, b"")
    ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
    found = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return np.repeat(np.arange(hi - lo), np.diff(ends) // kind.itemsize), found


def _sent(ranges: int):
    """Rows (key, text) to packed anchors: those that two rows of the task have go straight on, by
    row, with one entry for the range; those of one row go to the range."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        names, keys, entries = (np.concatenate(c) for c in zip(*held, strict=True))
        names = mix(names)
        to = ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order, head, size = _groups(keys, names)
        first, last = keys[order[head]], keys[order[head + size - 1]]
        twice = np.repeat(first != last, size)
        lead = np.zeros(len(order), bool)
        lead[head] = True
        out = []
        known, onward = order[twice], order[lead | ~twice]
        marked = entries.copy()
        marked["place"][order[lead & twice]] = _LEAD
        for direct, chosen, values in ((True, known, entries), (False, onward, marked)):
            if not len(chosen):
                continue
            dealt = (mix(keys[chosen].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64) if direct else to[chosen]
            chosen = chosen[np.lexsort((keys[chosen], dealt))]
            dealt = np.sort(dealt)
            cuts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
            short = names.astype(np.uint32)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = chosen[a:b]
                out.append((int(dealt[a]), direct, len(part), short[part].tobytes() + np.diff(keys[part], prepend=0).tobytes() + values[part].tobytes()))
        return _rows(out, _SENT_ARROW)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for block in blocks(batch.column(1)):
                names, at, first, last = anchors(block)
                if not len(at):
                    continue
                row = np.searchsorted(block.offsets, at, "right") - 1
                entries = np.empty(len(at), _ENTRY)
                entries["place"], entries["a"], entries["b"] = at - block.offsets[row], at - last, at - first
                held.append((names, ids[block.lo + row], entries))
                n += len(at)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return sent


def _shared(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_sent``, sorted by range, to the anchors that two rows have, dealt to buckets. One
    range is held at a time."""

    def unpacked(n: int, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(payload, np.uint32, n), np.cumsum(np.frombuffer(payload, np.int64, n, 4 * n)), np.frombuffer(payload, _ENTRY, n, 12 * n)

    def settled(held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names, keys, entries = (np.concatenate(c) for c in zip(*held, strict=True))
        order, head, size = _groups(keys, names)
        twice = np.repeat(keys[order[head]] != keys[order[head + size - 1]], size)
        found = order[twice]
        found = found[entries["place"][found] != _LEAD]
        if len(found):
            yield keys[found], entries[found]

    at, held, out, n = None, [], [], 0
    for batch in batches:
        ranges, direct = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for i, (count, payload) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
            if held and ranges[i] != at:
                out += settled(held)
                n += len(out[-1][0]) if out else 0
                held = []
            at = ranges[i]
            entry = unpacked(count, payload.as_py())
            if direct[i]:
                out.append(entry[1:])
                n += count
            else:
                held.append(entry)
            if n > FLUSH:
                yield _dealt(*(np.concatenate(c) for c in zip(*out, strict=True)), buckets)
                out, n = [], 0
    if held:
        out += settled(held)
    if out:
        yield _dealt(*(np.concatenate(c) for c in zip(*out, strict=True)), buckets)


def _same(pieces: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the one that leads its equals, and whether it is another's equal. others: the
    order of leading first, then more that must be equal. Bytes are compared; a hash only finds them."""
    words = np.ascontiguousarray(np.pad(pieces, ((0, 0), (0, -pieces.shape[1] % 8)))).view(np.uint64)
    name = np.zeros(len(pieces), np.uint64)
    for column in (*words.T, *(x.astype(np.uint64) for x in others[1:])):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + column)
    order, head, size = _groups(others[0], name)
    lead = np.empty(len(order), np.int64)
    lead[order] = np.repeat(order[head], size)
    equal = (pieces == pieces[lead]).all(1)
    for x in others[1:]:
        equal &= x == x[lead]
    return lead, equal


def _cut_out(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, text, anchors) to ranked anchors with their surroundings. What equals an entry
    of the task with a smaller document goes on as spans, dealt to buckets (ab is -1)."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        r1, r2, entries, docs, keys, pieces = (np.concatenate(c) for c in zip(*held, strict=True))
        ab = entries["a"].astype(np.int32) | entries["b"].astype(np.int32) << 8
        lead, equal = _same(pieces, docs, r1, r2, ab)
        gone = equal & (docs > docs[lead])
        left = np.flatnonzero(~gone)
        flat = np.ascontiguousarray(pieces[left])
        ends = np.arange(len(left) + 1, dtype=np.int32) * pieces.shape[1]
        piece = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        # signed numbers in the order of the bytes
        signed = lambda r: pa.array((r[left] ^ np.uint64(1 << 63)).view(np.int64))
        yield pa.RecordBatch.from_arrays([signed(r1), signed(r2), pa.array(ab[left]), pa.array(docs[left]), pa.array(keys[left]), pa.array(entries["place"][left].astype(np.int64)), piece], schema=_RANKED_ARROW)
        if gone.any():
            spans = np.empty(int(gone.sum()), _SPAN)
            place = entries["place"][gone]
            spans["first"], spans["last"] = place - entries["b"][gone], place - entries["a"][gone]
            found = _dealt(keys[gone], spans, buckets)
            n = found.num_rows
            spread = pa.array(mix(np.asarray(found.column(0)).astype(np.uint64)).view(np.int64))
            none = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([spread, none, pa.array(np.full(n, -1, np.int32)), none, found.column(0), none, found.column(1)], schema=_RANKED_ARROW)

    held, n = [], 0
    columns = np.arange(-REACH, ANCHOR + REACH)
    for batch in batches:
        ids, docs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for block in blocks(batch.column(2)):
            row, entries = _lists(batch.column(3), block.lo, block.hi, _ENTRY)
            for lo in range(0, len(row), FLUSH // 10):
                part, mine = entries[lo : lo + FLUSH // 10], row[lo : lo + FLUSH // 10]
                place = block.offsets[mine] + part["place"]
                inside = (columns >= -part["b"].astype(np.int64)[:, None]) & (columns < LENGTH - part["a"].astype(np.int64)[:, None])
                around = np.where(inside, block.data[np.clip(place[:, None] + columns, 0, len(block.data) - 1)], np.uint8(0))
                own = np.ascontiguousarray(around[:, REACH : REACH + SORTED]).view(">u8").astype(np.uint64)
                held.append((own[:, 0], own[:, 1], part, docs[block.lo + mine], ids[block.lo + mine], np.delete(around, np.s_[REACH : REACH + SORTED], axis=1)))
                n += len(part)
                if n >= FLUSH // 10:
                    yield from flush(held)
                    held, n = [], 0
    if n:
        yield from flush(held)


def _rank(high: np.ndarray, low: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the pairs, column by column (all are columns x entries), and the least and the
    largest document of each rank."""
    order = np.argsort(low, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(high, order, 1), axis=1, kind="stable"), 1)
    a, b = np.take_along_axis(high, order, 1), np.take_along_axis(low, order, 1)
    new = np.ones(a.shape, bool)
    new[:, 1:] = (a[:, 1:] != a[:, :-1]) | (b[:, 1:] != b[:, :-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, new.size))
    own = np.take_along_axis(docs, order, 1).ravel()
    found = []
    for values in (np.cumsum(new, axis=1, dtype=np.uint32), np.minimum.reduceat(own, head), np.maximum.reduceat(own, head)):
        values = values if values.shape == a.shape else np.repeat(values, size).reshape(a.shape)
        out = np.empty_like(values)
        np.put_along_axis(out, order, values, 1)
        found.append(out)
    return tuple(found)


def repeated(group: np.ndarray, docs: np.ndarray, a: np.ndarray, b: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bytes before its anchor) of the strings that also start in a smaller document.

    group: number of the entry's anchor; around: REACH bytes, the anchor, REACH bytes; its strings
    start a..b bytes before the anchor. Equal strings have the anchor at the same place, so ranks
    are compared column by column within the groups.
    """
    entry = np.arange(len(group))
    eight = np.ndarray((around.shape[1] - 7, len(group)), ">u8", around, strides=(1, around.shape[1])).astype(np.uint64)
    ranks = _rank(np.broadcast_to(group, eight.shape), eight, np.broadcast_to(docs, eight.shape))[0]  # at 8
    before = np.arange(REACH, -1, -1)[:, None]
    for offset, at in ((8, (0, 16, LENGTH - 16)), (16, (0, LENGTH - 32))):  # ranks at 16, at 32
        ranks, least, most = _rank(ranks[:-offset], ranks[offset:], np.broadcast_to(docs, (len(ranks) - offset, len(docs))))
        several = least != most
        open_ = (before <= b) & (before >= a)
        for i in at:
            open_ &= several[i : i + REACH + 1]
        left = np.flatnonzero(open_.any(0))
        entry, docs, a, b, ranks = entry[left], docs[left], a[left], b[left], ranks[:, left]
        if not len(left):
            return entry, entry
    there = (before <= b) & (before >= a)
    offset = LENGTH - 32  # at 50, by overlap
    _, least, _ = _rank(ranks[:-offset], ranks[offset:], np.where(there, docs, LAST_ID))
    row, column = np.nonzero((there & (least < docs)).T)
    return entry[row], REACH - column


def _ranked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``_cut_out`` to removed spans, dealt to buckets (key, payload), and to the single
    strings of crowded anchors (payload is null)."""
    gone: list[tuple] = []
    schema = pa.schema([*_RANKED_ARROW, ("payload", pa.binary())])

    def spans(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        values = np.empty(len(keys), _SPAN)
        values["first"], values["last"] = first, last
        gone.append((keys, values))

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(k) for k, _ in gone) > least:
            yield done(_dealt(*(np.concatenate(c) for c in zip(*gone, strict=True)), buckets))
            gone.clear()

    def done(found: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([found.column(0) if f.name == "key" else found.column(1) if f.name == "payload" else pa.nulls(found.num_rows, f.type) for f in schema], schema=schema)

    def columns(table: pa.RecordBatch) -> tuple:
        r1, r2, ab, docs, keys, place = (np.asarray(table.column(i)) for i in range(6))
        raw = table.column(6)
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        pieces = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(raw), -1)
        own = np.stack([r1, r2], 1).view(np.uint64) ^ np.uint64(1 << 63)
        around = np.concatenate([pieces[:, :REACH], own.astype(">u8").view(np.uint8).reshape(len(raw), SORTED), pieces[:, REACH:]], 1)
        return r1, r2, (ab & 255).astype(np.int64), (ab >> 8).astype(np.int64), docs, keys, place, around

    def solved(table: pa.RecordBatch) -> None:
        r1, r2, a, b, docs, keys, place, around = columns(table)
        lead, equal = _same(around, docs, a, b)
        copied = equal & (docs > docs[lead])
        spans(keys[copied], place[copied] - b[copied], place[copied] - a[copied])
        new = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
        group = np.cumsum(new) - 1
        left = np.flatnonzero(~copied)
        size = np.bincount(group[left], minlength=group[-1] + 1)
        least, most = np.full(len(size), LAST_ID), np.full(len(size), -LAST_ID - 1)
        np.minimum.at(least, group[left], docs[left])
        np.maximum.at(most, group[left], docs[left])
        left = left[(least != most)[group[left]]]
        while len(left):
            cut = len(left)
            if cut > SOLVED:  # whole anchors, a larger one by itself
                cut = int(np.searchsorted(group[left], group[left[SOLVED]])) or int(np.searchsorted(group[left], group[left[0]], "right"))
            part, left = left[:cut], left[cut:]
            row, before = repeated(group[part], docs[part], a[part], b[part], np.ascontiguousarray(around[part]))
            if len(row):
                start, own = place[part][row] - before, keys[part][row]
                # runs of next starts of one entry become one span
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
                tail = np.append(head[1:], len(row)) - 1
                spans(own[head], start[head], start[tail])

    def single(table: pa.RecordBatch) -> pa.RecordBatch:
        """Each string of the entries for itself: its first 16 bytes as ranks, then the others. One of
        equal strings goes on, that of the least document."""
        _, _, a, b, docs, keys, place, around = columns(table)
        n = b - a + 1
        entry = np.repeat(np.arange(len(n)), n)
        before = b[entry] - (np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n))
        text = around[entry[:, None], (REACH - before)[:, None] + np.arange(LENGTH)]
        docs, keys, start = docs[entry], keys[entry], place[entry] - before
        lead, equal = _same(text, docs)
        copied = equal & (docs > docs[lead])
        spans(keys[copied], start[copied], start[copied])
        left = np.flatnonzero(~copied)
        own = np.ascontiguousarray(text[left, :SORTED]).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
        rest = np.ascontiguousarray(text[left, SORTED:])
        ends = np.arange(len(left) + 1, dtype=np.int32) * rest.shape[1]
        piece = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rest.tobytes())])
        r1, r2 = (pa.array(np.ascontiguousarray(own[:, i]).view(np.int64)) for i in range(2))
        return pa.RecordBatch.from_arrays([r1, r2, pa.nulls(len(left), pa.int32()), pa.array(docs[left]), pa.array(keys[left]), pa.array(start[left]), piece, pa.nulls(len(left), pa.binary())], schema=schema)

    def parts(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, table.num_rows, 2048):
            yield single(table.slice(lo, 2048))

    held, n, crowded = [], 0, None  # the entries of the last anchor met, or the anchor if it is crowded
    for batch in batches:
        ab = np.asarray(batch.column(2))
        direct = pa.array(ab < 0)
        found = batch.filter(direct)
        if found.num_rows:
            yield done(found.select(["key", "piece"]))
        batch = batch.filter(pa.array(ab >= 0))
        if not batch.num_rows:
            continue
        r1, r2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])) + 1
        if crowded is not None or held:
            last = crowded if crowded is not None else (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py())
            go_on = (r1[0], r2[0]) == last
            end = (cuts[0] if len(cuts) else batch.num_rows) if go_on else 0
            if crowded is not None:
                yield from parts(batch.slice(0, end))
            elif end:
                held.append(batch.slice(0, end))
                n += end
            if end < batch.num_rows:
                if held:
                    solved(_joined(held))
                held, n, crowded = [], 0, None
            batch, cuts = batch.slice(end), cuts[cuts > end] - end
            yield from flushed(FLUSH)
        if batch.num_rows:
            whole = int(cuts[-1]) if len(cuts) else 0
            if whole:
                solved(batch.slice(0, whole))
            held, n = [batch.slice(whole)], batch.num_rows - whole
        if n > CROWD:
            crowded = (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py())
            for table in held:
                yield from parts(table)
            held, n = [], 0
        yield from flushed(FLUSH)
    if held:
        solved(_joined(held))
    yield from flushed(0)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _alone(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Single strings (r1, r2, piece, doc, key, place), sorted, to spans: the first of equal strings
    has the least document; nothing but it is held."""
    last, least = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        r1, r2, docs, keys, place = (np.asarray(batch.column(i)) for i in (0, 1, 3, 4, 5))
        piece = batch.column(6)
        new = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
        texts = np.array(piece.to_pylist(), dtype=object)
        new[1:] |= texts[1:] != texts[:-1]
        head = np.flatnonzero(new)
        first = docs[head].copy()
        if (r1[0], r2[0], texts[0]) == last:
            first[0] = least
        least_of = np.repeat(first, np.diff(np.append(head, len(docs))))
        last, least = (r1[-1], r2[-1], texts[-1]), int(first[-1])
        gone = docs > least_of
        if gone.any():
            values = np.empty(int(gone.sum()), _SPAN)
            values["first"] = values["last"] = place[gone]
            yield _dealt(keys[gone], values, buckets)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc, text, digest, size, row): a table bucketed by key, a number of the row's own, so that
    each step joins its small lists without moving the texts again."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    return bucketed(rows, "key", "texts")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (key, doc, text, digest, size, row, copy, spans): every row with whether its whole text
    stands in a smaller document and, if not, the starts of its repeated strings as packed ranges;
    its columns but the text are the struct ``row``. See ``cut_repeats``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, id_col, text_col)
    long = texts.filter(F.col("size") >= LENGTH)
    firsts = long.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("most > least").select("digest", "least")
    copies = stored(long.select("key", "doc", "digest").join(firsts, "digest").filter("doc > least").select("key"), "copies")

    open_ = long.select("key", "doc", "text").join(copies.hint("shuffle_hash"), "key", "left_anti")
    size = texts.agg(F.sum("size")).first()[0] or 0
    sent = open_.select("key", "text").mapInArrow(_sent(max(64, size // RANGE_BYTES)), _SENT)
    shared = sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(partial(_shared, buckets=parts), _FOUND)
    shared = stored(shared.repartition(parts, "key").mapInArrow(_by_row(_ENTRY), _FOUND), "anchors")

    held = long.select("key", "doc", "text").join(shared.withColumnRenamed("payload", "anchors").hint("shuffle_hash"), "key")
    ranked = held.mapInArrow(partial(_cut_out, buckets=parts), _RANKED).repartition(parts, "r1", "r2").sortWithinPartitions("r1", "r2")
    found = stored(ranked.mapInArrow(partial(_ranked, buckets=parts), f"{_RANKED}, payload binary"), "found")
    single = found.filter("payload IS NULL").drop("payload").repartition(parts, "r1", "r2", "piece").sortWithinPartitions("r1", "r2", "piece", "doc")
    spans = found.filter("payload IS NOT NULL").select("key", "payload").union(single.mapInArrow(partial(_alone, buckets=parts), _FOUND))
    spans = stored(spans.repartition(parts, "key").mapInArrow(_by_row(_SPAN), _FOUND), "spans").withColumnRenamed("payload", "spans")
    discard(shared, found)
    out = texts.join(copies.withColumn("copy", F.lit(True)).hint("shuffle_hash"), "key", "left").join(spans.hint("shuffle_hash"), "key", "left")
    return out.withColumn("copy", F.coalesce("copy", F.lit(False)))


def removed(block: Block, copies: np.ndarray, column: pa.Array) -> np.ndarray:
    """Bytes of the block covered by repeated strings, as a mask."""
    n = len(block.data)
    change = np.zeros(n + 1, np.int32)
    row, spans = _lists(column, block.lo, block.hi, _SPAN)
    np.add.at(change, block.offsets[row] + spans["first"], 1)
    np.add.at(change, block.offsets[row] + spans["last"] + LENGTH, -1)
    whole = np.flatnonzero(copies[block.lo : block.hi])
    np.add.at(change, block.offsets[whole], 1)
    np.add.at(change, block.offsets[whole + 1], -1)
    return np.cumsum(change[:-1]) > 0


def _cut(found: DataFrame, carried: Column, row: bool) -> DataFrame:
    """(carried, n_bytes, n_removed, n_spans, kept_sha256, text) with the repeated bytes out."""
    found = found.select(carried.alias("carried"), "text", "copy", "spans")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            for block in blocks(batch.column(1)):
                gone = removed(block, copies, batch.column(3))
                rows = []
                for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True):
                    own = gone[a:b]
                    kept = block.data[a:b][~own].tobytes()
                    runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if b > a else 0
                    rows.append((int(b - a), int(own.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if row else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), *columns], ["carried", *schema.names])

    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
    numbers = [T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")]
    texts = [T.StructField(name, T.StringType()) for name in ("kept_sha256", "text")]
    return found.mapInArrow(finished, T.StructType([found.schema["carried"], *numbers, *texts]))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Removed is each byte covered by a 50-byte string of the row's UTF-8 text that also starts in a
    row of smaller id. Strings are judged on the input, overlaps count, and none crosses rows.

    Ids are whole numbers. A null id counts as 2**63 - 1, the largest; null text is empty; a text under
    50 bytes keeps all; a very long one is handled whole (a task holds it, and about ten times its
    size for its anchors). Rows that repeat an id do not remove from each other; repeated rows get
    the same result. An empty table gives an empty result; other columns are left out.
    """
    found = repeated_spans(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    out = _cut(found, F.col("row")["id"], row=False)
    return out.select(F.col("carried").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes cut from the text, and n_chars (if
    there) that of the text left. A character that a cut breaks is left out. Rows of which nothing
    is left stay, with an empty text.

    Null and repeated ids, ties, null and very long texts, repeated rows and an empty table as in
    ``cut_repeats``: rows with one id do not cut each other, and each row comes back once. Other columns
    travel in one of their own, whatever their names."""
    out = _cut(repeated_spans(docs, id_col, text_col), F.col("row"), row=True)
    columns = {c: F.col("carried")[c] for c in docs.columns if c != text_col} | {text_col: F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])

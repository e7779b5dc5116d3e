"""Repeated word windows by prefix-partitioned suffix trees.

A window of WINDOW words stands twice if two suffixes of the corpus, each starting with a word, run
together that far: they then share an internal node of the suffix tree at that depth. The tree is
never built whole. Suffixes are dealt to groups by a prefix, each group's subtree fits in memory, and
only its nodes at the full depth are asked for.

A suffix for each of the corpus's words, with the words to compare, would shuffle some thirty times
the input. So the suffixes that are dealt start at anchors: of the PREFIX-word prefixes in a window
the least by a hash, the first of equals. Equal windows have it at the same place, so they meet in
one group, and a suffix brings the words of its windows before and behind the anchor.

1. Documents with the same words (SHA-256 of them, joined) are settled whole: all of their windows
   stand twice. One of them goes on, marked, for others to meet.
2. Anchors whose prefix stands once drop out, and then windows that stand once: both are told by
   32-bit names within ranges of a hash space, which can only keep too many. A task settles by itself
   what stands twice in its own rows and sends one entry for it, so a passage of a third of all
   documents meets once a task.
3. Prefixes are as long as they need be: a group of more than GROUP suffixes is parted by longer
   prefixes, of its windows themselves, LONGER words at a time. At the full length a group is one
   window, which needs no tree and is only streamed.
4. In each group the subtree is refined from the root, an edge at a time. An edge holds one or more
   words, numbered exactly; a suffix alone in its node is a leaf and drops out. The suffixes left at
   depth WINDOW are the repeated windows. Only bytes decide here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bucketed, discard, stored
from .repeats import _by_row, _dealt, _groups, _lists, _rows
from .text import Block, Fingerprints, blocks, mix, word_ids, words

WINDOW, PREFIX, LONGER = 35, 8, 9
REACH = WINDOW - PREFIX  # words of an anchor's windows on either side of it, at most
#: Suffixes of a group, beyond which its prefixes are made longer, and suffixes refined at once.
GROUP, REFINED = 20_000, 4_000
#: Entries of a task that are matched before they are sent.
FLUSH = 300_000
#: Bytes of text whose entries form a range of the hash space.
RANGE_BYTES = 4 << 20
_LEAD = 0xFFFFFFFF
_ENTRY = np.dtype([("place", "<u4"), ("a", "u1"), ("b", "u1")])  # word of the anchor; windows start b to a words before it
_SPAN = np.dtype([("first", "<u4"), ("last", "<u4")])  # starts of repeated windows
_FOUND = "key long, payload binary"
_SENT = "range long, direct boolean, n int, payload binary"
_SENT_ARROW = pa.schema([("range", pa.int64()), ("direct", pa.bool_()), ("n", pa.int32()), ("payload", pa.binary())])
_SUFFIX = "prefix long, twice boolean, key long, place long, a int, b int, text binary"
_SUFFIX_ARROW = pa.schema([("prefix", pa.int64()), ("twice", pa.bool_()), ("key", pa.int64()), ("place", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("text", pa.binary())])


def prefix_names(hashes: np.ndarray, width: int) -> np.ndarray:
    """Names of the ``width`` words from every word on; none for the last width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power, size, done = None, hashes, 1, 0
    while True:  # names of 1, 2, 4 .. words; those that width is made of, one after the other
        if width & size:
            more = power[done : done + n]
            out = more if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + more)
            done += size
        if done == width:
            return mix(out + np.uint64(width))
        power = mix(power[:-size] * np.uint64(0xD1B54A32D192ED03) + power[size:])
        size *= 2


class Suffixes:
    """The words of a block with their hashes, and what starts at each."""

    def __init__(self, block: Block):
        self.block = block
        self.words = words(block)
        self.hashes = Fingerprints(block.data).spans(self.words.start, self.words.end)
        self.first = self.words.first

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, word, first, last): the windows that start at words first..last have this anchor."""
        none = np.zeros(0, np.int64)
        size = np.diff(self.first)
        if not len(size) or size.max() < WINDOW:
            return none.astype(np.uint64), none, none, none
        names = least = prefix_names(self.hashes, PREFIX)
        at = np.arange(len(least), dtype=np.int64)
        have, width = 1, REACH + 1
        while have < width:
            step = min(have, width - have)
            right = least[step:] < least[:-step]
            least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
            have += step
        starts = self.starts()
        at = at[starts]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return names[at[head]], at[head], starts[head], starts[np.append(head[1:], len(starts)) - 1]

    def starts(self) -> np.ndarray:
        """The words that a window starts with."""
        whole = np.zeros(len(self.hashes) + 1, np.int64)
        size = np.diff(self.first)
        long = size >= WINDOW
        np.add.at(whole, self.first[:-1][long], 1)
        np.add.at(whole, self.first[1:][long] - WINDOW + 1, -1)
        return np.flatnonzero(np.cumsum(whole[:-1]))

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def listed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, anchor's word, first, last) of the entries of a column of lists."""
        row, entries = _lists(column, self.block.lo, self.block.hi, _ENTRY)
        at = self.first[row] + entries["place"]
        return row, at, at - entries["b"], at - entries["a"]


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, start) of the window starts first..last."""
    n = last - first + 1
    entry = np.repeat(np.arange(len(n)), n)
    return entry, first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)


def _entries(at: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), _ENTRY)
    out["place"], out["a"], out["b"] = at - begin, at - last, at - first
    return out


def _told(batches: Iterator[pa.RecordBatch], ranges: int, level: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, twice, text, entries) to packed names: of anchors, or of the windows of the entries.
    What two of the task's rows or places have goes straight on, with one entry for the range; so
    does what a marked row has."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        names, keys, entries, marked = (np.concatenate(c) for c in zip(*held, strict=True))
        names = mix(names)
        to = ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order, head, size = _groups(keys, names)
        known = np.logical_or.reduceat(marked[order], head) | (size > 1)
        twice = np.repeat(known, size)
        lead = np.zeros(len(order), bool)
        lead[head] = True
        sent = entries.copy()
        # for the range: its place is not asked for again, and it says that it stands here already
        sent["place"][order[lead & twice]] = _LEAD
        short, out = names.astype(np.uint32), []
        for direct, chosen, values in ((True, order[twice], entries), (False, order[lead | ~twice], sent)):
            if not len(chosen):
                continue
            dealt = (mix(keys[chosen].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64) if direct else to[chosen]
            by = np.lexsort((keys[chosen], dealt))
            chosen, dealt = chosen[by], dealt[by]
            cuts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = chosen[lo:hi]
                out.append((int(dealt[lo]), direct, len(part), short[part].tobytes() + np.diff(keys[part], prepend=0).tobytes() + values[part].tobytes()))
        return _rows(out, _SENT_ARROW)

    held, n = [], 0
    for batch in batches:
        keys, twice = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
        for block in blocks(batch.column(2)):
            suffixes = Suffixes(block)
            if level == "anchors":
                names, at, first, last = suffixes.anchors()
                row = suffixes.document(at)
            else:
                row, at, first, last = suffixes.listed(batch.column(3))
                if len(at):
                    entry, start = _each(first, last)
                    names = prefix_names(suffixes.hashes, WINDOW)[start]
                    row, at, first, last = row[entry], at[entry], start, start
            if not len(at):
                continue
            row_ = block.lo + row
            held.append((names, keys[row_], _entries(at, first, last, suffixes.first[row]), twice[row_]))
            n += len(at)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
    if n:
        yield flush(held)


def _standing(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_told``, sorted by range, to the entries whose name stands twice, dealt to buckets
    of rows. One range is held at a time."""

    def settled(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        names, keys, entries = (np.concatenate(c) for c in zip(*held, strict=True))
        order, head, size = _groups(keys, names)
        lead = entries["place"] == _LEAD
        found = order[np.repeat((size > 1) | np.logical_or.reduceat(lead[order], head), size)]
        found = found[~lead[found]]
        return keys[found], entries[found]

    at, held, out, n = None, [], [], 0
    for batch in batches:
        ranges, direct = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for i, (count, payload) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
            if held and ranges[i] != at:
                out.append(settled(held))
                n += len(out[-1][0])
                held = []
            at, raw = ranges[i], payload.as_py()
            entry = np.frombuffer(raw, np.uint32, count), np.cumsum(np.frombuffer(raw, np.int64, count, 4 * count)), np.frombuffer(raw, _ENTRY, count, 12 * count)
            if direct[i]:
                out.append(entry[1:])
                n += count
            else:
                held.append(entry)
            if n > FLUSH:
                yield _dealt(*(np.concatenate(c) for c in zip(*out, strict=True)), buckets)
                out, n = [], 0
    if held:
        out.append(settled(held))
    out = [x for x in out if len(x[0])]
    if out:
        yield _dealt(*(np.concatenate(c) for c in zip(*out, strict=True)), buckets)


def joined_runs(row: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of single windows to runs of next starts under one anchor."""
    order = np.lexsort((first, at, row))
    row, at, first, last = row[order], at[order], first[order], last[order]
    if not len(row):
        return row, at, first, last
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)]))
    return row[head], at[head], first[head], last[np.append(head[1:], len(row)) - 1]


class Prefixes:
    """What tells a suffix's group: the anchor's name, and for those of crowded groups the name of more
    and more words of the window itself. crowded: the names of the crowded groups, sorted."""

    def __init__(self, crowded: np.ndarray):
        self.crowded = crowded

    def _in(self, names: np.ndarray) -> np.ndarray:
        if not len(self.crowded):
            return np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.crowded, names), len(self.crowded) - 1)
        return self.crowded[at] == names

    def parted(self, suffixes: Suffixes, row, at, first, last) -> tuple[np.ndarray, ...]:
        """(prefix, row, anchor, first, last): runs as they are, or parted into windows."""
        names = prefix_names(suffixes.hashes, PREFIX)[at]
        open_ = self._in(names)
        done = [(names[~open_], row[~open_], at[~open_], first[~open_], last[~open_])]
        if open_.any():
            entry, start = _each(first[open_], last[open_])
            row, at, names = row[open_][entry], at[open_][entry], names[open_][entry]
            width = PREFIX
            while len(start):
                width = min(width + LONGER, WINDOW)
                # the anchor takes part, so a name is that of one length
                names = mix(prefix_names(suffixes.hashes, width)[start] + mix(names) + np.uint64(width))
                more = self._in(names) if width < WINDOW else np.zeros(len(names), bool)
                done.append((names[~more], row[~more], at[~more], start[~more], start[~more]))
                row, at, start, names = row[more], at[more], start[more], names[more]
        return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Suffixes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for block in blocks(batch.column(2)):
        suffixes = Suffixes(block)
        found = joined_runs(*suffixes.listed(batch.column(3)))
        if len(found[0]):
            yield suffixes, *found


def _group_sizes(batches: Iterator[pa.RecordBatch], crowded: Broadcast) -> Iterator[pa.RecordBatch]:
    """Different suffixes of each prefix, counted in the task."""
    prefixes, held = Prefixes(crowded.value), []

    def flush() -> pa.RecordBatch:
        names, count = np.unique(np.unique(np.concatenate(held), axis=0)[:, 0], return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count.astype(np.int64))], ["prefix", "n"])

    for batch in batches:
        for suffixes, *runs in _runs(batch):
            prefix, _, at, first, last = prefixes.parted(suffixes, *runs)
            # suffixes with the same windows are one: told by their first and last window
            window = prefix_names(suffixes.hashes, WINDOW)
            held.append(np.stack([prefix, window[first], window[last], (at - first).astype(np.uint64)], 1))
        if sum(map(len, held)) >= FLUSH:
            yield flush()
    if held:
        yield flush()


def _suffixes(batches: Iterator[pa.RecordBatch], crowded: Broadcast) -> Iterator[pa.RecordBatch]:
    """Suffixes with the words of their windows, joined by a space, under their prefix. Of those that
    the task has twice with all their words one goes on, marked; the others are settled (their text
    is null)."""
    prefixes = Prefixes(crowded.value)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        prefix, twice, key, place, a, b = (np.concatenate(c) for c in zip(*(h[:6] for h in held), strict=True))
        texts = [t for h in held for t in h[6]]
        seen: dict[tuple, int] = {}
        out: list[list] = []
        for i, one in enumerate(zip(prefix.tolist(), texts, a.tolist(), b.tolist(), strict=True)):
            at = seen.setdefault(one, len(out))
            if at < len(out):
                out[at][1] = True
                out.append([mix(key[i : i + 1].astype(np.uint64)).view(np.int64)[0], True, key[i], place[i], a[i], b[i], None])
            else:
                out.append([prefix[i], bool(twice[i]), key[i], place[i], a[i], b[i], texts[i]])
        for lo in range(0, len(out), 10_000):
            yield _rows([tuple(r) for r in out[lo : lo + 10_000]], _SUFFIX_ARROW)

    held, n = [], 0
    for batch in batches:
        keys, marked = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
        for suffixes, *runs in _runs(batch):
            prefix, row, at, first, last = prefixes.parted(suffixes, *runs)
            begin, end, data = suffixes.words.start, suffixes.words.end, suffixes.block.data
            texts = []
            for lo, hi in zip(begin[first].tolist(), end[last + WINDOW - 1].tolist(), strict=True):
                texts.append(data[lo:hi].tobytes())
            # gaps between words are of any white space: one space in their place
            texts = [b" ".join(t.split()) for t in texts]
            row_ = suffixes.block.lo + row
            held.append((prefix.view(np.int64), marked[row_], keys[row_], at - suffixes.first[row], at - last, at - first, texts))
            n += len(texts)
            if n >= FLUSH // 5:
                yield from flush(held)
                held, n = [], 0
    if held:
        yield from flush(held)


def repeated_windows(group: np.ndarray, texts: list[bytes], before: np.ndarray, count: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which windows stand twice, of suffixes of several groups: a mask over all windows, suffix by
    suffix. texts: the words of the suffix's windows, ``before`` of them in front of the anchor;
    ``count`` windows start at its first words. Windows of a marked suffix count as standing twice.

    The subtree is refined from its root, the group and the anchor's place in the window. An edge's
    words are numbered by pairs of numbers (of words, of two, of four ..), so that equal numbers mean
    equal words; a window alone in its node drops out.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    gap = np.flatnonzero(data == 0x20)
    start, end = np.append(0, gap + 1), np.append(gap, len(data))
    ids, _ = word_ids(data, start, end)
    size = count + WINDOW - 1
    first = np.cumsum(size) - size
    suffix, at = _each(first, first + count - 1)
    window = np.arange(len(at))
    node = np.unique(group[suffix] * (WINDOW + 1) + before[suffix] - (at - first[suffix]), return_inverse=True)[1]
    out = np.zeros(len(at), bool)
    # numbers of 1, 2, 4 .. words from each word on
    numbers, width, powers = ids, 1, []
    while width <= WINDOW:
        powers.append((width, numbers))
        if width * 2 > WINDOW or len(numbers) <= width:
            break
        numbers = np.unique(numbers[:-width] * (int(numbers.max()) + 1) + numbers[width:], return_inverse=True)[1]
        width *= 2
    depth = 0
    while len(window):
        many = np.bincount(node)[node] > 1
        some = np.zeros(int(node.max()) + 1, bool)
        some[node[twice[suffix]]] = True
        many |= some[node]
        window, node, at, suffix = window[many], node[many], at[many], suffix[many]
        if depth == WINDOW or not len(window):
            break
        width, numbers = next(p for p in reversed(powers) if p[0] <= WINDOW - depth)
        node = np.unique(node * (int(numbers.max()) + 1) + numbers[at + depth], return_inverse=True)[1]
        depth += width
    out[window] = True
    return out


def _repeated(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Suffixes, sorted by prefix, text, a and b, to the starts of repeated windows, dealt to buckets.
    Of equal suffixes the first is held, so what is held of a group are its different suffixes."""
    spans: list[tuple] = []
    held: list[tuple] = []  # prefix, twice, key, place, a, b, text of the groups not yet refined

    def span(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        values = np.empty(len(key), _SPAN)
        values["first"], values["last"] = first, last
        spans.append((key, values))

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(k) for k, _ in spans) > least:
            yield _dealt(*(np.concatenate(c) for c in zip(*spans, strict=True)), buckets)
            spans.clear()

    def refined(rows: list[tuple]) -> None:
        prefix, twice, key, place, a, b, texts = zip(*rows, strict=True)
        key, place, a, b, twice = np.array(key), np.array(place), np.array(a), np.array(b), np.array(twice, bool)
        group = np.unique(np.array(prefix), return_inverse=True)[1]
        count = b - a + 1
        # a run's windows start b..a words before the anchor
        good = repeated_windows(group, list(texts), b, count, twice)
        owner, start = _each(place - b, place - a)
        owner, start = owner[good], start[good]
        if len(owner):
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]))
            span(key[owner[head]], start[head], start[np.append(head[1:], len(owner)) - 1])

    last = None  # the suffix met last: (prefix, text, a, b)
    for batch in batches:
        settled = batch.filter(batch.column(6).is_null())
        if settled.num_rows:
            key, place, a, b = (np.asarray(settled.column(i)).astype(np.int64) for i in (2, 3, 4, 5))
            span(key, place - b, place - a)
        rows = batch.filter(batch.column(6).is_valid())
        for prefix, twice, key, place, a, b, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if held and prefix != held[-1][0] and len(held) >= REFINED:
                refined(held)
                held.clear()
            if (prefix, text, a, b) == last:
                span(np.array([key]), np.array([place - b]), np.array([place - a]))
                if held and held[-1][6] == text:
                    held[-1] = (held[-1][0], True, *held[-1][2:])
                continue
            last = (prefix, text, a, b)
            held.append((prefix, twice, key, place, a, b, text))
        yield from flushed(FLUSH)
    if held:
        refined(held)
    yield from flushed(0)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc, text, digest): digest names the row's word sequence, null under WINDOW words."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column(2)):
                size = np.diff(words(block).first)
                for n, lo, hi in zip(size, block.offsets[:-1], block.offsets[1:], strict=True):
                    found.append(hashlib.sha256(b" ".join(block.data[lo:hi].tobytes().split())).digest() if n >= WINDOW else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["key", "doc", "text", "digest"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return bucketed(rows.mapInArrow(digests, "key long, doc long, text string, digest binary"), "key", "words")


def window_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc, text, copy, spans): every row with whether its whole word sequence stands in another
    row too, and the starts of its repeated windows as packed ranges."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, id_col, text_col)
    long = texts.filter("digest IS NOT NULL")
    # the keys of a word sequence are gathered a part of the table at a time, so that a sequence which
    # very many rows have comes to a task with one row a part
    some = long.groupBy("digest", F.shiftright("key", 33).alias("part")).agg(F.collect_list("key").alias("keys"), F.min("key").alias("first"), F.count("*").alias("n"))
    firsts = some.groupBy("digest").agg(F.min("first").alias("least"), F.sum("n").alias("n")).filter("n > 1").select("digest", "least")
    copies = some.join(firsts, "digest").select(F.explode("keys").alias("key"), "least").select("key", (F.col("key") == F.col("least")).alias("goes_on"))
    copies = stored(copies.repartition(parts, "key"), "copies")
    marked = long.select("key", "text").join(copies.hint("shuffle_hash"), "key", "left").filter("goes_on IS NULL OR goes_on")
    marked = marked.select("key", F.col("goes_on").isNotNull().alias("twice"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, size // RANGE_BYTES)

    def standing(rows: DataFrame, level: str) -> DataFrame:
        told = rows.mapInArrow(partial(_told, ranges=ranges, level=level), _SENT)
        found = told.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(partial(_standing, buckets=parts), _FOUND)
        return stored(found.repartition(parts, "key").mapInArrow(_by_row(_ENTRY), _FOUND), level)

    anchors = standing(marked.withColumn("entries", F.lit(None).cast("binary")), "anchors")
    rows = marked.join(anchors.withColumnRenamed("payload", "entries").hint("shuffle_hash"), "key")
    windows = standing(rows, "windows")
    discard(anchors)
    rows = marked.join(windows.withColumnRenamed("payload", "entries").hint("shuffle_hash"), "key")
    crowded = np.zeros(0, np.uint64)
    while True:
        sizes = rows.mapInArrow(partial(_group_sizes, crowded=spark.sparkContext.broadcast(crowded)), "prefix long, n long")
        # at most the suffixes divided by GROUP
        new = [r.prefix for r in sizes.groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP).collect()]
        more = np.setdiff1d(np.array(new, np.int64).view(np.uint64), crowded)
        if not len(more):
            break
        crowded = np.union1d(crowded, more)
    suffixes = rows.mapInArrow(partial(_suffixes, crowded=spark.sparkContext.broadcast(crowded)), _SUFFIX)
    dealt = suffixes.repartition(parts, "prefix").sortWithinPartitions("prefix", "text", "a", "b")
    spans = dealt.mapInArrow(partial(_repeated, buckets=parts), _FOUND)
    spans = stored(spans.repartition(parts, "key").mapInArrow(_by_row(_SPAN), _FOUND), "spans").withColumnRenamed("payload", "spans")
    discard(windows)
    whole = copies.select("key", F.lit(True).alias("copy"))
    out = texts.select("key", "doc", "text").join(whole.hint("shuffle_hash"), "key", "left").join(spans.hint("shuffle_hash"), "key", "left")
    return out.withColumn("copy", F.coalesce("copy", F.lit(False)))


def cut_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, n_words, n_removed, kept_sha256 and kept (the words left, joined by a space) of
    every row.

    Words are runs outside U+0020 and U+0009 to U+000D, unchanged. Removed is each word covered by a
    window of WINDOW words that also starts anywhere else, in this row or another; windows are judged
    on the input.

    Ids are carried, never compared: null and repeated ids are rows of their own, and rows with the
    same text remove each other. Null text has no words; a text under WINDOW words keeps all. Equal
    windows that overlap in one text all count. A very long text is handled whole (a task holds it
    and some ten times its size). An empty table gives an empty result; other columns are left out.
    """

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            for block in blocks(batch.column(1)):
                found = words(block)
                gone = np.zeros(len(found.start) + 1, np.int32)
                row, spans = _lists(batch.column(3), block.lo, block.hi, _SPAN)
                np.add.at(gone, found.first[row] + spans["first"], 1)
                np.add.at(gone, found.first[row] + spans["last"] + WINDOW, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for i, (lo, hi) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
                    gone[lo:hi] |= copies[block.lo + i]
                rows = []
                for lo, hi in zip(found.first[:-1], found.first[1:], strict=True):
                    own = ~gone[lo:hi]
                    kept = b" ".join(_kept_words(block.data, found.start[lo:hi], found.end[lo:hi], own))
                    rows.append((int(hi - lo), int(hi - lo - own.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), *columns], ["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    found = window_spans(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col).select("doc", "text", "copy", "spans")
    out = found.mapInArrow(finished, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def _kept_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> Iterator[bytes]:
    """Words that stay, a run at a time."""
    if not own.any():
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        yield b" ".join(data[start[lo] : end[hi - 1]].tobytes().split())


def oracle(table: str = "documents") -> str:
    """The same by DuckDB from all windows."""
    return rf"""WITH listed AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {table}),
windows AS MATERIALIZED (SELECT r, i, sha256(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM listed)),
twice AS (SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + unnest(range({WINDOW})) AS i FROM twice),
kept AS (SELECT l.r, string_agg(l.w, ' ' ORDER BY l.i) AS kept, count(*) AS n FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed) l ANTI JOIN gone g ON g.r = l.r AND g.i = l.i GROUP BY l.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM listed LEFT JOIN kept USING (r)"""

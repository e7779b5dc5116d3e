"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are runs of ASCII letters, digits and bytes above 127, with ASCII and Latin-1 capitals
lowered, so a moved full stop is no edit. A sketch hashes every five-word shingle together with
its occurrence number, takes the two least, and keeps them in the order of the text; two texts
agree in a sketch with a chance that follows their edit similarity. In a short text a few edits
leave no two shingles of five words, so texts under 40 words have sketches of two-word shingles
too. Texts that agree in a sketch are candidates, and alignment decides: similarity is
1 - distance / longer length, in words.

Steps: equal word sequences are one node; nodes that share a sketch are paired with the sketch's
first node and with the next by length; each node's best-supported pairs are aligned first, their
components are joined, and every remaining pair across components is aligned after that. A sketch
value whose nodes are still in several components is then compared whole: all of its pairs across
components that lengths and word counts allow are aligned. A pair within a component needs no
alignment, as it cannot change a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import bucketed, discard, stored
from .text import Block, Fingerprints, blocks, mix

SHINGLE = 5
SKETCHES = 80
SIMILARITY = 0.8
#: Texts of fewer words have sketches of shorter shingles; of at least the share SIMILARITY of as many, of SHINGLE words.
SHORT, SHORT_SHINGLE, SHORT_SKETCHES = 40, 2, 32
#: Buckets of a text's word counts (first compared in COARSE sums), and nodes of a crowded sketch value
#: that are compared at a time.
BAG, COARSE = 512, 64
CROWD = 4096

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Tokens(NamedTuple):
    hashes: np.ndarray
    first: np.ndarray  # of document i: words first[i] .. first[i + 1]


def tokens(block: Block) -> Tokens:
    """Word hashes of the documents of a block."""
    data = block.data
    n = len(data)
    letter = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:n]
    end[:-1] &= ~letter[1:] | edge[1:n]
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    latin = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    lower[1:][latin] += 32
    begins = np.flatnonzero(start)
    return Tokens(Fingerprints(lower).spans(begins, np.flatnonzero(end) + 1), np.searchsorted(begins, block.offsets))


def _sequence(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a word sequence."""
    if not len(hashes):
        return 0, 0
    at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    n = np.array([len(hashes)], np.uint64)
    a = mix(np.bitwise_xor.reduce(mix(hashes + mix(at)), keepdims=True) + n)
    b = mix(mix(hashes ^ mix(at * np.uint64(0xD1B54A32D192ED03))).sum(dtype=np.uint64, keepdims=True) + n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _shingles(words: Tokens, width: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, hash) of the occurrence-labelled shingles of the documents with least..most
    words; a document under ``width`` words has one, of all its words. begin: each document's first."""
    n = np.diff(words.first)
    doc = np.flatnonzero((n >= max(least, 1)) & (n <= most))
    count = np.maximum(n[doc] - width + 1, 1)
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(doc)), count)
    at = words.first[doc][owner] + np.arange(len(owner)) - begin[owner]
    hashes = np.zeros(len(at), np.uint64)
    left = np.minimum(n[doc], width)[owner]
    for i in range(width):
        more = left > i
        hashes[more] = mix(hashes[more] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[at[more] + i])
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    head = np.flatnonzero(new)
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return doc, begin, mix(hashes + mix(nth + np.uint64(1)))


def _minima(labelled: np.ndarray, begin: np.ndarray, sketches: int, salt: int) -> np.ndarray:
    """(documents x sketches): in each sketch's order the two least shingles, in the order of the text."""
    size = np.diff(np.append(begin, len(labelled)))
    out = np.empty((len(begin), sketches), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(sketches):
        # an odd multiplier for each sketch puts the mixed hashes, all different, in another order
        values = labelled * (mix(np.array([i + salt + 1], np.uint64))[0] | np.uint64(1))
        places = []
        for _ in range(2):
            found = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, begin), size))
            found = found[np.searchsorted(found, begin)]  # one a document, also where two agree
            values[found] = top
            places.append(found)
        one, two = np.minimum(*places), np.maximum(*places)
        alone = size == 1
        out[:, i] = mix(labelled[one] * np.uint64(0x9FB21C651E98DF25) + np.where(alone, np.uint64(0), labelled[two]) + np.uint64(i + salt))
    return out


def sketches_of(words: Tokens, sketches: int = SKETCHES) -> list[np.ndarray]:
    """Order MinHash values of each document; none without words."""
    n = len(words.first) - 1
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    short = max(1, sketches * SHORT_SKETCHES // SKETCHES)
    every = np.iinfo(np.int64).max
    for width, least, most, count, salt in ((SHINGLE, 0, every, sketches, 0), (SHORT_SHINGLE, SHORT_SHINGLE + 1, SHORT - 1, short, 1 << 20)):
        doc, begin, labelled = _shingles(words, width, least, most)
        if len(doc):
            for i, values in zip(doc, _minima(labelled, begin, count, salt), strict=True):
                found[i].append(values)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]


def sketch(hashes: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Order MinHash of one word sequence."""
    return sketches_of(Tokens(hashes, np.array([0, len(hashes)])), sketches)[0]


def banded_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences, or limit + 1 if it is larger.

    The band of ``2 * limit + 1`` diagonals is kept as bit vectors of vertical differences that
    slide down one row a column; whole integers hold the band, so a column costs a few operations.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= limit else limit + 1
    band = min(limit, max(n, m))
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    mask = (1 << 2 * band + 1) - 1
    up = mask >> band << band  # vertical +1 from row 1 on, in the window of column 1
    down, score = 0, min(band, n)  # score: the lowest row of the band, of column 0
    bottom = 1 << 2 * band
    for j in range(1, m + 1):
        found = rows.get(b[j - 1], 0)
        shift = j - band - 1  # bit 0 is row j - band, whose word is a[j - band - 1]
        equal = (found >> shift if shift >= 0 else found << -shift) & mask
        same = (((equal & up) + up) ^ up) & mask | equal | down
        right = down | mask & ~(same | up)
        left = same & up
        if j + band <= n:
            score += not same & bottom
        else:
            row = 1 << n - j + band
            score += bool(right & row) - bool(left & row)
        below = same >> 1
        up = left | mask & ~(below | right)
        down = below & right
    return score if score <= limit else limit + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word-hash sequences have at least this edit similarity."""
    longer = max(len(a), len(b))
    limit = int(longer * (1 - least) + 1e-9)
    if not longer or abs(len(a) - len(b)) > limit:
        return False
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:
        return False
    return banded_distance(a.tolist(), b.tolist(), limit) <= limit


def bags(words: Tokens) -> np.ndarray:
    """Word counts of each document by bucket of the word's hash, up to 255.

    An edit moves one count up, one down, or both, so the distance of two texts is at least what
    either has more than the other, summed over the buckets.
    """
    n = len(words.first) - 1
    at = np.repeat(np.arange(n), np.diff(words.first)) * BAG + (words.hashes % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BAG), 255).astype(np.uint8).reshape(n, BAG)


def _signatures(rows: DataFrame, sketches: int) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                words = tokens(block)
                names = [_sequence(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                first, second = zip(*names, strict=True)
                part = batch.slice(block.lo, block.hi - block.lo)
                found = [x.tobytes() for x in sketches_of(words, sketches)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(words.first).astype(np.int64)), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(found, pa.binary()), pa.array([x.tobytes() for x in bags(words)], pa.binary())],
                    ["key", "doc", "n", "a", "b", "sketch", "bag"],
                )

    return rows.mapInArrow(signed, "key long, doc long, n long, a long, b long, sketch binary, bag binary")


def _agreeing(nodes: DataFrame, parts: int, least: float) -> DataFrame:
    """Candidate pairs (key, low, high) of the nodes (node, n, sketch), and the members (key, low, null)
    of the sketch values that two nodes or more have.

    A batch of nodes pairs up what it can by itself and sends on one node a sketch value, so a
    value that a third of all nodes share meets once a batch and not once a node.
    """

    def linked(keys, node, n) -> tuple:
        """Places of the values' first nodes, of the members of those with several; then the pairs."""
        order = np.lexsort((node, n, keys))
        keys, node, n = keys[order], node[order], n[order]
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(keys)))
        group = np.cumsum(head) - 1
        rest = np.flatnonzero(~head)
        low, high = np.concatenate([begin[group][rest], rest - 1]), np.concatenate([rest, rest])
        longer = np.maximum(n[low], n[high])
        close = (node[low] != node[high]) & (np.abs(n[low] - n[high]) <= (1 - least) * longer + 1e-9)
        low, high = order[low[close]], order[high[close]]
        return order[begin], order[np.repeat(size > 1, size)], low, high

    def batch_of(key, node, n, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(n), pa.array(other)], ["key", "node", "n", "other"])

    def found(key, node, n) -> tuple:
        """Pairs and members as rows with n = 0; other is -1 for a member."""
        leads, members, low, high = linked(key, node, n)
        one, two = np.minimum(node[low], node[high]), np.maximum(node[low], node[high])
        rows = [np.concatenate(x) for x in ((key[low], key[members]), (one, node[members]), (two, np.full(len(members), -1)))]
        return leads, rows

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            lists = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            count = np.array([len(x) for x in lists])
            if not count.sum():
                continue
            keys, node, n = np.concatenate(lists), np.repeat(own, count), np.repeat(size, count)
            leads, (key, low, high) = found(keys, node, n)
            yield batch_of(keys[leads], node[leads], n[leads], np.full(len(leads), -1))
            if len(low):
                yield batch_of(key, low, np.zeros(len(low), np.int64), high)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out(key, low, high) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(low), pa.array(high, mask=high < 0)], ["key", "low", "high"])

        for batch in batches:
            key, node, n, other = (np.asarray(c) for c in batch.columns)
            direct = n == 0
            if direct.any():
                yield out(key[direct], node[direct], other[direct])
            held.append((key[~direct], node[~direct], n[~direct]))
        if held:
            _, rows = found(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if len(rows[0]):
                yield out(*rows)

    dealt = nodes.mapInArrow(sent, "key long, node long, n long, other long").repartition(parts, "key")
    return dealt.mapInArrow(met, "key long, low long, high long")


def crossing(n: np.ndarray, label: np.ndarray, side: np.ndarray, bag: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, int]]:
    """Places (of one side, of the other) of the pairs with different labels whose lengths and word
    counts allow the similarity.

    side tells which of two blocks a node is of; pairs are between the blocks, or all of them
    where the nodes are of one block.
    """
    order = np.argsort(n, kind="stable")
    n, label, side, bag = n[order], label[order], side[order], bag[order]
    total = bag.sum(axis=1, dtype=np.int64)
    coarse = bag.reshape(len(bag), -1, COARSE).sum(axis=1, dtype=np.uint16)
    two = side.min() != side.max()
    limits = (n * (1 - least) + 1e-9).astype(np.int64)  # of a pair: that of its longer text
    begin = np.searchsorted(n, n - limits)
    for i in range(1, len(n)):
        near = slice(begin[i], i)
        other = label[near] != label[i]
        if two:
            other &= side[near] != side[i]
        at = np.flatnonzero(other) + begin[i]
        for counts in (coarse, bag):
            if len(at):
                union = np.maximum(counts[at], counts[i]).sum(axis=1, dtype=np.int64)
                at = at[union - np.minimum(total[at], total[i]) <= limits[i]]
        if len(at):
            yield order[at], int(order[i])


def _crowded(members: DataFrame, labels: DataFrame, nodes: DataFrame, parts: int, least: float) -> DataFrame:
    """Every pair (low, high) of the members (key, node) of a sketch value that are in different
    components (node, label; else a component of its own) and may be similar, once: under the first
    sketch that both have the same. nodes: (node, n, bag, sketch).

    Only sketch values with several components are dealt out. Those of more than CROWD nodes are
    split into blocks, and each two blocks meet in a group of their own.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, node, n, label, side = (table.column(c).to_numpy() for c in ("key", "node", "n", "label", "side"))
            bag = np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
            lists = table.column("sketch").to_pylist()
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                if hi - lo < 2:
                    continue
                width = max(map(len, lists[lo:hi]))
                sketches = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in lists[lo:hi]), np.int64).reshape(hi - lo, -1)
                for some, one in crossing(n[lo:hi], label[lo:hi], side[lo:hi], bag[lo:hi], least):
                    equal = sketches[some] == sketches[one]
                    some = some[sketches[one][equal.argmax(1)] == key[lo]]
                    if len(some):
                        a, b = node[lo + some], np.full(len(some), node[lo + one])
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["low", "high"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            group = [table.column(c).to_numpy() for c in ("key", "one", "two")]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in group], axis=0)) + 1
            if len(ends):
                yield from pairs(table.slice(0, ends[-1]), ends)
            rest = table.slice(ends[-1] if len(ends) else 0).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from pairs(rest, np.array([rest.num_rows]))

    n_members = members.count()
    known = members.distinct().join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("key", F.ceil(F.col("size") / CROWD).alias("blocks"))
    held = stored(known.join(mixed, "key"), "mixed", n_members).join(nodes, "node").withColumn("side", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = held.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"), "node", "n", "label", "side", "bag", "sketch")
    sorted_ = dealt.repartition(parts, "key", "one", "two").sortWithinPartitions("key", "one", "two")
    return sorted_.mapInArrow(met, "low long, high long")


def _verified(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts align. rows are bucketed by key: pairs go to the texts, and of the two
    texts of a pair one moves, once it is known to be in a pair."""
    one, two = (rows.select(F.col("key").alias(k), F.col("text").alias(t)) for k, t in (("low", "one"), ("high", "two")))
    both = one.join(pairs.select("low", "high").hint("shuffle_hash"), "low")
    both = two.join(both.hint("shuffle_hash"), "high")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sides = []
                for name in ("one", "two"):
                    found = []
                    for block in blocks(part.column(part.schema.get_field_index(name))):
                        words = tokens(block)
                        found += [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                    sides.append(found)
                good = pa.array([similar(a, b, least) for a, b in zip(*sides, strict=True)], pa.bool_())
                yield part.select(["low", "high"]).filter(good)

    return both.select("low", "high", "one", "two").mapInArrow(aligned, "low long, high long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is its component's least node.

    Alternating stars: each node's larger neighbours are tied to its least neighbour, then its
    smaller ones are, until every component is a star about its least node. Each round starts from
    a stored table.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("node", "next").union(edges.select("next", "node"))
        centre = both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("label"))
        if large:
            return both.filter("next > node").join(centre, "node").select(F.col("next").alias("node"), F.col("label").alias("next")).distinct()
        below = both.filter("next < node").join(centre, "node")
        moved = below.filter("next <> label").select(F.col("next").alias("node"), F.col("label").alias("next"))
        return moved.union(centre.filter("label <> node").select("node", F.col("label").alias("next"))).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "next").cast("decimal(38,0)"))).first())

    edges = stored(links.select(F.col("high").alias("node"), F.col("low").alias("next")).distinct(), "edges", links.count())
    last = state(edges)
    while True:
        after = stored(star(star(edges, True), False), "edges", 2 * last[0])
        now = state(after)
        discard(edges)
        edges = after
        if now == last:
            centres = edges.select(F.col("next").alias("node")).distinct().withColumn("label", F.col("node"))
            return edges.select("node", F.col("next").alias("label")).union(centres)
        last = now


def _classes(texts: DataFrame, least: float, sketches: int, first_pairs: int) -> DataFrame:
    """(key, doc, n, class_id) of the rows (key, doc, text), which are stored bucketed by key."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = texts.select("key", "text")
    whole = stored(_signatures(texts, sketches), "sketches")
    groups = stored(whole.filter("n > 0").groupBy("a", "b").agg(F.min("key").alias("node"), F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bag").alias("bag")), "nodes")
    signed = whole.select("key", "doc", "n", "a", "b")
    agreeing = stored(_agreeing(groups.select("node", "n", "sketch"), parts, least), "agreeing")
    pairs = stored(agreeing.filter("high IS NOT NULL").groupBy("low", "high").agg(F.count("*").alias("support")), "pairs")
    n_pairs = pairs.count()
    both = pairs.select(F.col("low").alias("own"), "low", "high", "support").union(pairs.select(F.col("high").alias("own"), "low", "high", "support"))
    best = Window.partitionBy("own").orderBy(F.desc("support"), "low", "high")
    first = stored(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first_pairs).select("low", "high").distinct(), "tried", n_pairs)
    links = stored(_verified(first, known, least), "links")
    labels = components(links)
    side = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    across = pairs.join(side("low"), "low", "left").join(side("high"), "high", "left").filter(F.coalesce("low_label", "low") != F.coalesce("high_label", "high"))
    across = stored(across.select("low", "high").join(first, ["low", "high"], "left_anti"), "across", n_pairs)
    more = stored(_verified(across, known, least), "links")
    links = links.union(more)
    labels = components(links)
    members = agreeing.filter("high IS NULL").select("key", F.col("low").alias("node"))
    left = _crowded(members, labels, groups.select("node", "n", "bag", "sketch"), parts, least)
    left = stored(left.join(first.union(across), ["low", "high"], "left_anti"), "crowded")
    labels = components(links.union(stored(_verified(left, known, least), "links")))
    labelled = groups.join(labels, "node", "left").select("a", "b", "doc", F.coalesce("label", "node").alias("label"))
    classes = labelled.join(labelled.groupBy("label").agg(F.min("doc").alias("class_id")), "label").select("a", "b", "class_id")
    out = signed.join(classes, ["a", "b"], "left").select("key", "doc", "n", F.coalesce("class_id", "doc").alias("class_id"))
    out = stored(out, "classes")
    discard(whole, groups, agreeing, pairs, first, across, left)
    return out


def near_copies(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, first_pairs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, n_words and class_id of every row: rows with one class_id are near copies of one
    another, directly or through others; class_id is the class's least id.

    Two texts are linked if their words' edit similarity is at least ``least``. Texts of equal
    words are one node; links are sought where two texts agree in one of ``sketches`` sketches.
    At a similarity of just 0.8, with the edits spread at random, a pair does so with a
    probability of 0.95; texts of under 40 words, with over 0.99.

    Ids are whole numbers. A null id has a null class and takes no part. Text that is null or without
    a word is like no other and keeps its own id. Rows that share an id are rows of their own: each
    has the class of its own text; repeated rows are each returned. A very long text is handled
    whole: its sketches and words take some twenty times its size in one task. An empty table gives
    an empty result; other columns are left out.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("doc"), text.alias("text"))
    known = bucketed(rows.filter("doc IS NOT NULL").select(F.monotonically_increasing_id().alias("key"), "doc", "text"), "key", "texts")
    out = _classes(known, least, sketches, first_pairs).select("doc", "n", "class_id")
    discard(known)
    out = out.unionByName(rows.filter("doc IS NULL").select("doc", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("class_id")))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_words"), F.col("class_id").cast(kind).alias("class_id"))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, first_pairs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose class has a smaller id.

    Rows are dropped one by one, not by their id: of rows that share an id each stays or goes by its
    own text, and rows that repeat the class's least id stay. Rows without an id, and with null
    text or without a word, stay. Very long texts and empty tables as in ``near_copies``; other
    columns are carried inside one of their own, so no name can clash.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = bucketed(docs.select(F.monotonically_increasing_id().alias("key"), kept.alias("row")), "key", "rows")
    texts = rows.select("key", F.col("row")[id_col].cast("long").alias("doc"), F.col("row")[text_col].alias("text")).filter("doc IS NOT NULL")
    copies = _classes(texts, least, sketches, first_pairs).filter("doc > class_id").select("key")
    # keys go to the buckets of the rows, at any number of them
    return rows.join(copies.hint("shuffle_hash"), "key", "left_anti").select("row.*")

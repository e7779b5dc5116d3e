"""Phrase collocations from depth-limited count tries.

A task folds its documents into a trie of word paths with counts, up to DEPTH words deep. A full trie
is serialised in the order of its phrases; Spark deals the sorted entries of all tries to ranges of
phrases and merges them there, so equal phrases stand next to each other and their counts add up. In
the merged trie the first words of a phrase are its ancestors (a walk to the parents gives left
counts) and its last words are reached by suffix links (right counts).

Only phrases that occur ``least`` times matter, and no phrase occurs more often than a part of it, so a
first pass counts words and pairs of words by 64-bit names, packed in ranges of their space, and the
tries grow only along words and pairs that are frequent by that count. What is frequent travels as a
Bloom filter of at most MOST_BITS bits. A chance agreement of names, or a chance hit of the filter, only
lets a phrase be counted that its exact count then drops; beyond that size the filter passes more, and
the counts stay right. All counts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import discard, stored
from .text import Block, Fingerprints, blocks, mix, word_ids

DEPTH, LEAST, SCORE, SHARE, TOP = 4, 30, 2_000_000, 80, 2000
#: Words whose trie a task grows before it serialises it, and names that it folds before it sends them.
SHARD_WORDS, FOLDED = 400_000, 1_000_000
#: Bytes of text whose names form a range of their space.
RANGE_BYTES = 2 << 20
#: The filter: bits for each entry, and of all at most (64 MB); it travels in chunks of this many bits.
ENTRY_BITS, MOST_BITS, CHUNK_BITS = 16, 1 << 29, 1 << 19
_COUNTED = "lang string, phrase string, words int, f long"
_NAMED = np.dtype([("low", "<u4"), ("high", "u1"), ("n", "<u2")])  # 40 bits of a name, and its count up to 65,535
_MANY = 65_535

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def piece_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, piece, document) of the words of a block; words with one piece
    number are of one piece."""
    data = block.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    n = len(data)
    letter = ~_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    head, tail = letter.copy(), letter.copy()
    head[1:] &= ~letter[:-1] | edge[1:n]
    tail[:-1] &= ~letter[1:] | edge[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    breaks = np.zeros(n + 1, np.int64)
    breaks[:n] += _BREAK[data]
    breaks[:n] += edge[:n]
    document = np.searchsorted(block.offsets, start, "right") - 1
    return data, start, end, np.cumsum(breaks)[start] if n else start, document


def named(langs: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """64-bit names of phrases in a language, from the hashes of both."""
    name = mix(langs)
    for word in words:
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + word)
    return name


def keys_of(names: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, 40 bits, key) of names: the key is made of the other two. Ranges follow the names' order."""
    to = (names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    low = names & np.uint64((1 << 40) - 1)
    return to, low, mix(to * np.uint64(0x9E3779B97F4A7C15) + low)


class Spoken:
    """The words of a block, with the names of each and of each with the next one of its piece."""

    def __init__(self, block: Block, langs: list[str]):
        self.data, self.start, self.end, piece, self.document = piece_words(block)
        hashes = Fingerprints(self.data).spans(self.start, self.end)
        text = "".join(langs).encode()
        end = np.cumsum([len(x.encode()) for x in langs])
        of = Fingerprints(np.frombuffer(text, np.uint8)).spans(np.append(0, end[:-1]), end)[self.document]
        self.follows = np.zeros(len(hashes), bool)  # the next word is of the same piece
        self.follows[:-1] = piece[1:] == piece[:-1]
        at = np.flatnonzero(self.follows)
        self.words, self.pairs = named(of, hashes), named(of[at], hashes[at], hashes[at + 1])


def _named(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to the counted names of their words and pairs, packed by range."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        names, count = np.unique(np.concatenate(held), return_counts=True)
        to, low, _ = keys_of(names, ranges)
        packed = np.empty(len(names), _NAMED)
        packed["low"], packed["high"], packed["n"] = low & np.uint64(0xFFFFFFFF), low >> np.uint64(32), np.minimum(count, _MANY)
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        payloads = [packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]].astype(np.int64)), pa.array(payloads, pa.binary())], ["range", "payload"])

    held: list[np.ndarray] = []
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            spoken = Spoken(block, langs[block.lo : block.hi])
            held += [spoken.words, spoken.pairs]
            if sum(map(len, held)) >= FOLDED:
                yield flush(held)
                held = []
    if sum(map(len, held)):
        yield flush(held)


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_named``, sorted by range, to the keys of the frequent names. One range is held."""

    def done(at: int, held: list[bytes]) -> pa.RecordBatch:
        packed = np.frombuffer(b"".join(held), _NAMED)
        low, back = np.unique(packed["low"].astype(np.uint64) | packed["high"].astype(np.uint64) << np.uint64(32), return_inverse=True)
        low = low[np.bincount(back, packed["n"]) >= min(least, _MANY)]
        keys = mix(np.full(len(low), at, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    at, held = None, []
    for batch in batches:
        for to, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and to != at:
                yield done(at, held)
                held = []
            at = to
            held.append(payload)
    if held:
        yield done(at, held)


class Filter:
    """A blocked Bloom filter: the two bits of a name lie in one chunk."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits = bits
        self.data = np.frombuffer(b"".join(chunks.get(i, bytes(CHUNK_BITS // 8)) for i in range(bits // CHUNK_BITS)), np.uint8)

    @staticmethod
    def places(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, first, second bit in it)."""
        h = mix(names ^ np.uint64(0xD1B54A32D192ED03))
        low = np.uint64(CHUNK_BITS - 1)
        return ((h >> np.uint64(40)) % np.uint64(bits // CHUNK_BITS)).astype(np.int64), (h & low).astype(np.int64), (h >> np.uint64(20) & low).astype(np.int64)

    def has(self, names: np.ndarray) -> np.ndarray:
        chunk, one, two = self.places(names, self.bits)
        found = np.ones(len(names), bool)
        for at in (one, two):
            at = at + chunk * CHUNK_BITS
            found &= self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return found


class Trie:
    """Counts of the word paths of a shard's documents, along frequent words and pairs."""

    def __init__(self, depth: int, filter_: Filter, ranges: int):
        self.depth, self.filter, self.ranges = depth, filter_, ranges
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.totals: list[int] = []
        self.held: list[tuple] = []
        self.size = 0

    def _has(self, names: np.ndarray) -> np.ndarray:
        return self.filter.has(keys_of(names, self.ranges)[2])

    def add(self, block: Block, langs: list[str]) -> None:
        spoken = Spoken(block, langs)
        of = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)[spoken.document]
        self.totals += [0] * (len(self.langs) - len(self.totals))
        for i, n in enumerate(np.bincount(of, minlength=len(self.langs)).tolist()):
            self.totals[i] += n
        self.size += len(of)
        known = self._has(spoken.words)
        goes_on = spoken.follows.copy()
        goes_on[goes_on] = self._has(spoken.pairs)
        goes_on[:-1] &= known[1:]
        at = np.flatnonzero(known)
        own, texts = word_ids(spoken.data, spoken.start[at], spoken.end[at])
        ids = np.array([self.words.setdefault(t, len(self.words)) for t in texts], np.int64)
        if len(at):
            self.held.append((ids[own], of[at], goes_on[at]))

    def paths(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(language, word ids a level, count) of the nodes, level by level. A node is its parent's
        number and its last word; the root's children are the languages."""
        word, lang, goes_on = (np.concatenate(x) for x in zip(*self.held, strict=True))
        node, at = lang, np.arange(len(word))
        path, of = np.zeros((len(self.langs), 0), np.int64), np.arange(len(self.langs))
        for depth in range(1, self.depth + 1):
            if depth > 1:  # where the next word follows, it is the next one kept
                on = goes_on[at + depth - 2]
                node, at = node[on], at[on]
            if not len(at):
                return
            key, node, count = np.unique(node * len(self.words) + word[at + depth - 1], return_inverse=True, return_counts=True)
            parent = key // len(self.words)
            path, of = np.concatenate([path[parent], (key % len(self.words))[:, None]], axis=1), of[parent]
            yield of, path, count

    def serialised(self) -> Iterator[pa.RecordBatch]:
        """The nodes in the order of (language, phrase); a language's own node counts all its words."""
        langs = pa.array(list(self.langs), pa.large_string())
        parts = [pa.table([langs, pa.array([""] * len(langs), pa.large_string()), pa.array(np.zeros(len(langs), np.int32)), pa.array(self.totals, pa.int64())], ["lang", "phrase", "words", "f"])]
        words = pa.array([x.decode() for x in self.words], pa.large_string())
        for of, path, count in self.paths() if self.held else ():
            phrase = words.take(pa.array(path[:, 0]))
            for i in range(1, path.shape[1]):
                phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(path[:, i])), pa.scalar(" ", pa.large_string()))
            parts.append(pa.table([langs.take(pa.array(of)), phrase, pa.array(np.full(len(of), path.shape[1], np.int32)), pa.array(count.astype(np.int64))], ["lang", "phrase", "words", "f"]))
        whole = pa.concat_tables(parts)
        whole = whole.take(pc.sort_indices(whole, [("lang", "ascending"), ("phrase", "ascending")]))
        for batch in whole.to_batches(max_chunksize=10_000):
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=whole.column_names)
        self._clear()


def _shards(batches: Iterator[pa.RecordBatch], depth: int, filter_: Broadcast, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to the serialised tries of the task."""
    trie = Trie(depth, Filter(*filter_.value), ranges)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            trie.add(block, langs[block.lo : block.hi])
            if trie.size >= SHARD_WORDS:
                yield from trie.serialised()
    if trie.size:
        yield from trie.serialised()


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Keys to (chunk, one, two), their bits."""
    for batch in batches:
        keys = np.asarray(batch.column(0)).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in Filter.places(keys, bits)], ["chunk", "one", "two"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to (chunk, its bytes)."""
    at, flags = None, np.zeros(CHUNK_BITS, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["chunk", "bytes"])

    for batch in batches:
        chunk, one, two = (np.asarray(c) for c in batch.columns)
        for c in np.unique(chunk).tolist():
            if c != at:
                if at is not None:
                    yield done()
                at, flags = c, np.zeros(CHUNK_BITS, bool)
            flags[one[chunk == c]] = True
            flags[two[chunk == c]] = True
    if at is not None:
        yield done()


def frequent(texts: DataFrame, least: int, ranges: int) -> Broadcast:
    """The filter of the words and pairs of words that are frequent by their names' count, as a
    broadcast of at most MOST_BITS bits."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(partial(_named, ranges=ranges), "range long, payload binary")
    keys = packed.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(partial(_frequent, least=least), "key long")
    keys = stored(keys, "frequent")
    bits, n = CHUNK_BITS, keys.count()
    while bits < min(n * ENTRY_BITS, MOST_BITS):
        bits *= 2
    places = keys.mapInArrow(partial(_bits, bits=bits), "chunk long, one long, two long")
    rows = places.repartition(F.col("chunk")).sortWithinPartitions("chunk").mapInArrow(_chunks, "chunk long, bytes binary")
    found = spark.sparkContext.broadcast((bits, {r.chunk: bytes(r.bytes) for r in rows.collect()}))
    discard(keys)
    return found


def merged_tries(texts: DataFrame, least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of the phrases that occur ``least`` times or more, (lang, n words))
    of rows (lang, text)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, size // RANGE_BYTES)
    shards = texts.mapInArrow(partial(_shards, depth=depth, filter_=frequent(texts, least, ranges), ranges=ranges), _COUNTED)
    tries = stored(shards, "tries")
    # a range of phrases takes its part of every trie; sorted together, equal phrases are neighbours
    merged = tries.repartitionByRange(parts, "lang", "phrase").sortWithinPartitions("lang", "phrase")
    merged = merged.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    kept = stored(merged.filter((F.col("f") >= least) | (F.col("words") == 0)), "phrases")
    discard(tries)
    return kept.filter("words > 0"), kept.filter("words = 0").select("lang", F.col("f").alias("n"))


def _counts_of_parts(nodes: DataFrame, depth: int) -> DataFrame:
    """Adds ``lefts`` and ``rights``, arrays: the counts of the first k and of the rest of the words,
    k from 1. Parents and suffix links are followed a step at a time; a row is found once by its key."""
    words = F.split("phrase", " ", -1)
    rows = nodes.withColumn("parent", F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " ")).withColumn("link", F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))
    rows = rows.withColumn("lefts", F.array().cast("array<long>")).withColumn("rights", F.array().cast("array<long>"))
    levels = [rows.filter(F.col("words") == 1)]
    for level in range(2, depth + 1):
        above = levels[-1]
        up = above.select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("f")).alias("lefts"))
        over = above.select("lang", F.col("phrase").alias("link"), F.concat(F.array("f"), "rights").alias("rights"))
        own = rows.filter(F.col("words") == level).drop("lefts", "rights")
        levels.append(stored(own.join(up, ["lang", "parent"]).join(over, ["lang", "link"]).select(rows.columns), "walked"))
    out = levels[1]
    for more in levels[2:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to
    ``depth`` words.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line breaks into pieces and at spaces and tabs
    into words. a counts the phrase's occurrences, overlaps included, n all words. A cut into two
    parts with counts l and r scores floor(2,000,000 * a / (l + r)); the lowest-scoring cut counts,
    of equal ones the first. A phrase inside a longer one that has ``share`` percent of its count is
    left out. Order: score and a from large to small, then the phrase's bytes; ranks are from 1.

    A null language is ``und``, null text is empty. Repeated rows and ids count as often as they
    are there. A very long text is handled whole in one task. Ties have the order given. An empty
    table, and one without such phrases, gives an empty result; other columns are left out.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    nodes, totals = merged_tries(texts, least, depth)
    phrases = _counts_of_parts(nodes, depth)
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda c, k: F.struct(
        F.expr(f"cast({SCORE} as decimal(20,0)) * f").cast("decimal(38,0)").alias("product"), k.alias("k"), c["lefts"].alias("l"), c["rights"].alias("r")))
    rows = phrases.withColumn("cut", F.explode(cuts))
    # whole-number division of decimals: no rounding
    rows = rows.withColumn("score", F.expr("cut.product div (cast(cut.l as decimal(20,0)) + cut.r)"))
    least_cut = F.min(F.struct("score", "cut.k", "cut.l", "cut.r")).alias("cut")
    rows = rows.groupBy("lang", "phrase", "words", "f").agg(least_cut)
    longer = phrases.filter("words > 2").select("lang", "f", F.split("phrase", " ", -1).alias("ws"), "words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(F.col("ws"), at, size), " "))))
    covered = longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    hundred = F.lit(100).cast("decimal(10,0)")
    kept = rows.join(covered, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (hundred * F.col("inside") < F.lit(share).cast("decimal(10,0)") * F.col("f")))
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(table: str = "documents", least: int = LEAST) -> str:
    """The same by DuckDB from all word windows."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS words, {' || chr(32) || '.join(f'w{i}' for i in range(1, k + 1))} AS phrase FROM windows WHERE w{k} IS NOT NULL" for k in range(1, DEPTH + 1))
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM {table}),
listed AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
placed AS (SELECT p, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM listed),
windows AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM placed WINDOW o AS (PARTITION BY p ORDER BY i)),
counts AS MATERIALIZED (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
cuts AS (SELECT lang, words, phrase, f, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS ws FROM counts WHERE words > 1),
scored AS (SELECT c.*, l.f AS l, r.f AS r, ({SCORE} * c.f) // (l.f + r.f) AS score FROM cuts c
JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, f, unnest(list_distinct(flatten(list_transform(range(2, words), lambda s: list_transform(range(1, words - s + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ')))))) AS phrase FROM counts WHERE words > 2),
covered AS (SELECT lang, phrase, max(f) AS inside FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covered c USING (lang, phrase) WHERE c.inside IS NULL OR 100 * c.inside < {SHARE} * b.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}"""

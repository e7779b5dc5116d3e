"""A reader of SentencePiece BPE models and two encoders built on it.

``MergeCounter`` merges with a heap over a linked list and returns counts only;
``PieceTransducer`` finds the encoding as a shortest path (see ``pieces.py``).
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                size, at = _varint(raw, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces, ranks or scores, and byte fallback of a BPE or unigram model with the identity normaliser.

    Raises ValueError for a model of another kind: a normaliser with a character map, removal of
    extra spaces, user-defined pieces, or no byte fallback.
    """

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) not in (1, 2) or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1) or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("needs a BPE or unigram model with byte fallback, the identity normaliser and no user-defined pieces")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.additive = trainer.get(3, 1) == 1
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.least = min(self.scores.values())
        self.ranks = {p: -score for p, score in self.scores.items()}
        self.bytes = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        self.longest = max(map(len, self.ids))
        # No piece holds a space mark after another character, so no merge crosses such a place;
        # the same holds on both sides of a line break, which is in no piece.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        breaks = any("\n" in p for p in self.ids)
        if inner or self.additive:  # rounded sums of scores decide ties, so they run over the whole text
            self._split = re.compile(r"(?s).+")
        elif breaks:
            self._split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self._split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def units(self, text: str) -> list[str]:
        """The normalised text cut where no merge can cross; an empty text has none."""
        if not text:
            return []
        return self._split.findall(self.prefix + text.replace(" ", SPACE))


def merged(unit: str, ranks: dict[str, float]) -> list[str]:
    """Symbols of a unit after all merges: the lowest rank first, of equal ones the leftmost.

    A heap holds adjacent pairs; symbols form a linked list by their start. An entry is stale
    if either symbol has since grown or gone, seen by the pair's length.
    """
    n = len(unit)
    if n < 2:
        return list(unit)
    follow = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    symbol: list[str] = list(unit)
    heap = []
    for i in range(n - 1):
        rank = ranks.get(unit[i : i + 2])
        if rank is not None:
            heap.append((rank, i, 2))
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        _, left, size = pop(heap)
        first = symbol[left]
        if not first:
            continue
        right = follow[left]
        if right >= n or len(first) + len(symbol[right]) != size:
            continue
        whole = symbol[left] = first + symbol[right]
        symbol[right] = ""
        after = follow[left] = follow[right]
        if after < n:
            before[after] = left
            rank = get(whole + symbol[after])
            if rank is not None:
                push(heap, (rank, left, size + len(symbol[after])))
        prior = before[left]
        if prior >= 0:
            rank = get(symbol[prior] + whole)
            if rank is not None:
                push(heap, (rank, prior, len(symbol[prior]) + size))
    return [s for s in symbol if s]


class _Remembered(dict):
    """Values of short units, found by ``find`` when first asked for, up to a bound."""

    def __init__(self, find, bound: int):
        super().__init__()
        self.find, self.bound = find, bound

    def __missing__(self, unit: str):
        value = self.find(unit)
        if len(unit) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[unit] = value
        return value


class MergeCounter:
    """Token counts: initial symbols (bytes where a character has no piece) minus merges."""

    def __init__(self, model: PieceModel, cache: int = 400_000):
        if model.additive:
            raise ValueError("a unigram model has no merges")
        self.model, self.limit = model, cache
        self.known: dict[str, int] = {}

    def _initial(self, unit: str) -> int:
        ids = self.model.ids
        return sum(1 if c in ids else len(c.encode()) for c in unit)

    def unit(self, unit: str) -> int:
        n = len(unit)
        ranks = self.model.ranks
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = [1] * n
        heap = [(ranks[p], i, 2) for i in range(n - 1) if (p := unit[i : i + 2]) in ranks]
        heapq.heapify(heap)
        merges = 0
        pop, push, get = heapq.heappop, heapq.heappush, ranks.get
        while heap:
            _, left, span = pop(heap)
            right = follow[left]
            if not size[left] or right >= n or size[left] + size[right] != span:
                continue  # stale: one of the two has grown or gone
            merges += 1
            size[left], size[right] = span, 0
            after = follow[left] = follow[right]
            if after < n:
                before[after] = left
                rank = get(unit[left : after + size[after]])
                if rank is not None:
                    push(heap, (rank, left, span + size[after]))
            prior = before[left]
            if prior >= 0:
                rank = get(unit[prior : left + span])
                if rank is not None:
                    push(heap, (rank, prior, size[prior] + span))
        return self._initial(unit) - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text. Counts of short units are remembered, up to a bound."""
        known, total = self.known, 0
        get = known.get
        for unit in self.model.units(text):
            n = get(unit)
            if n is None:
                n = self.unit(unit)
                if len(unit) <= 64:
                    if len(known) >= self.limit:
                        known.clear()
                    known[unit] = n
            total += n
        return total

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The encoder is the composition of three machines over the tropical semiring (weights add along a
path, the least path counts):

* the normaliser: space to the mark U+2581, with a mark put before a non-empty text;
* the piece machine: a trie of the pieces, whose leaves write a piece's identifier, with byte
  fallback as an arc that reads one character without a piece and writes its UTF-8 bytes;
* the input, a straight-line acceptor.

A unigram model gives every piece its negative score as weight, and the machine one state. A merge
order has no additive score: there the states are "last piece written", an arc between pieces
weighs 1 where merging their text gives back just these two, and is infinite otherwise. A sequence
is what the merges give if and only if each adjacent pair is (look at the first merge in time that
crosses a border: up to it, both neighbours went as they go alone), so the shortest path is the
encoding, and a prefix has one finite path at most. The composition is relaxed position by position.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spm import BYTE, NORMAL, SPACE, PieceModel, _Remembered, merged
from .token_counts import read_model

#: What a unigram model's character without a piece scores below its least piece, as the library has it.
UNKNOWN_PENALTY = 10.0


class PieceTransducer:
    def __init__(self, model: PieceModel, cache: int = 1_000_000, arcs: int = 4_000_000):
        self.model, self.bound = model, arcs
        self.known = _Remembered(self._ids, cache)
        self.arcs: dict[str, bool] = {}
        readable = list(model.ids) if model.additive else [p for p in model.ids if len(merged(p, model.ranks)) == 1]
        self.trie: dict = {}
        for piece in readable:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        # the two symbols whose merge is a piece's last, and the pieces within which a later merge
        # has a lower rank (runs of marks, in known models)
        self.parts = {} if model.additive else {p: _last_merge(p, model.ranks) for p in readable if len(p) > 1}
        self.irregular: set[str] = set()
        for piece in sorted(self.parts, key=len):
            if any(part in self.irregular or len(part) > 1 and model.ranks[part] >= model.ranks[piece] for part in self.parts[piece]):
                self.irregular.add(piece)
        self.written = [p.encode() for p in model.pieces]
        for i, kind in enumerate(model.kinds):
            if kind == BYTE:
                self.written[i] = bytes([int(model.pieces[i][1:-1], 16)])
            elif kind != NORMAL:
                self.written[i] = b""
        self.mark = SPACE.encode()

    def joins(self, a: str, b: str) -> bool:
        """Whether the arc from state a that reads b has finite weight.

        The merges of both are undone, the latest first (of equal ones the right one), and at each
        step the two symbols at the border must not have had an earlier merge (nor, against one on
        the right, one of the same rank). Irregular pieces are merged instead.
        """
        ranks, parts = self.model.ranks, self.parts
        if a in self.irregular or b in self.irregular:
            return merged(a + b, ranks) == [a, b]
        limit, or_equal = math.inf, False
        while True:
            rank = ranks.get(a + b)
            if rank is not None and (rank < limit or or_equal and rank == limit):
                return False
            left, right = parts.get(a), parts.get(b)
            if left and (not right or ranks[a] > ranks[b]):
                limit, or_equal, a = ranks[a], False, left[1]
            elif right:
                limit, or_equal, b = ranks[b], True, right[0]
            else:
                return True

    def path(self, unit: str) -> list[str]:
        """Pieces on the tropical shortest path through the composition with one unit: each position
        is relaxed from those before it, in order."""
        return self._scored(unit) if self.model.additive else self._merged(unit)

    def _merged(self, unit: str) -> list[str]:
        n, root, arcs = len(unit), self.trie, self.arcs
        # the state of the one finite path to each position; its weight is its number of pieces
        states: list[str | None] = [None] * (n + 1)
        states[0] = ""
        for at in range(n):
            state = states[at]
            if state is None:
                continue
            node, end = root, at
            while end < n:
                node = node.get(unit[end])
                end += 1
                if node is None:
                    if end > at + 1:
                        break
                    piece = unit[at:end]  # by its bytes
                elif (piece := node.get("")) is None:
                    continue
                # another finite path here would be a second one of this prefix
                if states[end] is None:
                    if not state:
                        states[end] = piece
                    else:
                        finite = arcs.get(state + "\n" + piece)
                        if finite is None:
                            if len(arcs) >= self.bound:
                                arcs.clear()
                            finite = arcs[state + "\n" + piece] = self.joins(state, piece)
                        if finite:
                            states[end] = piece
                if node is None:
                    break
        out = []
        while n:
            piece = states[n]
            if piece is None:
                raise ValueError("no path: the model's merges have no such order")
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    def _scored(self, unit: str) -> list[str]:
        n, root, scores = len(unit), self.trie, self.model.scores
        single_width = np.float32  # the library adds in it, which decides ties
        unknown = single_width(UNKNOWN_PENALTY - self.model.least)
        weights, back = [math.inf] * (n + 1), [0] * (n + 1)
        weights[0] = single_width(0)
        for at in range(n):
            node, end, single = root, at, False
            while end < n and (node := node.get(unit[end])) is not None:
                end += 1
                if (piece := node.get("")) is not None:
                    single |= end == at + 1
                    if (weight := weights[at] - single_width(scores[piece])) < weights[end]:
                        weights[end], back[end] = weight, at
            if not single and (weight := weights[at] + unknown) < weights[at + 1]:
                weights[at + 1], back[at + 1] = weight, at
        out = []
        while n:
            out.append(unit[back[n] : n])
            n = back[n]
        return out[::-1]

    def _ids(self, unit: str) -> bytes:
        ids = self.model.ids
        out: list[int] = []
        for piece in self.path(unit):
            if piece in ids:
                out.append(ids[piece])
            else:
                out.extend(self.model.bytes[b] for b in piece.encode())
        return struct.pack(f"<{len(out)}i", *out)

    def encode(self, text: str) -> bytes:
        """Identifiers of a whole text as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.model.units(text)))

    def decode(self, ids: np.ndarray) -> str:
        """The inverse machine: pieces and bytes joined, marks to spaces, the first mark
        dropped; bytes that are no UTF-8 give U+FFFD each."""
        raw = b"".join(map(self.written.__getitem__, ids.tolist()))
        if self.model.prefix and raw.startswith(self.mark):
            raw = raw[len(self.mark) :]
        return raw.decode(errors="replace").replace(SPACE, " ")


def _last_merge(piece: str, ranks: dict[str, float]) -> tuple[str, str]:
    """The two symbols that merging a piece's text joins last."""
    without = {p: r for k in range(2, len(piece)) for i in range(len(piece) - k + 1) if (r := ranks.get(p := piece[i : i + k])) is not None}
    one, two = merged(piece, without)
    return one, two


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 1_000_000, keep_ids: bool = True) -> DataFrame:
    """Return id, n_tokens, ids (array<int>; left out without ``keep_ids``), ids_sha256 (of the
    little-endian 32-bit ids), decoded_sha256 (of the decoded text's UTF-8) and round_trip.

    round_trip: decoding gives the text back, up to the mark U+2581 itself, which a text shares
    with the space. There is no shuffle; each row is encoded where it is read.

    Null text counts as empty: no ids, and it decodes to the empty text. A very long text is encoded
    whole, unit by unit; a unit (a run without a place that no piece crosses) of any length takes
    time in proportion to it. A null id stays null,
    repeated rows are encoded one by one, an empty table gives an empty result, and other
    columns are left out, so their names cannot clash.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def encoded(batches):
        machine = PieceTransducer(PieceModel(raw.value), cache)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, digests, texts, same, lists = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids = machine.encode(text)
                    back = machine.decode(numbers := np.frombuffer(ids, "<i4"))
                    sizes.append(len(numbers))
                    digests.append(hashlib.sha256(ids).hexdigest())
                    texts.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == text.replace(SPACE, " "))
                    lists.append(numbers)
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(texts), pa.array(same)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    out = rows.mapInArrow(encoded, schema)
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c != "id"])


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return id and text, decoded from an array of ids (null ids: null text; no ids: empty text). Ids
    outside the model raise an error; control ids write nothing. Long arrays are decoded whole, a
    null id stays null, repeated rows are decoded one by one, an empty table gives an empty result,
    and other columns are left out."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def decoded(batches):
        machine = PieceTransducer(PieceModel(raw.value))
        for batch in batches:
            texts = [None if ids is None else machine.decode(np.array(ids, "<i4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(decoded, f"id {kind}, text string").select(F.col("id").alias(id_col), "text")

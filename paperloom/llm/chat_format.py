r"""Chat formatting from event logs.

A log is partitioned by conversation and sorted by message and sequence; events are folded into
final messages one after another, so memory holds one message, however long a conversation is.

Template: each turn is ``### Role: text</turn>`` and a line break. The control strings are ``###``,
``</turn>`` and, in a role, ``:``; inside texts they get a backslash before them, as does a
backslash itself, so reading the output gives every role and text back exactly.

Events (``kind``): ``message`` starts a message with its whole text, ``delta`` appends to it,
``edit`` puts a new text in place, ``regenerate`` empties it for the deltas that follow, and
``delete`` takes it out. A delta or edit without a message before it starts one. An unknown
kind is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
OPEN, ESCAPE = "###", "\\"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TO_END = re.compile(r"((?:[^\\<]++|\\[\s\S]|<(?!/turn>))*+)</turn>\n")
_HEAD = re.compile(r"### ((?:[^\\:]++|\\[\s\S])*+): ")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where its text begins and ends within."""
    head = f"{OPEN} {escape(role, role=True)}: "
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


class Reader:
    """Reads turns back from an output that comes in chunks of any size; it keeps what is not yet a
    whole turn, and knows nothing of where segments begin."""

    def __init__(self):
        self.left = ""

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of the turns that the chunk completes."""
        text, at = self.left + chunk, 0
        while (head := _HEAD.match(text, at)) and (body := _TO_END.match(text, head.end())):
            yield unescape(head[1]), unescape(body[1])
            at = body.end()
        self.left = text[at:]

    def close(self) -> None:
        if self.left:
            raise ValueError(f"no turn at {self.left[:20]!r}")


def parse(output: str) -> Iterator[tuple[str, str]]:
    """Roles and texts read back from rendered turns; ValueError where it is not such output."""
    reader = Reader()
    yield from reader.feed(output)
    reader.close()


def fold(events: Iterable[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """Final (role, text) messages of one message key's events (kind, role, text), in order."""
    role, parts = None, []
    for kind, by, text in events:
        if kind == "message":
            if role is not None:
                yield role, "".join(parts)
            role, parts = by, [text]
        elif kind == "delta":
            role = by if role is None else role
            parts.append(text)
        elif kind == "edit":
            role, parts = by if role is None else role, [text]
        elif kind == "regenerate":
            role, parts = by if role is None else role, []
        elif kind == "delete":
            role, parts = None, []
        else:
            raise ValueError(f"unknown event {kind!r}")
    if role is not None:
        yield role, "".join(parts)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """Consecutive rows with the same (conversation, message)."""
    from itertools import groupby

    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, ((r[2], r[3] or "", r[4] or "") for r in group)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, role, segment, begin, end) in order; begin and end bound the text."""
    rows = (row for batch in batches for lo in range(0, batch.num_rows, 512) for row in zip(*(batch.column(i).slice(lo, 512).to_pylist() for i in range(5)), strict=True))
    for (conversation, _), events in _runs(rows):
        for role, text in fold(events):
            yield conversation, role, *render(role, text)


def _formatted(batches: Iterator[pa.RecordBatch], loss_roles: tuple[str, ...]) -> Iterator[tuple]:
    """(conversation, turn, segment, begin, end): begin and end, code points into the conversation's
    output, bound what is under the loss mask."""
    last, turn, at = object(), 0, 0
    for conversation, role, segment, begin, end in _segments(batches):
        if conversation != last:
            last, turn, at = conversation, 0, 0
        masked = role in loss_roles
        yield conversation, turn, segment, at + begin if masked else None, at + end if masked else None
        turn, at = turn + 1, at + len(segment)


def _sorted_log(events: DataFrame) -> DataFrame:
    rows = events.select("conv_id", "message", "kind", "role", "text", "seq")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text").drop("seq")


def format_segments(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted corpus: conv_id, turn (from 0), segment, and begin and end (code points into
    the conversation's whole output) of its part under the loss mask, null if it has none.

    A conversation's output is its segments joined by turn; segments keep a very long one from
    having to be a single value. Null text or role counts as empty, a null conv_id is a conversation
    of its own, repeated events each count, an empty table gives an empty result, and other columns
    are left out.
    """

    def rendered(batches):
        out = []
        for row in _formatted(batches, loss_roles):
            out.append(row)
            if len(out) == 512:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    kind = events.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, turn long, segment string, loss_begin long, loss_end long"
    schema = pa.schema([("conv_id", _arrow(events)), ("turn", pa.int64()), ("segment", pa.string()), ("loss_begin", pa.int64()), ("loss_end", pa.int64())])
    return _sorted_log(events).mapInArrow(rendered, ddl)


def _arrow(events: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(events.schema["conv_id"].dataType)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def chat_digests(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation, read back from its rendered output: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    events has conv_id, message (the order of messages), seq, kind, role, text. One shuffle by
    conversation, sorted; each task streams through its rows, and a digest needs its turns one
    after another, so the longest conversation bounds the longest task but not its memory.

    Null text or role counts as empty. Null conv_id is a conversation of its own; null message
    or seq sorts first. Repeated events each count; ties go by kind, role and text. A very long
    text, or message of many deltas, is held whole, one at a time. An empty table gives an empty result; other columns are left out.
    """

    def read_back(batches):
        out = []
        state = reader = None
        for conversation, _, segment, begin, end in _formatted(batches, loss_roles):
            if state is None or conversation != state[0]:
                if state:
                    reader.close()
                    out.append(_closed(state))
                state, reader = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], Reader()
            for role, text in reader.feed(segment):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            if begin is not None:
                under = unescape(segment[begin - state[5] : end - state[5]])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(segment)
            if len(out) >= 512:
                yield _batch(out, schema)
                out = []
        if state:
            reader.close()
            out.append(_closed(state))
        if out:
            yield _batch(out, schema)

    kind = events.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([("conv_id", _arrow(events)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return _sorted_log(events).mapInArrow(read_back, ddl)


def _closed(state: list) -> tuple:
    conversation, turns, digest, chars, loss, total = state
    return conversation, turns, digest.hexdigest(), chars, loss.hexdigest(), total


def as_events(conversations: DataFrame) -> DataFrame:
    """A log whose folded messages are the rows (conv_id, turn, role, text), by turn (null first), role
    and text.

    By a hash of the row a message comes whole, streamed in three deltas, as a draft with a delta
    that an edit replaces, or as a draft that is regenerated by deltas.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("whole"), F.row_number().over(order).cast("long").alias("message"))
    third = F.expr("cast(length(whole) div 3 as int)")
    one, two, three = F.substring("whole", F.lit(1), third), F.substring("whole", third + 1, third), F.substring("whole", 2 * third + 1, F.length("whole"))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(events)])

    empty, whole = F.lit(""), F.col("whole")
    kinds = [
        log(("message", whole)),
        log(("message", empty), ("delta", one), ("delta", two), ("delta", three)),
        log(("message", F.concat(three, one)), ("delta", two), ("edit", whole)),
        log(("message", two), ("delta", three), ("regenerate", empty), ("delta", one), ("delta", two), ("delta", three)),
    ]
    way = F.pmod(F.xxhash64("conv_id", "message"), F.lit(len(kinds)))
    events = F.when(way == 0, kinds[0]).when(way == 1, kinds[1]).when(way == 2, kinds[2]).otherwise(kinds[3])
    return rows.select("conv_id", "message", "role", F.explode(events).alias("event")).select("conv_id", "message", "event.seq", "event.kind", "role", "event.text")


def oracle(added: list[tuple[int, int, str, str]]) -> str:
    """chat_digests in DuckDB SQL over conversations and some more rows (conv_id, turn, role, text):
    escaping adds a backslash to each control string."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({c}, {t}, {quote(r)}, {quote(x)})" for c, t, r, x in added)
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {rows}))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is under the loss mask.

The template of a turn is ``<turn>role`` newline ``text</turn>`` newline.
Control strings inside roles and texts are escaped: each ``<``, any number of
backslashes, then ``turn>`` or ``/turn>`` gets one backslash more, and reading
takes one away, so the escape is its own exact inverse.  A newline or a
backslash inside a role is written ``\\n`` or ``\\\\``.

Defined results: turns of a conversation are ordered by turn, then role, then
text (nulls first); repeated rows are turns of their own; a null role or text
is empty; a null conversation id is one conversation; extra columns are
ignored; an empty table gives no rows.  A conversation without a reply, or with
turns after its last one, also gives one row without a target (``reply`` is
false), so the examples hold every turn; ``last`` marks a conversation's longest.

A conversation is formatted by one task, which streams its turns: its examples
are quadratic in its turns by the method.  Reading back takes the examples from
a stored table in any order; only the texts under the mask meet by conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
TARGET_ROLE = "assistant"
_CONTROL = re.compile(r"<(\\*)(/?turn>)")
_ESCAPED = re.compile(r"<\\(\\*)(/?turn>)")
_TURN = re.compile(r"<turn>([^\n]*)\n(.*?)</turn>\n", re.S)
_FLUSH = 8 << 20

EXAMPLES = "conv_id long, example long, reply boolean, last boolean, turns long, text string, loss_start long, loss_chars long"
_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("reply", pa.bool_()), ("last", pa.bool_()), ("turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_chars", pa.int64())])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1\2", text) if "turn>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2", text) if "turn>" in text else text


def write_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts back from formatted turns."""
    out, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ValueError(f"no turn at character {at}")
        out.append((read_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted turns: holds one conversation's prefix, not a partition."""
    rows: list[list] = []
    size = 0
    conv: object = ()
    prefix: list[str] = []
    chars = turns = example = 0
    pending = False

    def close() -> None:
        nonlocal size
        if pending:
            rows.append([conv, example, False, True, turns, text := "".join(prefix), chars, 0])
            size += len(text)
        elif rows:
            rows[-1][3] = True

    def batch_of(some: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _EXAMPLES.types, strict=True)], schema=_EXAMPLES)

    for batch in batches:
        for cid, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv == () or cid != conv:
                close()
                conv, prefix, chars, turns, example, pending = cid, [], 0, 0, 0, False
            head, body = f"{OPEN}{write_role(role)}\n", escape(text)
            prefix.append(f"{head}{body}{CLOSE}")
            start, chars, turns = chars + len(head), chars + len(prefix[-1]), turns + 1
            pending = role != TARGET_ROLE
            if not pending:
                prefix = ["".join(prefix)]
                rows.append([conv, example, True, False, turns, prefix[0], start, len(body)])
                example, size = example + 1, size + chars
            if size >= _FLUSH and len(rows) > 1:  # whether a row is the last shows after it
                yield batch_of(rows[:-1])
                rows, size = rows[-1:], 0
    close()
    if rows:
        yield batch_of(rows)


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn: its context and reply as ``text``, and
    the mask as ``loss_start`` and ``loss_chars`` (code points of ``text``).

    Conversations meet in one shuffle by ``conv_id``; a task then streams its
    sorted turns, so memory holds one prefix and one output batch.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_expand, EXAMPLES)


READ = "conv_id long, example long, reply boolean, last boolean, n_turns long, turns_sha256 string, masked string, chars long"
_READ = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("reply", pa.bool_()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("masked", pa.string()), ("chars", pa.int64())])


def _read_each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each example, the text under its mask; of the longest, its turns."""
    for batch in batches:
        rows: list[tuple] = []
        for cid, example, reply, last, text, start, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "reply", "last", "text", "loss_start", "loss_chars")), strict=True):
            said = hashlib.sha256()
            n = 0
            if last:
                for role, turn in parse(text):
                    said.update(f"{role}\n{turn}\n".encode())
                    n += 1
            rows.append((cid, example, reply, last, n, said.hexdigest(), unescape(text[start : start + size]), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams what was read, sorted by conversation and example."""
    rows: list[tuple] = []
    conv: object = ()
    loss = hashlib.sha256()
    turns, n_turns = "", 0
    loss_chars = formatted = examples = 0

    def close() -> None:
        if conv != ():
            rows.append((conv, n_turns, turns, loss_chars, loss.hexdigest(), formatted, examples))

    for batch in batches:
        for cid, reply, last, n, said, masked, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "reply", "last", "n_turns", "turns_sha256", "masked", "chars")), strict=True):
            if conv == () or cid != conv:
                close()
                conv, loss, loss_chars, formatted, examples = cid, hashlib.sha256(), 0, 0, 0
            if reply:
                loss.update(masked.encode())
                loss_chars += len(masked)
                examples += 1
            if last:
                turns, n_turns = said, n
            formatted += chars
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)
            rows = []
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)


def read_examples(examples: DataFrame) -> DataFrame:
    """A digest of each conversation, read from its formatted examples, which may
    come from a stored table in any order.  ``formatted_chars`` counts all its
    examples."""
    read = examples.mapInArrow(_read_each, READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_digest, DIGESTS)

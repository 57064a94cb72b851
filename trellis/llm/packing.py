"""Cost-balanced packing of token sequences.

A piece of ``l`` tokens costs ``LINEAR * l + QUADRATIC * l**2``: attention does
not cross the pieces of a sequence.  Full-length cuts of a document are
sequences of their own; what remains of it, less than a sequence, is shuffled
by a hash of the document, and each task packs its remainders in blocks of about
``BLOCK_TOKENS`` ids.  A block is thus an even sample of all documents, whatever
order they come in, so costs balance over blocks and tasks as well, and memory
is bounded by a block.  In a block, remainders go, longest first, to the
sequence of lowest cost that has room: sequences wait in queues by the room left
in them, and a tree over the queues' least costs finds the cheapest with room
enough.  A remainder for which no sequence has room is cut over the room that is
left, so all padding of a block together is less than one sequence.

Defined results: a null text is empty and has the end id alone; repeated rows
are packed one by one; ties of length follow the order of the hash; extra columns
are ignored; an empty table gives no rows.  ``sequence_id`` is unique, not dense;
it depends on the shuffle partitions, not on the input's.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trellis.llm.common import only
from trellis.llm.kernels import U, mix, pair
from trellis.llm.tokens import byte_ids

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
END_ID = 1
BLOCK_TOKENS = 1 << 21

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: ``ids`` is null in full-length pieces; the others may still be cut.
CUTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long, ids binary"
_CUTS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal")), ("ids", pa.binary())])


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Rooms:
    """Open sequences by the room left in them: the cheapest one that has room
    for a length is found exactly, in steps logarithmic in the capacity."""

    def __init__(self, capacity: int, many: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.queues: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least: list[tuple[float, int]] = [(float("inf"), -1)] * (2 * self.leaves)
        if many:
            self.queues[capacity] = [(0.0, k) for k in range(many)]
            self._lift(capacity)

    def _lift(self, room: int) -> None:
        least, queue, i = self.least, self.queues[room], room + self.leaves
        least[i] = queue[0] if queue else (float("inf"), -1)
        while i > 1:
            i >>= 1
            a, b = least[2 * i], least[2 * i + 1]
            least[i] = a if a <= b else b

    def put(self, room: int, at: float, k: int) -> None:
        heapq.heappush(self.queues[room], (at, k))
        if self.queues[room][0] == (at, k):
            self._lift(room)

    def take(self, length: int) -> tuple[int, float, int] | None:
        """(room, cost, number) of the cheapest sequence with room for ``length``, which leaves."""
        least, leaves = self.least, self.leaves
        lo, hi = leaves + length, 2 * leaves
        best, place = (float("inf"), -1), 0
        while lo < hi:
            if lo & 1:
                if least[lo] < best:
                    best, place = least[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if least[hi] < best:
                    best, place = least[hi], hi
            lo, hi = lo >> 1, hi >> 1
        if not place:
            return None
        while place < leaves:
            place = 2 * place if least[2 * place] == best else 2 * place + 1
        room = place - leaves
        heapq.heappop(self.queues[room])
        self._lift(room)
        return room, *best


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of ``sizes`` tokens."""
    out, n = [], 0
    rest: list[tuple[int, int, int]] = []
    for doc, size in enumerate(sizes):
        full = size // capacity
        out += [(doc, k * capacity, capacity, n + k, 0) for k in range(full)]
        n += full
        if size % capacity:
            rest.append((size % capacity, doc, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = Rooms(capacity, -(-sum(x[0] for x in rest) // capacity))
    waiting = []

    def place(found: tuple[int, float, int], doc: int, start: int, length: int) -> None:
        room, at, k = found
        out.append((doc, start, length, n + k, capacity - room))
        if room > length:
            open_.put(room - length, at + cost(length), k)

    for length, doc, start in rest:
        if (found := open_.take(length)) is not None:
            place(found, doc, start, length)
        else:
            waiting.append((length, doc, start))
    for length, doc, start in waiting:
        while length:
            found = open_.take(1)
            part = min(length, found[0])
            place(found, doc, start, part)
            length, start = length - part, start + part
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def _cut_all(tokenizer: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_ids(tokenizer)
        end = np.array([END_ID], np.uint32)
        rows: list[tuple] = []
        row = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate((encode(text.as_py()), end))
                row += 1  # tells rows without an id apart
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    crc = _crc(part)
                    key = mix(pair(np.array([row if doc is None else doc], np.int64).view(U), np.array([start << 32 | crc], U)))
                    narrow = part.astype("<u2") if part.max() < 1 << 16 else part.astype("<u4")
                    rows.append((doc, start, len(part), crc, len(ids), int(key.view(np.int64)[0]), None if len(part) == capacity else narrow.tobytes()))
                if len(rows) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CUTS.types, strict=True)], schema=_CUTS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CUTS.types, strict=True)], schema=_CUTS)

    return run


def _pack_all(capacity: int, block_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        total = done = 0

        def block() -> pa.RecordBatch:
            nonlocal done
            columns: list[list] = [[] for _ in range(7)]
            for row, start, length, sequence, offset in pack([r[2] for r in rows], capacity):
                doc, first, size, crc, tokens, ids = rows[row]
                if length < size:
                    ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * size else "<u4")
                    crc = _crc(ids[start : start + length])
                for c, v in zip(columns, (doc, first + start, length, crc, tokens, base + done + sequence, offset), strict=True):
                    c.append(v)
            done += 1 + max(columns[5]) - base - done
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECES)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True):
                rows.append(r)
                total += r[2]
                if total >= block_tokens:
                    yield block()
                    rows, total = [], 0
        if rows:
            yield block()

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    cuts = only(docs).mapInArrow(_cut_all(tokenizer, capacity), CUTS)
    dealt = cuts.repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(_pack_all(capacity, block_tokens), PIECES)

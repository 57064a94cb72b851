"""Suffix-array deduplication by bucket-pointer refinement.

Finds every byte covered by a ``length``-byte string that also starts anywhere
else in the corpus.  A full suffix array would sort every byte of the corpus;
here only suffixes that can still meet a partner are kept, bucket by bucket:

1. *q-gram buckets.*  The bucket identifier of a suffix at depth q is its q-gram
   hash.  A window of ``length`` bytes puts only its smallest q-gram (leftmost
   of equals) into a bucket: equal windows choose alike, so repeated strings
   always share a bucket, and about one suffix in 80 is stored.
2. *Refinement by blocks.*  A stored suffix speaks for a block of consecutive
   window starts.  Identifiers at greater depths come from those at later
   offsets, never from bytes again (``id(2d, i) = (id(d, i), id(d, i + d))``);
   the pair at a block's first and last start refines the bucket.  Blocks that
   stay together are repeats as a whole, which settles the inside of all long
   repeats.  A chunk settles the blocks that it holds twice or more by itself
   and sends one of them on, so copies do not fill a bucket.
3. *Open buckets.*  One block of each refined bucket counts for its q-gram
   bucket, by partial sums.  Buckets of one block, and those without a block
   that stands alone, end here.
4. *Refinement by offsets.*  The rest lie at the edges of repeats.  Open blocks
   send their bytes to their q-gram bucket, which is sorted by the identifiers
   at full depth of each offset from the anchor.  In buckets too wide for one
   task, such as a line in many contexts, each offset becomes a row of its own;
   these are counted with partial sums and joined back.

Equality is that of 64-bit identifiers within a 64-bit q-gram bucket.

Tasks stream sorted rows; memory is bounded by a document, a chunk or
``GROUP`` blocks.  Texts cross the shuffle compressed.

Defined results: a null text is empty; repeated rows are documents of their own
(so each text of ``length`` bytes or more that occurs twice is removed whole);
rows with a null doc_id are told apart by their text; extra columns are ignored
by the query and kept by ``cut_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import only, text_chunks, unused, written
from trellis.llm.kernels import CHUNK_BYTES, U, gram_ids, pair, sliding_min, spans, widen

LENGTH = 200
GRAM = 48
#: Blocks of a bucket that one task sorts; of wider buckets, offsets become rows.
GROUP = 4096
_SORT = 4096
#: Blocks of one refined bucket that are held at a time.
HOLD = 400_000
#: Marks of a stored block beside its row's tag: one of several, or settled.
ONE_OF, SETTLED = 1 << 14, 2 << 14
_PLACE = U(20)


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two columns that stand for a row: key and tag."""
    return only(docs).select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.expr("hash(text) & 16383").cast("long").alias("tag"))


def blocks(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Blocks of window starts that share their anchor: document (index into
    ``off``), q-gram identifier, block identifier, first start, starts beyond
    it, and anchor after it; places count from the document's start."""
    parts = []
    step = CHUNK_BYTES
    whole = len(off) > 2 or len(buf) <= 2 * step
    for at in (0,) if whole else range(0, len(buf) - length + 1, step):
        piece = buf if whole else buf[at : at + step + length - 1]
        if len(piece) < length:
            continue
        ids = gram_ids(piece, gram)
        best = sliding_min((ids >> _PLACE << _PLACE) | np.arange(len(ids), dtype=U), length - gram + 1)
        place = (best & U((1 << 20) - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)] if whole else np.zeros(len(place), np.int64)
        start = np.flatnonzero(np.arange(length, len(place) + length) <= off[doc + 1] - at)
        if not len(start):
            continue
        place, doc = place[start], doc[start]
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
        last = np.append(first[1:], len(start)) - 1
        lo, hi, place, doc = start[first], start[last], place[first], doc[first]
        deep = widen(ids, gram, length)
        block = pair(pair(deep[lo], deep[hi]), (hi - lo).astype(U))
        parts.append((doc, ids[place], block, lo + at - off[doc], hi - lo, place - lo))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ()


_BLOCKS = pa.schema([(c, pa.int64()) for c in ("gram", "block", "key", "place")])


def _blocks(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tag = (batch.column(c).to_numpy() for c in ("key", "tag"))
            for a, _, buf, off in text_chunks(batch):
                if found := blocks(buf, off, length, gram):
                    doc, ids, block, lo, more, anchor = found
                    doc = doc + a
                    # first start, starts beyond it, anchor after it, tag
                    place = lo << 32 | more << 24 | anchor << 16 | tag[doc]
                    order = np.lexsort((block, ids))
                    same = np.concatenate(([False], (ids[order][1:] == ids[order][:-1]) & (block[order][1:] == block[order][:-1])))
                    place[order[same]] |= SETTLED
                    first = np.flatnonzero(~same & np.append(same[1:], False))
                    place[order[first]] |= ONE_OF
                    settled = order[same]
                    ids[settled] = pair(place[settled].view(U), key[doc[settled]].view(U))  # anywhere: they meet no bucket
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids.view(np.int64), block.view(np.int64), key[doc], place)], schema=_BLOCKS)

    return run


KNOWN, LONE, SHARED, WIDE = 1, 2, 3, 8
_MARKS = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("gram", pa.int64()), ("kind", pa.int32())])


def refine(gram: np.ndarray, block: np.ndarray, key: np.ndarray, place: np.ndarray, before: tuple[int, int] | None) -> list[np.ndarray]:
    """Marks of sorted blocks: all blocks of refined buckets of two or more, and
    one block of each refined bucket.  ``before`` is the bucket that has been
    seen already; its blocks are repeats and it needs no other representative."""
    head = np.concatenate(([True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))
    first = np.flatnonzero(head)
    many = (np.diff(np.append(first, len(gram))) >= 2) | np.logical_or.reduceat(place & ONE_OF != 0, first)
    kind = np.where(many, SHARED, LONE)
    if before == (int(gram[0]), int(block[0])):
        many[0] = True
        first, kind = first[1:], kind[1:]
    known = np.flatnonzero(many[np.cumsum(head) - 1])
    at = np.concatenate((known, first))
    return [key[at], place[at], gram[at], np.concatenate((np.full(len(known), KNOWN), kind)).astype(np.int32)]


def _refine(hold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the last refined bucket until it ends; of a long one, a part at a time."""
        held: list[np.ndarray] | None = None
        before: tuple[int, int] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("gram", "block", "key", "place")]
            done = rows[3] & SETTLED != 0
            if done.any():
                key, place, gram = (rows[k][done] for k in (2, 3, 0))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(gram), pa.array(np.full(len(key), KNOWN, np.int32))], schema=_MARKS)
                rows = [x[~done] for x in rows]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            gram, block = rows[:2]
            if not len(gram):
                continue
            last = np.flatnonzero((gram != gram[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and len(gram) > hold:
                cut = len(gram)  # one bucket: it is refined, for it has two blocks
                place = rows[3] | ONE_OF
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in refine(gram, block, rows[2], place, before)], schema=_MARKS)
                before, held = (int(gram[0]), int(block[0])), None
                continue
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in refine(*(x[:cut] for x in rows), before)], schema=_MARKS)
                before = None
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in refine(*held, before)], schema=_MARKS)

    return run


_TEXTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("tag", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("gram", pa.int64()), ("packed", pa.binary())])
TEXTS = "doc_id long, key long, tag long, kind int, place long, gram long, packed binary"


def _compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        n = batch.num_rows
        packed = pa.array([pack.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())
        zero = pa.array(np.zeros(n, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("tag"), pa.array(np.zeros(n, np.int32)), zero, zero, packed], schema=_TEXTS)


def _with_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of texts (kind 0) and their marks, together and in this order."""
    texts = _key(docs).mapInArrow(_compress, TEXTS)
    marks = marks.select(F.lit(None).cast("long").alias("doc_id"), "key", F.expr("place & 16383").alias("tag"), "kind", "place", "gram", F.lit(None).cast("binary").alias("packed"))
    return texts.unionByName(marks).repartition("key", "tag").sortWithinPartitions("key", "tag", "kind")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int | None], int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Each text with its marks: ids of its rows, key, tag, bytes; place, gram and kind of its marks."""
    unpack = zstandard.ZstdDecompressor()
    now: tuple[int, int] | None = None
    ids: list[int | None] = []
    data = b""
    marks: list[tuple[np.ndarray, ...]] = []
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))

    def done():
        found = [np.concatenate(x) for x in zip(*marks, strict=True)] if marks else none
        return ids, *now, unpack.decompress(data), *found

    for batch in batches:
        key, tag, kind, place, gram = (batch.column(c).to_numpy() for c in ("key", "tag", "kind", "place", "gram"))
        packed, doc = batch.column("packed"), batch.column("doc_id")
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))) if len(key) else []
        for a, b in zip(edge, [*edge[1:], len(key)], strict=True):
            here = (int(key[a]), int(tag[a]))
            if here != now:
                if ids:
                    yield done()
                now, ids, marks = here, [], []
            while a < b and kind[a] == 0:
                ids.append(doc[int(a)].as_py())
                data = packed[int(a)].as_py()
                a += 1
            if a < b:
                marks.append((place[a:b], gram[a:b], kind[a:b]))
                if len(marks) > 64:  # repeated rows repeat their marks
                    together = np.unique(np.stack([np.concatenate(x).astype(np.int64) for x in zip(*marks, strict=True)]), axis=1)
                    marks = [(together[0], together[1], together[2].astype(np.int32))]
    if ids:
        yield done()


_CONTEXTS = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("deep", pa.int64()), ("bytes", pa.binary())])
CONTEXTS = "gram long, key long, place long, kind int, deep long, bytes binary"


def _contexts(length: int):
    """The bytes of each open block; of those in wide buckets, their offsets."""

    def spread(rows: list[tuple]) -> pa.RecordBatch:
        gram, key, place, kind, data = zip(*rows, strict=True)
        gram, key, place, kind = (np.array(x, np.int64) for x in (gram, key, place, kind))
        row, nth, bucket, deep = offsets(gram, place, list(data), length)
        marks = (place[row] >> 32) + nth << 32 | place[row] & 16383
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(key[row]), pa.array(marks), pa.array((kind[row] | WIDE).astype(np.int32)), pa.array(deep.view(np.int64)), pa.nulls(len(row), pa.binary())], schema=_CONTEXTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        wide: list[tuple] = []
        for _, key, _, data, place, gram, kind in _documents(batches):
            for p, g, k in zip(place.tolist(), gram.tolist(), kind.tolist(), strict=True):
                lo = p >> 32
                part = data[lo : lo + (p >> 24 & 255) + length]
                if k & WIDE:
                    wide.append((g, key, p, k & ~WIDE, part))
                else:
                    rows.append((g, key, p, k, 0, part))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTEXTS.types, strict=True)], schema=_CONTEXTS)
                rows = []
            if len(wide) >= 2_000:
                yield spread(wide)
                wide = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTEXTS.types, strict=True)], schema=_CONTEXTS)
        if wide:
            yield spread(wide)

    return run


_FOUND = pa.schema([("key", pa.int64()), ("place", pa.int64())])


def offsets(gram: np.ndarray, place: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each window start of each block: the block, its number there, its
    bucket (gram and offset from the anchor) and its identifier at full depth."""
    more, anchor = place >> 24 & 255, place >> 16 & 255
    size = np.array([len(x) for x in data])
    off = np.cumsum(size) - size
    deep = gram_ids(np.frombuffer(b"".join(data), np.uint8), length)
    row = np.repeat(np.arange(len(data)), more + 1)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    bucket = pair(gram[row].view(U), (anchor[row] - nth + 256).astype(U))
    return row, nth, bucket, deep[off[row] + nth]


def _sort_offsets(length: int):
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        gram, key, place, kind, data = zip(*rows, strict=True)
        gram, key, place, kind = (np.array(x, np.int64) for x in (gram, key, place, kind))
        row, nth, bucket, deep = offsets(gram, place, list(data), length)
        both = pair(bucket, deep)
        order = np.argsort(both, kind="stable")
        head = np.concatenate(([True], both[order][1:] != both[order][:-1]))
        same = np.cumsum(head) - 1
        weight = np.bincount(same, np.where(kind[row][order] == SHARED, 2, 1))
        hit = np.empty(len(row), bool)
        hit[order] = weight[same] >= 2
        hit &= kind[row] == LONE
        # runs of hits within a block
        start = hit & np.concatenate(([True], ~hit[:-1] | (row[1:] != row[:-1])))
        end = hit & np.concatenate((~hit[1:] | (row[1:] != row[:-1]), [True]))
        a, b = np.flatnonzero(start), np.flatnonzero(end)
        r = row[a]
        marks = (place[r] >> 32) + nth[a] << 32 | (b - a) << 24 | place[r] & 16383
        return pa.RecordBatch.from_arrays([pa.array(key[r]), pa.array(marks)], schema=_FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams the blocks of buckets, each of bounded size, and sorts many buckets at once."""
        ready: list[tuple] = []
        gram = None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "place", "kind", "bytes")), strict=True):
                if r[0] != gram and len(ready) >= _SORT:
                    yield settle(ready)
                    ready = []
                gram = r[0]
                ready.append(r)
        if ready:
            yield settle(ready)

    return run


def _check(length: int, gram: int) -> None:
    if not 8 <= gram <= length or length - gram > 254:
        raise ValueError("gram must be 8 or more, and length at most 254 beyond it")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, hold: int = HOLD) -> DataFrame:
    """(key, place, gram, kind) of every run of starts of repeated strings:
    ``place`` holds the first start (bits 32 and up), starts beyond it (bits
    24-31) and the row's tag (bits 0-13)."""
    _check(length, gram)
    stored = _key(docs).select("key", "tag", "text").mapInArrow(_blocks(length, gram), "gram long, block long, key long, place long")
    dealt = stored.repartition("gram", "block").sortWithinPartitions("gram", "block")
    marks = written(dealt.mapInArrow(_refine(hold), "key long, place long, gram long, kind int"), "suffix-marks")
    one_each = marks.where(f"kind != {KNOWN}")
    buckets = one_each.groupBy("gram").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == LONE).alias("lone")).where("blocks >= 2 and lone >= 1")
    buckets = written(buckets.select("gram", F.when(F.col("blocks") > group, WIDE).otherwise(0).alias("wide")), "suffix-buckets")
    open_ = one_each.join(buckets, "gram").select("key", "place", "gram", F.expr("int(kind | wide)").alias("kind"))
    found = written(_with_texts(docs, open_).mapInArrow(_contexts(length), CONTEXTS), "suffix-contexts")
    narrow = found.where(f"kind & {WIDE} = 0").select("gram", "key", "place", "kind", "bytes")
    near = narrow.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_offsets(length), "key long, place long")
    spread = found.where(f"kind & {WIDE} != 0").select("gram", "deep", "key", "place", F.expr(f"if(kind & {SHARED} = {SHARED}, 2, 1)").alias("weight"))
    shared = spread.groupBy("gram", "deep").agg(F.sum("weight").alias("n")).where("n >= 2").select("gram", "deep")
    far = spread.where("weight = 1").join(shared, ["gram", "deep"]).select("key", "place")
    return marks.where(f"kind = {KNOWN}").select("key", "place").unionByName(near).unionByName(far).select("key", "place", F.lit(0).cast("long").alias("gram"), F.lit(KNOWN).alias("kind"))


def merged(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of removed bytes."""
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = place >> 32
    order = np.argsort(start, kind="stable")
    start = start[order]
    end = np.maximum.accumulate(start + (place[order] >> 24 & 255) + length)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digests(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for ids, _, _, data, place, _, _ in _documents(batches):
            start, end = merged(place, length)
            kept, at = hashlib.sha256(), 0
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            rows += [(doc, len(data), int((end - start).sum()), len(start), kept.hexdigest()) for doc in ids]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)

    return run


def removal_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, hold: int = HOLD) -> DataFrame:
    """Size, removed bytes, removed runs and a digest of what is kept, of each document."""
    return _with_texts(docs, repeated_starts(docs, length, gram, group, hold)).mapInArrow(_digests(length), DIGESTS)


def cut(data: bytes, start: np.ndarray, end: np.ndarray) -> str:
    """The text without these bytes; a character cut in part stays whole."""
    out, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]]).decode()


def _cut_all(length: int, runs: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            found = batch.column(runs).to_pylist()
            texts = [t if t is None or not r else cut(t.encode(), *merged(np.array(r, np.int64), length)) for t, r in zip(batch.column(place).to_pylist(), found, strict=True)]
            kept = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield kept.select([n for n in kept.schema.names if n != runs])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, hold: int = HOLD) -> DataFrame:
    """The documents without their repeated bytes, all columns kept, whatever
    their names; ``n_chars``, where there is one, follows the new text."""
    key, tag, runs, own_key, own_tag = unused(docs, "key", "tag", "repeated_starts", "found_key", "found_tag")
    starts = repeated_starts(docs, length, gram, group, hold).select(F.col("key").alias(own_key), F.expr("place & 16383").alias(own_tag), "place")
    # Of a document, at most one place for each of its bytes.
    found = starts.distinct().groupBy(own_key, own_tag).agg(F.collect_list("place").alias(runs))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))), tag: F.expr("hash(coalesce(text, '')) & 16383").cast("long")})
    joined = keyed.join(found, (F.col(key) == F.col(own_key)) & (F.col(tag) == F.col(own_tag)), "left").select(*docs.columns, runs)
    out = joined.mapInArrow(_cut_all(length, runs), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

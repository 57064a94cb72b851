"""Token-id files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents, and ends after the document that
takes it to ``SHARD_TOKENS`` ids or ``SHARD_DOCS`` documents: files and the index
that a reader or writer holds are bounded, up to one document.  Blocks of
``BLOCK`` ids store their minimum, a width taken at a percentile of the
differences to it, the packed low bits, and an exception list (place, high bits)
of the outliers.  An index at the end has the byte at which each block starts,
then the documents with their numbers of ids; all blocks but the last are of
``BLOCK`` ids, so ``seek`` reads the index and the blocks of one document alone.

Shard layout, little-endian: blocks; index (u64 block starts; i64 doc ids,
u8 null marks, u64 counts); trailer (u64 index start, u64 blocks, u64 documents, magic).
Block layout: u32 minimum, u16 ids, u8 width, u8 zero, u32 exceptions, packed
words (u64), exception places (u16), exception high parts (u32).

Defined results: documents are ordered by doc_id, then text, nulls first (the
range shuffle looks at the first ``TIE`` characters, so that rows of one doc_id
or none can be split); a null text is empty and has the end id alone; repeated
rows are written one by one;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import file_system, new_folder, only, whole_file
from trellis.llm.tokens import byte_ids

BLOCK = 1024
PERCENTILE = 90
END_ID = 0
MAGIC = b"PFORIDS1"
_HEAD, _TAIL = "<IHBBI", "<QQQ8s"
_HEAD_SIZE, _TAIL_SIZE = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
_FLUSH = 1 << 20
SHARD_TOKENS = 1 << 26
SHARD_DOCS = 1 << 20
TIE = 64

SHARDS = "task long, part long, uri string, n_docs long, n_tokens long"
_SHARDS = pa.schema([("task", pa.int64()), ("part", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, n) values below ``2**width`` as rows of u64 words, 64 values to ``width`` words."""
    rows, n = values.shape
    groups = -(-n // 64)
    v = np.zeros((rows, groups * 64), np.uint64)
    v[:, :n] = values
    v = v.reshape(rows, groups, 64)
    out = np.zeros((rows, groups, width), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, :, word] |= v[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= v[:, :, k] >> np.uint64(64 - shift)
    return out.reshape(rows, groups * width)


def unpack_bits(words: np.ndarray, width: int, n: int) -> np.ndarray:
    rows, groups = words.shape[0], -(-n // 64)
    out = np.zeros((rows, groups, 64), np.uint64)
    if width:
        w, mask = words.reshape(rows, groups, width), np.uint64((1 << width) - 1)
        for k in range(64):
            word, shift = divmod(k * width, 64)
            x = w[:, :, word] >> np.uint64(shift)
            if shift + width > 64:
                x = x | (w[:, :, word + 1] << np.uint64(64 - shift))
            out[:, :, k] = x & mask
    return out.reshape(rows, groups * 64)[:, :n]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` ids, the last one perhaps shorter."""
    out: list[bytes] = [b""] * -(-len(ids) // BLOCK)
    whole = len(ids) // BLOCK
    parts = [(0, ids[: whole * BLOCK].reshape(whole, BLOCK))] if whole else []
    if len(ids) % BLOCK:
        parts.append((whole, ids[None, whole * BLOCK :]))
    for first, block in parts:
        low = block.min(axis=1)
        diff = (block - low[:, None]).astype(np.uint64)
        k = (block.shape[1] - 1) * PERCENTILE // 100
        bound = np.partition(diff, k, axis=1)[:, k]
        widths = np.array([int(b).bit_length() for b in bound])
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            d = diff[at]
            packed = pack_bits(d & np.uint64((1 << int(width)) - 1), int(width))
            high = (d >> np.uint64(width)).astype("<u4")
            for r, i in enumerate(at):
                places = np.flatnonzero(high[r])
                out[first + i] = b"".join((struct.pack(_HEAD, int(low[i]), block.shape[1], int(width), 0, len(places)), packed[r].astype("<u8").tobytes(), places.astype("<u2").tobytes(), high[r][places].tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` of ``data``."""
    heads = [struct.unpack_from(_HEAD, data, int(s)) for s in starts]
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(heads)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, width, _, _) in enumerate(heads):
        alike.setdefault((n, width), []).append(i)
    for (n, width), at in alike.items():
        size = -(-n // 64) * width
        words = np.stack([np.frombuffer(data, "<u8", size, int(starts[i]) + _HEAD_SIZE) for i in at]) if width else np.zeros((len(at), 0), np.uint64)
        values = unpack_bits(words, width, n)
        for r, i in enumerate(at):
            low, _, _, _, odd = heads[i]
            v, p = values[r], int(starts[i]) + _HEAD_SIZE + 8 * size
            if odd:
                v[np.frombuffer(data, "<u2", odd, p)] |= np.frombuffer(data, "<u4", odd, p + 2 * odd).astype(np.uint64) << np.uint64(width)
            out[i] = (v + np.uint64(low)).astype(np.uint32)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class _Shard:
    """A shard in the making: holds the ids of a block or so, and the index."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.at, self.held, self.total = out, 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.starts, self.counts, self.names = [], [], []

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.names.append(name)
        self.counts.append(len(ids))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= _FLUSH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        joined = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint32)
        keep = 0 if last else len(joined) % BLOCK
        for block in encode_blocks(joined[: len(joined) - keep]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.ids, self.held = [joined[len(joined) - keep :]], keep

    def close(self) -> None:
        self.flush(True)
        for x, kind in ((self.starts, "<u8"), ([n or 0 for n in self.names], "<i8"), ([n is None for n in self.names], "u1"), (self.counts, "<u8")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(struct.pack(_TAIL, self.at, len(self.starts), len(self.names), MAGIC))


def _write(folder: str, tokenizer: str, shard_tokens: int, shard_docs: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = byte_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([END_ID], np.uint32)
        documents = ((doc.as_py(), text.as_py()) for batch in batches for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True))
        row, part = next(documents, None), 0
        while row is not None:
            uri = f"{folder}/shard-{task:06d}-{part:06d}-{uuid.uuid4().hex}.pfor"  # of this attempt alone
            with whole_file(uri) as out:
                shard = _Shard(out)
                while row is not None and shard.total < shard_tokens and len(shard.names) < shard_docs:
                    shard.add(row[0], np.concatenate((encode(row[1]), end)))
                    row = next(documents, None)
                shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((task, part, uri, len(shard.names), shard.total), _SHARDS.types, strict=True)], schema=_SHARDS)
            part += 1

    return run


def write_id_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> list[tuple[str, int]]:
    """Writes the shards, in ascending order of documents; returns (uri, ids
    before it) of each.  One range shuffle orders the documents; the list has
    one entry for each file, of which there is one to a shuffle partition until
    files reach their full size."""
    ordered = only(docs).repartitionByRange("doc_id", F.left("text", F.lit(TIE))).sortWithinPartitions("doc_id", "text")
    shards = sorted((r.task, r.part, r.uri, r.n_tokens) for r in ordered.mapInArrow(_write(folder, tokenizer, shard_tokens, shard_docs), SHARDS).collect())
    out, before = [], 0
    for _, _, uri, n in shards:
        out.append((uri, before))
        before += n
    return out


def _index(f: pa.NativeFile, uri: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the index starts, block starts, doc_ids, null marks and numbers of ids."""
    size = f.size()
    index, blocks, docs, magic = struct.unpack(_TAIL, f.read_at(_TAIL_SIZE, size - _TAIL_SIZE))
    if magic != MAGIC:
        raise ValueError(f"{uri} is not a shard of token ids")
    raw = f.read_at(size - _TAIL_SIZE - index, index)
    starts, names = np.frombuffer(raw, "<u8", blocks), np.frombuffer(raw, "<i8", docs, 8 * blocks)
    return index, starts, names, np.frombuffer(raw, "u1", docs, 8 * blocks + 8 * docs), np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs)


def seek(uri: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each document of this doc_id in a shard; of the shard's
    blocks, only those that hold them are read."""
    fs, path = file_system(uri)
    out = []
    with fs.open_input_file(path) as f:
        index, starts, names, empty, counts = _index(f, uri)
        ends = np.cumsum(counts.astype(np.int64))
        for k in np.flatnonzero(empty == 1 if doc_id is None else (empty == 0) & (names == doc_id)):
            first, last = int(ends[k] - counts[k]), int(ends[k])
            a, b = first // BLOCK, -(-last // BLOCK)
            stop = int(starts[b]) if b < len(starts) else index
            ids = decode_blocks(f.read_at(stop - int(starts[a]), int(starts[a])), starts[a:b] - starts[a])
            out.append(ids[first - a * BLOCK : last - a * BLOCK])
    return out


def read_shard(uri: str, batch_blocks: int = 1024) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, ids, whether the document ends here) of a shard, in pieces of bounded size."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        index, starts, names, empty, counts = _index(f, uri)
        blocks, docs = len(starts), len(names)
        doc, left = 0, int(counts[0]) if docs else 0
        for b in range(0, blocks, batch_blocks):
            here = starts[b : b + batch_blocks]
            stop = int(starts[b + batch_blocks]) if b + batch_blocks < blocks else index
            ids = decode_blocks(f.read_at(stop - int(here[0]), int(here[0])), here - here[0])
            at = 0
            while at < len(ids):
                take = min(left, len(ids) - at)
                left -= take
                yield (None if empty[doc] else int(names[doc])), ids[at : at + take], not left
                at += take
                if not left:
                    doc += 1
                    left = int(counts[doc]) if doc < docs else 0


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows: list[tuple] = []
            crc = n = 0
            for doc, ids, ends in read_shard(uri):
                crc, n = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), crc), n + len(ids)
                if ends:
                    rows.append((doc, start, n, crc))
                    start, crc, n = start + n, 0, 0
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_READ)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_READ)


def read_id_files(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """Each document of the shards, decoded from the files; a task to a shard."""
    listed = spark.createDataFrame(shards or [("", 0)], "uri string, start long")
    if not shards:
        listed = listed.where("false")
    return listed.repartition(max(1, len(shards))).mapInArrow(_read, READ)


def written_and_read(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    spark = docs.sparkSession
    return read_id_files(spark, write_id_files(docs, new_folder(spark, "ids"), tokenizer, shard_tokens))

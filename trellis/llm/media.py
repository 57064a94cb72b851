"""Media columns: content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, padded with zero bytes to a positive multiple
of ``WIDTH``.  Its stored form is an 8-bit greyscale PNG, ``WIDTH`` samples to a
row; a tar member named by the payload's SHA-256 holds it.  Rows carry digest,
shard, offset and length.  A task stores equal payloads once; where several
tasks met the same content, the first location by name becomes the digest's
only one, and all rows refer to it.

Metadata columns come from range reads of a member's first ``HEADER`` bytes;
only ``read_media`` fetches whole members.

Defined results: a null text is empty (one row of zero samples); repeated rows
share a location and stay rows of their own; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import file_system, new_folder, only, whole_file, written

WIDTH = 64
HEADER = 33
LEVEL = 6
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
HEADERS = "digest string, shard string, offset long, length long, width long, height long, bit_depth long"
_HEADERS = pa.schema([("digest", pa.string()), ("shard", pa.string()), *((c, pa.int64()) for c in ("offset", "length", "width", "height", "bit_depth"))])
READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
_READ = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int64()), ("height", pa.int64())])


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Each row gets the filter byte 0, so the samples are the payload's bytes."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _part(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a member's first ``HEADER`` bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return width, height, depth


def from_png(data: bytes) -> np.ndarray:
    width, height, _ = read_header(data)
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, range, sum and a 16-bin histogram of the samples."""
    bins = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"{samples.shape[1]}x{samples.shape[0]};{samples.min()}-{samples.max()};{int(samples.sum(dtype=np.int64))};" + ",".join(map(str, bins))


def tar_header(name: str, size: int) -> bytes:
    """A ustar header; fixed times and owners keep equal content equal."""
    head = bytearray(512)
    head[: len(name)] = name.encode()
    for at, field in ((100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(field)] = field
    head[148:156] = b" " * 8
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def _store(folder: str, shard_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        batch, first = next(batches, None), 0
        while batch is not None:
            shard = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"  # of this attempt alone
            kept: dict[bytes, tuple[int, int]] = {}
            at = 0
            with whole_file(f"{folder}/{shard}") as out:
                while batch is not None and at < shard_bytes:
                    rows: list[tuple] = []
                    docs, texts = batch.column("doc_id"), batch.column("text")
                    while first < batch.num_rows and at < shard_bytes:
                        data = texts[first].as_py().encode()
                        payload = padded(data)
                        key = hashlib.sha256(payload).digest()
                        if key not in kept:
                            media = to_png(payload)
                            out.write(tar_header(key.hex() + ".png", len(media)) + media + bytes(-len(media) % 512))
                            kept[key] = (at + 512, len(media))
                            at += 512 + len(media) + -len(media) % 512
                        rows.append((docs[first].as_py(), len(data), key.hex(), shard, *kept[key]))
                        first += 1
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)
                    if first >= batch.num_rows:
                        batch, first = next(batches, None), 0
                out.write(bytes(1024))

    return run


def store_media(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and returns the rows of media columns, each digest at
    one location.  The rows are written before they are read again, so they
    name only files of tasks that succeeded."""
    rows = written(only(docs).mapInArrow(_store(folder, shard_bytes), ROWS), "media-rows")
    place = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    placed = rows.select("doc_id", "n_bytes", "digest").join(place, "digest").select("doc_id", "n_bytes", "digest", "place.shard", "place.offset", "place.length")
    return written(placed, "media-columns")  # read by several consumers


def _ranges(folder: str, schema: pa.Schema, whole: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        opened, file = None, None
        for batch in batches:
            rows: list[tuple] = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != opened:
                    if file is not None:
                        file.close()
                    opened, file = shard, fs.open_input_file(f"{path}/{shard}")
                width, height, depth = read_header(file.read_at(min(HEADER, length), offset))
                if whole:
                    data = file.read_at(length, offset)
                    samples = from_png(data)
                    payload = samples.tobytes()
                    rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), length, hashlib.sha256(data).hexdigest(), features(samples), width, height))
                else:
                    rows.append((digest, shard, offset, length, width, height, depth))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if file is not None:
            file.close()

    return run


def _places(media: DataFrame) -> DataFrame:
    """Distinct locations, in reading order; ranges of a shard stay together."""
    return media.select("digest", "shard", "offset", "length").distinct().repartition("shard").sortWithinPartitions("shard", "offset")


def media_headers(media: DataFrame, folder: str) -> DataFrame:
    """Width, height and depth of each digest, from header-only range reads."""
    return _places(media).mapInArrow(_ranges(folder, _HEADERS, False), HEADERS)


def read_media(media: DataFrame, folder: str) -> DataFrame:
    """Checksums and features of each digest from its stored bytes, after its
    metadata from a range read of its header."""
    return _places(media).mapInArrow(_ranges(folder, _READ, True), READ)


def stored_and_read(docs: DataFrame) -> DataFrame:
    folder = new_folder(docs.sparkSession, "media")
    media = store_media(docs, folder)
    return media.select("doc_id", "n_bytes", "digest", "offset", "length").join(read_media(media, folder), "digest").drop("digest")

"""What the corpus operators share: inputs, Arrow buffers and shared storage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.kernels import CHUNK_BYTES, chunks


def only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, as (doc_id long, text string).

    A null text becomes the empty string.  All other columns are left out, so
    their names cannot clash with those that the operators add.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores added as keep it apart from
    the columns of ``docs``, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Clusters name it in ``spark.checkpoint.dir``; only where that is unset, as
    in tests, a folder below the warehouse stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trellis-shared"
    return base.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; nothing else ever writes there."""
    return f"{shared_folder(spark)}/trellis-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends here,
    and a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame, kind: str, files: int = 8) -> DataFrame:
    """``written`` for an aggregate of few rows: its last stage runs as at most
    ``files`` tasks, which read the partial sums of all partitions."""
    return written(df.coalesce(files), kind)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextlib.contextmanager
def whole_file(uri: str) -> Iterator[pa.NativeFile]:
    """Writes a file under a name of its own and moves it into place once
    complete, so that a retried or speculative task leaves no half a file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(draft) as out:
            yield out
        fs.move(draft, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(draft)
        raise


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, uncopied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), off


def text_chunks(
    batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) in pieces of about ``limit`` bytes."""
    buf, off = utf8(batch.column(column))
    for a, b in chunks(np.diff(off).tolist(), limit):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def arrow_map(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``, named once so that all operators cross to Python alike."""
    return df.mapInArrow(function, schema)


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit identifiers as Spark's long."""
    return x.view(np.int64)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Token counts from distinct pre-tokens.

A pre-token starts at a run of word marks (spaces become marks, and one stands
before the text) or at a newline.  No piece of the model has a mark after
another character, nor a newline, so no merge crosses these boundaries and the
count of a text is the sum over its pre-tokens.

The vocabulary of the corpus is aggregated first, and the model counts the
pieces of each distinct pre-token once.  Its ``HEAD`` most frequent entries of
at most ``HEAD_CHARS`` characters, a bounded table, go to all tasks, which add
them up within a document; all other pre-tokens of a document join the counted
vocabulary in a shuffle, with their frequencies.  A pre-token of more than
``LONG`` characters, as in text without spaces, is counted where it stands: it
would be a shuffle key of any length.  Buffers are bounded by characters.

Defined results: a null text is empty and has no tokens; repeated rows are
counted one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import only, written
from trellis.llm.tokens import tokenizer_path

HEAD = 1 << 17
HEAD_CHARS = 32
LIMIT = 4096
#: Characters of a pre-token that travels.
LONG = 256
#: Pre-tokens, and their characters, that a task holds before it sends them on.
_FLUSH = 300_000
_FLUSH_CHARS = 16 << 20
_PIECE = re.compile(r"▁+[^▁\n]*|\n[^▁\n]*")


@lru_cache(2)
def pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


def pretokens(text: str) -> list[str]:
    """Joined together, they are the text with its marks."""
    return _PIECE.findall("▁" + text.replace(" ", "▁")) if text else []


def count_pieces(model, tokens: list[str]) -> list[int]:
    """The model puts a mark before what it encodes: it stands for the first
    mark of a pre-token, and is one piece too many before a newline."""
    found = model.encode([t[1:] if t[0] == "▁" else t for t in tokens], num_threads=1)
    return [len(ids) - (t[0] != "▁") if len(t) > 1 or t[0] != "▁" else 1 for t, ids in zip(tokens, found, strict=True)]


_FREQUENCIES = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    chars = 0

    def rows() -> pa.RecordBatch:
        tokens = [t for t in seen if len(t) <= LONG]
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([seen[t] for t in tokens], pa.int64())], schema=_FREQUENCIES)

    for batch in batches:
        for text in batch.column("text"):
            said = text.as_py()
            seen.update(pretokens(said))
            chars += len(said)  # no fewer than what the text adds
            if len(seen) >= _FLUSH or (chars >= _FLUSH_CHARS and (chars := sum(map(len, seen))) >= _FLUSH_CHARS):
                yield rows()
                seen.clear()
                chars = 0
    if seen:
        yield rows()


_COUNTED = pa.schema([("pretoken", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])


def _count(name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for batch in batches:
            tokens = batch.column("pretoken").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n"), pa.array(count_pieces(model, tokens), pa.int64())], schema=_COUNTED)

    return run


def vocabulary(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(pretoken, n, pieces): each distinct pre-token, how often it occurs and its pieces."""
    seen = only(docs).mapInArrow(_frequencies, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return seen.mapInArrow(_count(model), "pretoken string, n long, pieces long")


_PARTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("rows", pa.int64()), ("n", pa.int64()), ("pretoken", pa.string())])


def _parts(head, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = head.value, pieces(name)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            add = [c.append for c in columns]
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                total = 0
                for token, n in Counter(pretokens(text)).items():
                    if (one := known.get(token)) is not None:
                        total += one * n
                    elif len(token) > LONG:
                        total += count_pieces(model, [token])[0] * n
                    else:
                        for f, v in zip(add, (doc, key, 0, 0, n, token), strict=True):
                            f(v)
                # Its own row; a key that no pre-token has spreads these rows over the tasks.
                for f, v in zip(add, (doc, key, len(text.encode()), 1, total, f"-{key}"), strict=True):
                    f(v)
                if len(columns[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARTS.types, strict=True)], schema=_PARTS)
                    columns = [[] for _ in range(6)]
                    add = [c.append for c in columns]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARTS.types, strict=True)], schema=_PARTS)

    return run


def _common(counted: DataFrame, head: int) -> DataFrame:
    """The most frequent short pre-tokens, at most ``head``: all from a frequency
    up that a histogram of 16 bins to an octave gives, so no rows are ranked."""
    short = counted.where(F.length("pretoken") <= HEAD_CHARS).withColumn("bin", F.floor(16 * F.log2("n")))
    rows, least = 0, None
    for r in sorted(short.groupBy("bin").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.bin):
        rows += r.rows
        if rows > head:
            break
        least = r.bin
    return short.where(F.lit(False) if least is None else F.col("bin") >= least).select("pretoken", "pieces")


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document."""
    spark = docs.sparkSession
    counted = written(vocabulary(docs, model), "vocabulary")
    sent = spark.sparkContext.broadcast(dict(map(tuple, _common(counted, head).collect())))
    texts = only(docs).withColumn("text_hash", F.xxhash64("text"))
    parts = texts.mapInArrow(_parts(sent, model), "doc_id long, text_hash long, n_bytes long, rows long, n long, pretoken string")
    found = parts.join(counted.select("pretoken", "pieces"), "pretoken", "left")
    # Rows alike in doc_id and text meet here: each has added its parts, so each gets an equal share.
    total = found.groupBy("doc_id", "text_hash").agg(
        F.sum("rows").alias("rows"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    )
    one = total.select("doc_id", F.expr("n_bytes div rows").alias("n_bytes"), F.expr("n_tokens div rows").alias("n_tokens"), F.explode(F.expr("array_repeat(0, int(rows))")).alias("copy"))
    return one.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""BPE encoding and decoding with tree concatenation.

A long text is cut into leaves of ``LEAF`` characters, wherever they end; each is
split and encoded by itself, and neighbours are joined pairwise, up a tree: a
window around the join is split and encoded anew, and doubled until its first and
its last split agree with what the two sides had there.  A split of more than
``LEAF_SYMBOLS`` symbols, as in text without spaces, is encoded in the same way
one level down: its parts go to the library as one batch, which encodes them in
parallel, and are joined by windows of tokens.

That agreement is exact.  The text is normalised as a whole before it is cut.
Splitting then runs from left to right, and where a split ends depends on it and
the next character alone, so a window that starts where a split of the left
side starts finds what the whole text has, and once it ends a split where the
right side ends the same one, the rest is as the right side had it.  Inside a
split, a sequence of tokens is the encoding of its text if and only if each pair
of neighbours is the encoding of theirs: merges run in order of rank, then
place, so those inside two neighbours come in the same order whether others run
beside them or not, and the first merge across a boundary would happen in the
pair alone as well.  Every pair of the joined sequence stands in an encoding: of
the left, of the window or of the right.

Encodings of short splits are remembered.  A file whose normaliser, splitter or
model differs from those that this relies on is refused.

Defined results: a null text is empty and has no tokens; special strings inside
texts become their ids; repeated rows are encoded one by one; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm.common import only
from trellis.llm.tokens import tokenizer_path

LEAF = 1024
LEAF_SYMBOLS = 512
WINDOW = 4
REMEMBERED = 200_000
#: What a file must say, as fixed values: how texts are normalised and split.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}

#: Texts of these characters alone take the short way: lower-casing and
#: splitting are those of the tokenizer's file for each of them.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class TreeBpe:
    """A tokenizers file with BPE over byte-level symbols and word ends."""

    def __init__(self, path: str, leaf: int = LEAF, leaf_symbols: int = LEAF_SYMBOLS) -> None:
        import tokenizers
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.leaf, self.leaf_symbols, self.joins = leaf, leaf_symbols, 0
        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (spec["normalizer"], spec["pre_tokenizer"], {k: model.get(k) for k in MODEL}) != (NORMALIZER, SPLITTER, MODEL):
            raise ValueError(f"{path} does not normalise, split or merge as this encoder does")
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        #: Encodes the last part of a split, and any other part.
        self.final = tokenizers.Tokenizer(BPE(vocab, merges, end_of_word_suffix=self.suffix or None))
        self.inner = tokenizers.Tokenizer(BPE(vocab, merges))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.joined_by = " " if spec["decoder"] is None else None
        self.symbols = ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}

    # -- a text as splits

    def scan(self, text: str, plain: bool) -> list[str]:
        """The splits of a normalised text."""
        if plain:
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def splits(self, text: str) -> list[str]:
        """The splits of a text without special strings, by tree concatenation."""
        plain = _PLAIN.fullmatch(text) is not None
        text = text.lower() if plain else self.whole.normalizer.normalize_str(text)
        if len(text) <= self.leaf:
            return self.scan(text, plain)
        nodes = [(self.scan(text[i : i + self.leaf], plain), i, min(i + self.leaf, len(text))) for i in range(0, len(text), self.leaf)]
        while len(nodes) > 1:
            last = len(nodes) - 1
            nodes = [self.concatenate(text, plain, nodes[i], nodes[i + 1]) if i < last else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0][0]

    def concatenate(self, text: str, plain: bool, one: tuple[list[str], int, int], two: tuple[list[str], int, int]) -> tuple[list[str], int, int]:
        """The splits of two neighbouring parts of a text from theirs."""
        left, begin, cut = one
        right, _, end = two
        size = WINDOW
        self.joins += 1
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            first, last = cut, cut
            # Between splits there is only white space, which no split has.
            for s in reversed(left[len(left) - a :]) if a < len(left) else ():
                first = text.rindex(s, begin, first)
            for s in right[:b] if b < len(right) else ():
                last = text.index(s, last, end) + len(s)
            first, last = first if a < len(left) else begin, last if b < len(right) else end
            window = self.scan(text[first:last], plain)
            if (a == len(left) or (window and window[0] == left[-a])) and (b == len(right) or (window and window[-1] == right[b - 1])):
                left[len(left) - a :] = window
                left += right[b:]
                return left, begin, end
            size *= 2

    # -- a split as tokens

    def spell(self, ids: list[int], last: bool) -> str:
        text = "".join(map(self.token.__getitem__, ids))
        return text[: len(text) - len(self.suffix)] if last and self.suffix else text

    def encode_split(self, symbols: str) -> list[int]:
        step = self.leaf_symbols
        if len(symbols) <= step:
            return self.final.encode(symbols, add_special_tokens=False).ids
        cuts = [symbols[i : i + step] for i in range(0, len(symbols), step)]
        parts = [e.ids for e in self.inner.encode_batch(cuts[:-1], add_special_tokens=False)]
        parts.append(self.final.encode(cuts[-1], add_special_tokens=False).ids)
        while len(parts) > 1:
            last = len(parts) - 1
            parts = [self.join(parts[i], parts[i + 1], i + 1 == last) if i < last else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two neighbours' text from theirs; ``last``: the split ends here."""
        size = WINDOW
        self.joins += 1
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            ends = last and b == len(right)
            text = self.spell(left[len(left) - a :], False) + self.spell(right[:b], ends)
            ids = (self.final if ends else self.inner).encode(text, add_special_tokens=False).ids
            if (a == len(left) or ids[0] == left[len(left) - a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[: len(left) - a] + ids + right[b:]
            size *= 2

    def entry(self, split: str) -> tuple[str, tuple[int, ...]]:
        """The ids of a split, as text too, remembered."""
        if (found := self.known.get(split)) is None:
            spelled = split if split.isascii() and split.isprintable() else self.symbols.pre_tokenize_str(split)[0][0]
            ids = self.encode_split(spelled)
            found = (" ".join(map(str, ids)), tuple(ids))
            if len(split) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[split] = found
        return found

    def entries(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        out: list[tuple[str, tuple[int, ...]]] = []
        known = self.known
        for part in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if part in self.special:
                out.append((str(self.special[part]), (self.special[part],)))
            elif part:
                out += [known.get(s) or self.entry(s) for s in self.splits(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([ids for _, ids in self.entries(text)]))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        if self.joined_by is None:
            return self.whole.decode(ids, skip_special_tokens=False)
        return self.joined_by.join(map(self.token.__getitem__, ids))


@lru_cache(2)
def tree_bpe(name: str) -> TreeBpe:
    return TreeBpe(tokenizer_path(name))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(name)
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch.column("text"):
                found = bpe.entries(text.as_py())
                ids = list(chain.from_iterable([x for _, x in found]))
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join([x for x, _ in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts)], schema=_DIGESTS)

    return run


def token_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Number of tokens, and digests of ids and decoded text; a narrow map."""
    return only(docs).mapInArrow(_digests(tokenizer), DIGESTS)


def _ids(name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.encode(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))], schema=schema)

    return run


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return only(docs).mapInArrow(_ids(tokenizer), "doc_id long, ids array<int>")


def _texts(name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())], schema=schema)

    return run


def decode_documents(ids: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return ids.select("doc_id", "ids").mapInArrow(_texts(tokenizer), "doc_id long, text string")

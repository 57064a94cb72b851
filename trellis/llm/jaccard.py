"""Exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance ``1 - |x & y| / |x | y|`` is a metric, so distances to a
pivot bound all others.  Two sets link at a similarity of ``threshold`` or more,
a distance of at most ``r``.

1. *Points.*  Equal sets become one point; copies never multiply.
2. *Regions.*  Most pairs of sets share nothing and lie at distance 1, where no
   pivot can tell them apart, so pivots are taken where sets meet: shingles are
   ordered from rare to frequent, and linked sets must share one among their
   first ``n - ceil(threshold * n) + 1``.  The smallest point that holds a
   shingle there is the pivot of all others that do; its region is every point
   it is pivot of by any shingle.  A point near several pivots is replicated to
   each, so both ends of a link always meet in one region.
3. *Pivot vectors.*  Each set also has a vector of its shingles in ``CLASSES``
   classes of the universe: up to constants, its distances to the class sets.
   By the triangle inequality in each class, the sum of absolute differences of
   two vectors is at most the size of the sets' symmetric difference.  Points
   that cannot link to any other of their region by sizes and vectors leave it,
   and a region falls into the parts that can still be connected; texts are
   fetched for these parts alone.
4. *Windows.*  In a region, points are sorted by their exact distance to the
   pivot.  Points whose distances differ by more than ``r`` cannot link; all
   others are compared block by block inside the window, exactly.
5. *Recursion.*  A region too large for one task chooses pivots of its own, by a
   hash.  Each point goes to the cell of its nearest pivot (its Voronoi cell), and
   is replicated to the cells of lesser pivots that are at most ``2 r`` further
   away: by the triangle inequality, both ends of a link meet in the cell of the
   lesser of their two nearest pivots.  Only keys are replicated while cells are
   chosen.  Cells are regions with pivots and windows of their own, down to those
   that one task joins.  Where windows overlap so much that cells hold over
   ``SPREAD`` times the points, as in one family of near copies, pivots cannot
   separate them: that region is joined by pairs of blocks of ``BLOCK`` points.

A pair that meets in several regions counts in that of the least pivot that its
ends share, and in one cell there, so each link counts once and no task holds
or sends all pairs.  A task sends, for each point, its number of links, and of
the links a spanning forest; ``point_links`` gives every pair instead.
Components of the forests come from rounds of smallest-neighbour contraction; a
document's number of links counts each document of a linked point, and the
other copies of its own.

The order of shingles counts them in ``2 ** SKETCH_BITS`` classes over all
documents; any order is exact, this one keeps frequent shingles out of use.

Shingles are 64-bit identifiers.  Words are runs of bytes other than the six
white-space bytes, A-Z lower-cased; a text with fewer words than ``n`` is one
shingle, one without words has an empty set and links with nothing.

Defined results: a null text is empty; repeated rows are documents of their own
and link; a component's id is its smallest doc_id (null only if all are null);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import only, text_chunks, unused, written
from trellis.llm.kernels import U, mix, pair, shingle_ids, word_ids

SKETCH_BITS = 16
#: Points of a region that one task joins; larger regions are split into cells.
REGION = 1024
#: Cells may hold this many times a region's points; a region beyond it is joined
#: by pairs of blocks of ``BLOCK`` points.
SPREAD = 2.0
BLOCK = 4 * REGION
#: Pivots that a large region chooses at most.
PIVOTS = 16
CLASSES = 256


def sets_of(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, joined, and where each set ends."""
    words, start, end = word_ids(buf)
    doc = np.searchsorted(off, start, "right") - 1
    if len(words) and (np.searchsorted(off, end, "left") - 1 > doc).any():
        raise AssertionError("a word crosses texts")
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    all_ = shingle_ids(words, n)
    keep = np.flatnonzero(doc[: len(all_)] == doc[n - 1 :][: len(all_)]) if len(all_) else np.empty(0, np.int64)
    ids, owner = all_[keep], doc[keep]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), U)
        for k, d in enumerate(short):
            x = words[first[d] : first[d] + 1].copy()
            for j in range(1, count[d]):
                x = pair(x, words[first[d] + j : first[d] + j + 1])
            extra[k] = pair(x, np.array([count[d]], U))[0]  # unlike a longer text's shingles
        ids, owner = np.concatenate((ids, extra)), np.concatenate((owner, short))
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    ids, owner = ids[new], owner[new]
    return ids, np.cumsum(np.bincount(owner, minlength=len(off) - 1))


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space between them, so that no word crosses."""
    n = len(off) - 1
    out = np.full(len(buf) + n, 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(off))] = buf
    return out, off + np.arange(n + 1)


def point_ids(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Identifier of each set, -1 for the empty one; from order-free sums."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(ids * U(0x9E3779B97F4A7C15))))
    more = np.concatenate((np.zeros(1, U), np.cumsum(mix(ids.copy()))))
    begin = np.concatenate(([0], ends[:-1]))
    out = pair(sums[ends] - sums[begin], more[ends] - more[begin] + (ends - begin).astype(U)) >> U(1)
    out = out.view(np.int64)
    out[ends == begin] = -1
    return out


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("point", pa.int64()), ("size", pa.int64()), ("sketch", pa.bool_()), ("vector", pa.binary())])


def vectors(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The number of shingles of each set in each class, at most 255."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    count = np.bincount(owner * CLASSES + (ids & U(CLASSES - 1)).view(np.int64), minlength=len(ends) * CLASSES)
    data = np.minimum(count, 255).astype(np.uint8).tobytes()
    return [data[i : i + CLASSES] for i in range(0, len(data), CLASSES)]


def _sets(n: int, bits: int):
    """Rows of documents; after them, rows of the sketch: class and its count, doc_id null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for a, b, buf, off in text_chunks(batch):
                ids, ends = sets_of(*spaced(buf, off), n)
                sketch += np.bincount((ids >> U(64 - bits)).view(np.int64), minlength=1 << bits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(point_ids(ids, ends)), pa.array(np.diff(ends, prepend=0)), pa.array(np.zeros(b - a, np.bool_)), pa.array(vectors(ids, ends), pa.binary())], schema=_SKETCHED)
        at = np.flatnonzero(sketch)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int64)), pa.array(at), pa.array(sketch[at]), pa.array(np.ones(len(at), np.bool_)), pa.nulls(len(at), pa.binary())], schema=_SKETCHED)

    return run


def needed(size: int, threshold: tuple[int, int]) -> int:
    """Shingles that a set of this size must have in common with a linked one."""
    a, b = threshold
    return -(-a * size // b)


_PREFIX = pa.schema([("shingle", pa.int64()), ("point", pa.int64())])


def _prefixes(n: int, bits: int, threshold: tuple[int, int], sketch):
    """The rarest shingles of each set, once for each set of a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for _, _, buf, off in text_chunks(batch):
                ids, ends = sets_of(*spaced(buf, off), n)
                points = point_ids(ids, ends)
                _, once = np.unique(points, return_index=True)
                size = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(ends)), size)
                order = np.lexsort((ids, counts[(ids >> U(64 - bits)).view(np.int64)], owner))
                rank = np.arange(len(ids)) - np.repeat(ends - size, size)
                length = size - -(-threshold[0] * size // threshold[1]) + 1
                take = np.zeros(len(ends), bool)
                take[once] = True
                use = (rank < length[owner]) & take[owner]
                yield pa.RecordBatch.from_arrays([pa.array(ids[order][use].view(np.int64)), pa.array(points[owner][use])], schema=_PREFIX)

    return run


_MEMBERS = pa.schema([("pivot", pa.int64()), ("point", pa.int64())])


def _pivots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams prefix rows sorted by shingle, then point: the first point of a
    shingle is the pivot of the others."""
    last = pivot = None
    for batch in batches:
        shingle, point = batch.column("shingle").to_numpy(), batch.column("point").to_numpy()
        if not len(shingle):
            continue
        head = np.ones(len(shingle), bool)
        head[1:] = shingle[1:] != shingle[:-1]
        first = np.where(head, np.arange(len(shingle)), 0)
        own = point[np.maximum.accumulate(first)]
        if shingle[0] == last:
            own[: int(np.searchsorted(np.cumsum(head), 2))] = pivot
        last, pivot = shingle[-1], own[-1]
        both = np.unique(np.stack((own, point))[:, own != point], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_MEMBERS)


def parts(size: np.ndarray, vector: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """A label for each point: equal where a chain of possible links connects two."""
    a, b = threshold
    m = len(size)
    label = np.arange(m)
    can = np.zeros((m, m), bool)
    for i in range(m - 1):
        total = size[i] + size[i + 1 :]
        # |x ^ y| of linked sets is at most this; vectors differ by no more.
        most = total - 2 * -(-a * total // (a + b))
        can[i, i + 1 :] = np.abs(vector[i + 1 :] - vector[i]).sum(axis=1) <= most
    can |= can.T
    while True:
        least = np.minimum(label, np.where(can, label, m).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _possible(threshold: tuple[int, int], region: int):
    """Streams the points of each region with their vectors, and leaves those
    that may link, under the least point of their part.  A region too large
    for one task passes as it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, sizes, data = None, [], [], []
        large = False
        out: tuple[list[int], list[int]] = ([], [])

        def settle() -> None:
            label = parts(np.array(sizes), np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1).astype(np.int16), threshold)
            for k in np.flatnonzero(np.bincount(label) > 1):
                own = np.flatnonzero(label == k)
                least = min(points[i] for i in own)
                for i in own:
                    if points[i] != least:
                        out[0].append(least)
                        out[1].append(points[i])

        for batch in batches:
            vector = batch.column("vector")
            for i, (p, point, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pivot", "point", "size")), strict=True)):
                if p != now:
                    if len(points) > 1 and not large:
                        settle()
                    now, points, sizes, data, large = p, [], [], [], False
                if not large:
                    points.append(point)
                    sizes.append(size)
                    data.append(vector[i].as_py())
                    if len(points) > region:
                        large = True
                        out[0].extend([now] * len(points))
                        out[1].extend(points)
                        points = []
                else:
                    out[0].append(now)
                    out[1].append(point)
            if len(out[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_MEMBERS)
                out = ([], [])
        if len(points) > 1 and not large:
            settle()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_MEMBERS)

    return run


_CELLS = pa.schema([("cell", pa.string()), ("point", pa.int64()), ("copies", pa.int64()), ("lesser", pa.binary()), ("trail", pa.binary()), ("block", pa.int32()), ("packed", pa.binary())])
CELLS = "cell string, point long, copies long, lesser binary, trail binary, block int, packed binary"
_TEXTS = pa.schema([("point", pa.int64()), ("kind", pa.int32()), ("pivot", pa.int64()), ("use", pa.bool_()), ("copies", pa.int64()), ("packed", pa.binary())])
TEXTS = "point long, kind int, pivot long, use boolean, copies long, packed binary"


def _texts(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for _, b, buf, off in text_chunks(batch):
                ids, ends = sets_of(*spaced(buf, off), n)
                points, once = np.unique(point_ids(ids, ends), return_index=True)
                keep = points >= 0
                points, once = points[keep], once[keep]
                data = buf.tobytes()
                zero = pa.array(np.zeros(len(points), np.int64))
                packed = pa.array([pack.compress(data[off[i] : off[i + 1]]) for i in once], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(points), zero.cast(pa.int32()), zero, pa.array(np.zeros(len(points), np.bool_)), zero, packed], schema=_TEXTS)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams each point's text (kind 0), then its regions by pivot: a row for
    each region in use, with the lesser pivots of the point."""
    now, text = None, None
    before: list[int] = []
    rows: list[tuple] = []
    for batch in batches:
        packed = batch.column("packed")
        for i, (point, kind, pivot, use, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("point", "kind", "pivot", "use", "copies")), strict=True)):
            if kind == 0:
                if point != now:
                    now, text, before = point, packed[i].as_py(), []
                continue
            if use:
                rows.append((str(pivot), point, copies, np.array(before, np.int64).tobytes(), b"", 0, text))
            before.append(pivot)
            if len(rows) >= 4096:
                yield _rows(rows, _CELLS)
                rows = []
    if rows:
        yield _rows(rows, _CELLS)


_ASSIGNED = pa.schema([("cell", pa.string()), ("point", pa.int64()), ("nearest", pa.int64()), ("child", pa.int64())])


def unpacked(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    data = [unpack.decompress(t) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, ends = sets_of(*spaced(np.frombuffer(b"".join(data), np.uint8), off), n)
    return np.split(ids, ends[:-1])


def cells_of(sets: list[np.ndarray], points: list[int], pivots: list[int], own: list[np.ndarray], r: float) -> Iterator[tuple[int, int, int]]:
    """(point, nearest pivot, cell) of each point: its Voronoi cell, and those of
    lesser pivots whose window reaches it.  ``pivots`` ascend."""
    ids = np.unique(np.concatenate(own))
    has = np.zeros((len(pivots), len(ids)), bool)
    for k, s in enumerate(own):
        has[k, np.searchsorted(ids, s)] = True
    size = np.array([len(s) for s in own])
    for point, s in zip(points, sets, strict=True):
        at = np.searchsorted(ids, s)
        at[at == len(ids)] = 0
        common = has[:, at[ids[at] == s]].sum(axis=1)
        distance = 1 - common / (size + len(s) - common)
        k = int(distance.argmin())
        yield point, pivots[k], pivots[k]
        for j in np.flatnonzero(distance[:k] <= distance[k] + 2 * r + 1e-9):
            yield point, pivots[k], pivots[j]


def _assign(n: int, threshold: tuple[int, int]):
    """Streams, for a part of a region, its pivots (kind 0) and then its points."""
    r = 1 - threshold[0] / threshold[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots, own, points, texts = None, [], [], [], []

        def settle() -> pa.RecordBatch:
            nonlocal own, points, texts
            if len(own) < len(pivots):
                own = unpacked(own_texts, n)
            rows = [(now[0], *x) for x in cells_of(unpacked(texts, n), points, pivots, own, r)]
            points, texts = [], []
            return _rows(rows, _ASSIGNED)

        own_texts: list[bytes] = []
        for batch in batches:
            packed = batch.column("packed")
            for i, (cell, part, kind, point) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "kind", "point")), strict=True)):
                if (cell, part) != now:
                    if points:
                        yield settle()
                    now, pivots, own, own_texts = (cell, part), [], [], []
                if kind == 0:
                    pivots.append(point)
                    own_texts.append(packed[i].as_py())
                    continue
                points.append(point)
                texts.append(packed[i].as_py())
                if len(points) >= 1024:
                    yield settle()
        if points:
            yield settle()

    return run


def _split(rows: DataFrame, n: int, threshold: tuple[int, int], region: int) -> Iterator[DataFrame]:
    """Tables of rows of cells that one task joins, from those of large regions."""
    r_rows, block = written(rows, "regions"), 4 * region
    while True:
        sizes = written(r_rows.groupBy("cell").agg(F.count("*").alias("points")), "region-sizes")
        yield r_rows.join(sizes.where(F.col("points") <= region), "cell", "left_semi")
        large = sizes.where(F.col("points") > region)
        if large.isEmpty():
            return
        chance = F.least(F.lit(PIVOTS), F.ceil(F.col("points") / region) + 1) / F.col("points")
        dealt = r_rows.join(large, "cell").select("cell", "point", "packed", "points", F.xxhash64("point", "cell").alias("draw"))
        low = written(dealt.groupBy("cell").agg(F.min("draw").alias("low")), "region-low")
        parts = F.ceil(F.col("points") / region).cast("int")
        chosen = dealt.join(low, "cell").where((F.col("draw") == F.col("low")) | (F.col("draw") / F.lit(2.0**63) < 2 * chance - 1))
        pivots = chosen.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), "point", "packed")
        members = dealt.select("cell", F.pmod(F.xxhash64("draw"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "point", "packed")
        streams = pivots.unionByName(members).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "point")
        assigned = written(streams.mapInArrow(_assign(n, threshold), "cell string, point long, nearest long, child long"), "region-cells")
        children = assigned.groupBy("cell", "child").agg(F.count("*").alias("held")).groupBy("cell").agg(F.sum("held").alias("held"), F.max("held").alias("most"))
        split = written(large.join(children, "cell").select("cell", "points", ((F.col("held") <= SPREAD * F.col("points")) & (F.col("most") < 0.9 * F.col("points"))).alias("ok")), "region-splits")
        # Pairs of blocks: a point goes to each pair that its block is in.
        many = F.ceil(F.col("points") / block).cast("int")
        own = F.col("block")
        pairs = r_rows.drop("block").join(split.where("not ok"), "cell").withColumn("block", F.pmod(F.xxhash64("point"), many).cast("int"))
        pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        yield pairs.withColumn("cell", F.concat_ws("|", "cell", F.least(own, "other"), F.greatest(own, "other"))).select(*_CELLS.names)
        if split.where("ok").isEmpty():
            return
        keys = assigned.join(split.where("ok").select("cell"), "cell", "left_semi")
        down = keys.join(r_rows, ["cell", "point"]).withColumns({"cell": F.concat_ws("/", "cell", "child"), "trail": F.concat("trail", F.unhex(F.lpad(F.hex("nearest"), 16, "0")))})
        r_rows = written(down.select(*_CELLS.names), "regions")


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    return threshold[1] * common >= threshold[0] * (a + b - common)


class _Sparse:
    """Sets as rows of a matrix; elements of one set alone get no column."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        m = len(sets)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        use = (count >= 2)[column] if len(column) else np.empty(0, bool)
        self.column = (np.cumsum(count >= 2) - 1)[column[use]]
        self.row = row[use]
        self.begin = np.searchsorted(self.row, np.arange(m + 1))
        self.width = int((count >= 2).sum())

    def of(self, x: int) -> np.ndarray:
        return self.column[self.begin[x] : self.begin[x + 1]]

    def columns(self, rows: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.of(x) for x in rows]))

    def dense(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        for k, x in enumerate(rows if len(columns) else ()):
            c = self.of(x)
            at = np.searchsorted(columns, c)
            at[at == len(columns)] = 0
            out[k, at[columns[at] == c]] = 1
        return out


def join_region(sets: list[np.ndarray], pivot: int, threshold: tuple[int, int], block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both ends of every link between the points of a region, each link once,
    in batches of at most ``block`` by ``block``."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    matrix = _Sparse(sets)
    mark = np.zeros(matrix.width, bool)
    mark[matrix.of(pivot)] = True
    common = np.bincount(matrix.row, mark[matrix.column], minlength=m).astype(np.int64) if matrix.width else np.zeros(m, np.int64)
    distance = 1 - common / (size + size[pivot] - common)
    distance[pivot] = 0
    order = np.argsort(distance, kind="stable")
    r = 1 - threshold[0] / threshold[1] + 1e-9
    for a in range(0, m, block):
        left = order[a : a + block]
        columns = matrix.columns(left)
        if not len(columns):
            continue
        one = matrix.dense(left, columns)
        for b in range(a, m, block):
            right = order[b : b + block]
            if distance[right[0]] - distance[left[-1]] > r:
                break  # and so are all further blocks
            both = (one @ (one if a == b else matrix.dense(right, columns)).T).astype(np.int64)
            i, j = np.nonzero(linked(both, size[left][:, None], size[right][None, :], threshold))
            once = i < j if a == b else slice(None)
            if len(i):
                yield left[i[once]], right[j[once]]


class Forest:
    """Joins of disjoint sets; ``add`` keeps the pairs that join two."""

    def __init__(self, m: int) -> None:
        self.parent = np.arange(m)
        self.edges: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while (up := self.parent[self.parent]).tolist() != self.parent.tolist():
            self.parent = up
        return self.parent

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            top = self.roots()
            apart = np.flatnonzero(top[i] != top[j])
            if not len(apart):
                return
            # One pair for each greater root: no cycle can come of them.
            high, low = np.maximum(top[i[apart]], top[j[apart]]), np.minimum(top[i[apart]], top[j[apart]])
            _, first = np.unique(high, return_index=True)
            self.parent[high[first]] = low[first]
            self.edges += zip(i[apart[first]].tolist(), j[apart[first]].tolist(), strict=True)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
LINKS = "a long, b long, n long"


def _join(n: int, threshold: tuple[int, int], pairs: bool):
    """Rows (a, b, null) of a spanning forest and (a, null, number of links), or
    with ``pairs`` (a, b, null) of every link that counts in this cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        rows: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            m = len(rows)
            points = np.array([r[0] for r in rows], np.int64)
            copies = np.array([r[1] for r in rows], np.int64)
            path, *of = now.split("|")
            cells = path.split("/")
            trails = np.array([np.frombuffer(r[3], ">i8") for r in rows], np.int64).reshape(m, len(cells) - 1)
            blocks = np.array([r[4] for r in rows])
            lesser = _Sparse([np.frombuffer(r[2], np.int64) for r in rows])
            every = np.arange(lesser.width)
            at = np.flatnonzero(points == int(cells[-1]))
            forest, count = Forest(m), np.zeros(m, np.int64)
            for i, j in join_region(unpacked([r[5] for r in rows], n), int(at[0]) if len(at) else 0, threshold):
                forest.add(i, j)
                counts = np.ones(len(i), bool)
                for level, cell in enumerate(cells[1:]):
                    counts &= np.minimum(trails[i, level], trails[j, level]) == int(cell)
                if of:
                    counts &= (np.minimum(blocks[i], blocks[j]) == int(of[0])) & (np.maximum(blocks[i], blocks[j]) == int(of[1]))
                if lesser.width:  # those that share a lesser pivot count there
                    x, a = np.unique(i, return_inverse=True)
                    y, b = np.unique(j, return_inverse=True)
                    counts &= (lesser.dense(x, every) @ lesser.dense(y, every).T)[a, b] == 0
                i, j = i[counts], j[counts]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(points[i], points[j])), pa.array(np.maximum(points[i], points[j])), pa.nulls(len(i), pa.int64())], schema=_LINKS)
                else:
                    count += np.bincount(i, copies[j], minlength=m).astype(np.int64) + np.bincount(j, copies[i], minlength=m).astype(np.int64)
            if not pairs:
                a, b = (points[np.array(x, np.int64)] for x in (zip(*forest.edges, strict=True) if forest.edges else ([], [])))
                some = np.flatnonzero(count)
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], schema=_LINKS)
                yield pa.RecordBatch.from_arrays([pa.array(points[some]), none, pa.array(count[some])], schema=_LINKS)

        for batch in batches:
            packed = batch.column("packed")
            for i, (cell, *r) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("cell", "point", "copies", "lesser", "trail", "block")), strict=True)):
                if cell != now:
                    if len(rows) > 1:
                        yield from settle()
                    now, rows = cell, []
                rows.append((*r, packed[i].as_py()))
        if len(rows) > 1:
            yield from settle()

    return run


def components(links: DataFrame) -> DataFrame:
    """(point, label) of each linked point; ``label`` is its component's smallest.
    ``links`` is a table of distinct pairs, ``a`` below ``b``.

    Large-star, small-star: each round points every node at the smallest of its
    neighbourhood, until the edges are stars.  Edges only ever decrease in
    number beyond the first round; each round is a table in the shared folder.
    """
    edges = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if edges.isEmpty():
        return edges.select(F.col("u").alias("point"), F.col("v").alias("label"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v")
        edges = written(small.distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("point"), F.col("v").alias("label"))
        before = state


def _linked(docs: DataFrame, n: int, threshold: tuple[int, int], region: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, point, size) of each document, (point, copies) of those with
    copies, and what ``_join`` says of all cells."""
    spark = docs.sparkSession
    texts = only(docs)
    scan = written(texts.mapInArrow(_sets(n, SKETCH_BITS), "doc_id long, point long, size long, sketch boolean, vector binary"), "sets")
    points = scan.where("not sketch").select("doc_id", "point", "size")
    copies = written(points.where("point >= 0").groupBy("point").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for k, c in scan.where("sketch").groupBy("point").agg(F.sum("size")).collect():  # one row for each class at most
        counts[k] = c
    sketch = spark.sparkContext.broadcast(counts)
    prefixes = texts.select("text").mapInArrow(_prefixes(n, SKETCH_BITS, threshold, sketch), "shingle long, point long")
    members = prefixes.repartition("shingle").sortWithinPartitions("shingle", "point").mapInArrow(_pivots, "pivot long, point long").distinct()
    members = written(members, "members")
    known = scan.where("not sketch").groupBy("point").agg(F.min("size").alias("size"), F.min("vector").alias("vector"))
    near = members.unionByName(members.select("pivot", F.col("pivot").alias("point")).distinct()).join(known, "point").select("pivot", "point", "size", "vector")
    possible = near.repartition("pivot").sortWithinPartitions("pivot", "point").mapInArrow(_possible(threshold, region), "pivot long, point long")
    members = written(possible.where("pivot != point").distinct(), "members")
    regions = written(members.groupBy("pivot").agg((F.count("*") + 1).alias("points")), "region-sizes")
    placed = members.join(regions, "pivot").select("point", "pivot", "points").unionByName(regions.select(F.col("pivot").alias("point"), "pivot", "points"))
    placed = written(placed.join(copies, "point", "left").select("point", "pivot", "points", F.coalesce("copies", F.lit(1)).alias("copies")), "placed")

    def rows(marks: DataFrame, use) -> DataFrame:
        marks = marks.select("point", F.lit(1).alias("kind"), "pivot", use.alias("use"), "copies", F.lit(None).cast("binary").alias("packed"))
        both = texts.select("text").mapInArrow(_texts(n), TEXTS).unionByName(marks)
        return both.repartition("point").sortWithinPartitions("point", "kind", "pivot").mapInArrow(_place, CELLS)

    small = F.col("points") <= region
    cells = rows(placed, small)
    if not regions.where(~small).isEmpty():
        inside = placed.join(placed.where(~small).select("point").distinct(), "point", "left_semi")
        for part in _split(rows(inside, ~small), n, threshold, region):
            cells = cells.unionByName(part)
    found = cells.repartition("cell").sortWithinPartitions("cell", "point").mapInArrow(_join(n, threshold, pairs), LINKS)
    return points, copies, written(found, "links")


def point_links(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100), region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, point, size) of each document, and (a, b) of every link between
    two points, each once, ``a`` below ``b``; ``threshold`` is a fraction."""
    points, _, links = _linked(docs, n, threshold, region, True)
    return points, links.select("a", "b")


def similar_components(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100), region: int = REGION, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document, and with
    ``count_links`` n_links, the number of other documents that it links with."""
    points, copies, links = _linked(docs, n, threshold, region, False)
    labels = components(written(links.where("b is not null").select("a", "b").distinct(), "forest"))
    extra = ["n_links"] if count_links else []
    if count_links:
        to_others = links.where("b is null").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
        n_links = F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
        labels = to_others.join(copies, "point", "full").select("point", n_links.alias("n_links")).join(labels, "point", "left")
    labelled = points.join(labels, "point", "left").select("doc_id", "size", F.coalesce("label", "point").alias("label"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in extra))
    # A table of its own: a large component's rows can then be split between tasks.
    least = written(labelled.where("label >= 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    return labelled.join(least, "label", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("label") >= 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *extra)


def one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents without all but the smallest doc_id of each component, all
    columns kept.  Where doc_ids are null or repeat, a hash of id and text
    stands for a row, and equal rows count as one."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = named.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    key, other = unused(docs, "row_key", "other_key")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long") if plain else F.xxhash64("doc_id", "text"))
    found = similar_components(keyed.select(F.col(key).alias("doc_id"), "text"), n, threshold)
    others = found.where("doc_id != component_id").select(F.col("doc_id").alias(other)).distinct()
    kept = keyed.join(others, F.col(key) == F.col(other), "left_anti")
    return (kept if plain else kept.dropDuplicates([key])).select(*docs.columns)

"""Shortest, cheapest and all simple paths."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trellis.operators.build import Part
from trellis.operators.traverse import bfs
from trellis.sources.storage import Levels, local

#: Nodes that one end of a weighted search may have on the driver.
SMALL = 100_000
#: Nodes of one end that are expanded together if so many are open: a round has a cost of its own.
BATCH = 1_000
MAX_COST = 2**63 - 1
ENTRY = "node_table string, node_id string, cost long, open boolean, via_table string, via_id string, type string, weight long"


def shortest_path(roots: DataFrame, steps: DataFrame, target: tuple[str, str], max_depth: int) -> list[tuple[str, str, str | None]]:
    """(table, id, label of the edge to it) of a path with fewest edges; empty if there is none."""
    hit = (F.col("node_table") == target[0]) & (F.col("node_id") == target[1])
    reached, _ = bfs(roots, steps, max_depth, None, None, lambda f: not f.where(hit).isEmpty(), 1)
    found = reached.where(hit).select("path", "edge_path").head()
    if found is None:
        return []
    return [(p.table, p.id, e) for p, e in zip(found.path, [None, *found.edge_path], strict=True)]


def weighted_steps(steps: DataFrame, parts: list[Part] | None) -> tuple[list[tuple], int]:
    """Edges as (src_label, dst_label, rows), one for each mapping and direction, and the
    mean weight; without ``parts`` all are in ``steps``, whose rows have their labels."""
    if parts is None:
        edges = [(None, None, steps.select("src_label", F.col("src_id").alias("src_key"), "dst_label", F.col("dst_id").alias("dst_key"), "type", "weight"))]
    else:
        edges = [(p.src_label, p.dst_label, p.rows) for p in parts]
        edges += [(p.dst_label, p.src_label, p.rows.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"), "type", "weight")) for p in parts if p.bidirectional]
    # Both directions of a part have the same weights.
    weights = [rows.agg(F.sum("weight").alias("s"), F.count("*").alias("n")).head() for _, _, rows in edges[: len(parts or edges)]]
    total, n = sum(w.s or 0 for w in weights), sum(w.n for w in weights)
    return edges, int(total / n if n else 1) + 1


def _hops(band: DataFrame, spans: dict[str, list[str]] | None, edges: list[tuple], ahead: bool) -> DataFrame | None:
    """The least entry of each node one step from a band, against the edges where not
    ``ahead``.  ``spans`` has the ids of a small band by table; only their range is read."""
    near, far = ("src", "dst") if ahead else ("dst", "src")
    out = None
    for src, dst, rows in edges:
        here, there = (src, dst) if ahead else (dst, src)
        if spans is not None and here is not None and here not in spans:
            continue
        kind = rows.schema[f"{near}_key"].dataType
        own = band if here is None else band.where(F.col("node_table") == here)
        own = own.select(F.col("node_table").alias("via_table"), F.col("node_id").alias("via_id"), F.col("node_id").cast(kind).alias("key"), "cost")
        if spans is not None:
            own = F.broadcast(own)
            if here is not None and isinstance(kind, LongType):
                ids = [int(i) for i in spans[here]]
                rows = rows.where(F.col(f"{near}_key").between(min(ids), max(ids)))
        same = rows[f"{near}_key"] == own["key"]
        step = rows.join(own, same if here is not None else same & (rows[f"{near}_label"] == own["via_table"])).select(
            (F.col(f"{far}_label") if there is None else F.lit(there)).alias("node_table"), F.col(f"{far}_key").cast("string").alias("node_id"),
            F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.lit(True).alias("open"), "via_table", "via_id", "type", "weight").alias("x"),
        )
        out = step if out is None else out.unionByName(step)
    return None if out is None else out.groupBy("node_table", "node_id").agg(F.min("x").alias("x")).select("node_table", "node_id", "x.*")


class Side:
    """Nodes reached from one end: each with its least cost so far, whether it is
    still to be expanded, and the node and edge it came by.

    Up to ``SMALL`` of them are entries on the driver, more are a table."""

    def __init__(self, spark: SparkSession, end: tuple[str, str], kind: str) -> None:
        self.spark, self.levels = spark, Levels(kind, 0)
        self.known: dict[tuple[str, str], tuple] | None = {end: (0, True, None, None, None, None)}
        self.best: DataFrame | None = None
        self.low, self.waiting = 0, 1
        #: The cost up to which the cheapest ``BATCH`` open nodes reach.
        self.batch = 0

    def _table(self, nodes: list[tuple[str, str]]) -> DataFrame:
        values = zip(*((*n, *self.known[n]) for n in nodes), strict=True)
        kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in ENTRY.split(", ")]
        return self.spark.createDataFrame(pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in ENTRY.split(", ")]), ENTRY)

    def table(self) -> DataFrame:
        return self._table(list(self.known)) if self.best is None else self.best

    def expand(self, edges: list[tuple], ahead: bool, top: float, bound: float) -> None:
        """Expands the open nodes of costs up to ``top``; entries of ``bound`` and above are of no use."""
        less = F.col("cost") < (bound if bound < math.inf else MAX_COST)
        if self.best is None:
            band = [n for n, x in self.known.items() if x[1] and x[0] <= top]
            spans: dict[str, list[str]] = {}
            for t, i in band:
                spans.setdefault(t, []).append(i)
            hop = _hops(self._table(band), spans, edges, ahead)
            self.known |= {n: (self.known[n][0], False, *self.known[n][2:]) for n in band}
            if hop is None:
                return self._count()
            hop = hop.where(less).persist()
            try:
                found = local(hop, SMALL)
                if found is not None:
                    for t, i, *x in zip(*(c.to_pylist() for c in found[1].columns), strict=True):
                        if (t, i) not in self.known or x[0] < self.known[t, i][0]:
                            self.known[t, i] = tuple(x)
                if found is None or len(self.known) > SMALL:
                    self._merge(self.table(), hop)
            finally:
                hop.unpersist()
        else:
            band = F.col("open") & (F.col("cost") <= top)
            hop = _hops(self.best.where(band), None, edges, ahead).where(less)
            self._merge(self.best.withColumn("open", F.col("open") & ~band), hop)
        return self._count()

    def _merge(self, old: DataFrame, hop: DataFrame) -> None:
        # Of a node's old entry, closed if it was in the band, and its new ones, the cheapest stays.
        row = F.struct("cost", "open", "via_table", "via_id", "type", "weight")
        merged = old.unionByName(hop).groupBy("node_table", "node_id").agg(F.min(row).alias("x")).select("node_table", "node_id", "x.*")
        self.best, _ = self.levels.keep(merged)
        self.known, self.batch = None, 0

    def _count(self) -> None:
        if self.best is None:
            costs = sorted(x[0] for x in self.known.values() if x[1])
            self.low, self.waiting = (costs[0] if costs else None), len(costs)
            self.batch = costs[min(BATCH, len(costs)) - 1] if costs else 0
        else:
            self.low, self.waiting = self.best.agg(F.min(F.when(F.col("open"), F.col("cost"))), F.count_if("open")).head()

    def chain(self, node: tuple[str, str]) -> list[tuple]:
        """(table, id, label and weight of the edge to the next), from a node to the end."""
        out = []
        while node[0] is not None:
            x = self.known[node] if self.best is None else self.best.where((F.col("node_table") == node[0]) & (F.col("node_id") == node[1])).head()[2:]
            out.append((*node, *x[4:]))
            node = x[2:4]
        return out


def _meeting(a: Side, b: Side) -> tuple[int, str, str] | None:
    """The least cost of a path through a node that both sides have reached, and the node."""
    if a.best is None and b.best is None:
        return min(((x[0] + b.known[n][0], *n) for n, x in a.known.items() if n in b.known), default=None)
    keys = ["node_table", "node_id"]
    both = a.table().select(*keys, "cost").join(b.table().select(*keys, F.col("cost").alias("rest")), keys)
    return both.agg(F.min(F.struct(F.col("cost") + F.col("rest"), *keys)).alias("x")).head().x


def cheapest_path(source: tuple[str, str], target: tuple[str, str], edges: list[tuple], width: int) -> list[tuple[str, str, str | None, int]]:
    """(table, id, edge label, edge weight) of a path of least total weight.

    It is sought from both ends.  The end with fewer open nodes expands those of
    its least costs, in a band about as wide as a mean edge or of ``BATCH`` nodes; a
    node that improves opens again.  Nodes below an end's least open cost have their true cost, so no
    path is cheaper than the best one through a node that both ends have reached,
    once the least open costs of the ends sum up to it."""
    if not edges:
        return []
    spark = edges[0][2].sparkSession
    a, b = Side(spark, source, "cheapest"), Side(spark, target, "cheapest-back")
    best = _meeting(a, b)
    while a.low is not None and b.low is not None and (best is None or a.low + b.low < best[0]):
        here, other = (a, b) if a.waiting <= b.waiting else (b, a)
        bound = math.inf if best is None else best[0]
        # Paths that go on from a node of a higher cost are no cheaper than the bound.
        here.expand(edges, here is a, min(max(here.low + width, here.batch), bound - other.low - 1), bound)
        best = _meeting(a, b)
    if best is None:
        return []
    meet = tuple(best[1:])
    first, last = a.chain(meet)[::-1], b.chain(meet)
    steps = [*[x[2:] for x in first[1:]], *[x[2:] for x in last[:-1]]]
    return [(*node[:2], *step) for node, step in zip([*first, *last[1:]], [(None, 0), *steps], strict=True)]


def simple_paths(roots: DataFrame, steps: DataFrame, min_depth: int, max_depth: int, limit: int | None = None) -> DataFrame:
    """(root_table, root_id, path, edge_path) of node-distinct paths, each node
    sequence once, grown by one join a step."""
    levels = Levels("paths")
    paths, n = levels.keep(roots.select(F.col("table").alias("root_table"), F.col("id").alias("root_id"), F.array(F.struct("table", "id")).alias("path"), F.array().cast("array<string>").alias("edge_path")))
    out, total = (paths if min_depth == 0 else paths.where("false")), n if min_depth == 0 else 0
    last = F.element_at("path", -1)
    for depth in range(1, max_depth + 1):
        if not n or (limit is not None and total > limit):
            break
        step = F.struct(F.col("dst_label").alias("table"), F.col("dst_id").alias("id"))
        grown = paths.join(steps, (last["table"] == F.col("src_label")) & (last["id"] == F.col("src_id"))).where(~F.array_contains("path", step))
        grown = grown.select("root_table", "root_id", F.concat("path", F.array(step)).alias("path"), F.concat("edge_path", F.array("type")).alias("edge_path"))
        paths, n = levels.keep(grown.groupBy("root_table", "root_id", "path").agg(F.min("edge_path").alias("edge_path")))
        if depth >= min_depth:
            out, total = out.unionByName(paths), total + n
    return out

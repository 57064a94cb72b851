"""Bounded traversal from many roots, level by level.

A level is one join of the frontier with the edges.  The first path to a node
is the least one by (table ordinal, id) of its nodes, which is the order in
which a queue would find them, so a grouped minimum with partial aggregation
replaces any global ranking.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.errors import GraphError
from trellis.sources.storage import Levels

DIRECTIONS = ("any", "out", "in", "both")
STEP = "struct<ord:int,table:string,id:string>"


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (src, dst, type, weight) in the direction of travel; ``any`` is that of the stored rows."""
    forward = edges.select("src_label", "src_id", "dst_label", "dst_id", "type", "weight")
    back = edges.select(F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), "type", "weight")
    if direction in ("any", "out"):
        return forward
    if direction == "in":
        return back
    if direction == "both":
        return forward.unionByName(back)
    raise GraphError("semantic", f"unknown direction {direction}")


def adjacency(edges: DataFrame, nodes: DataFrame, direction: str, types: list[str] | None, allowed: DataFrame | None, tenanted: list[str], tenant: str | None, ordinals: dict[str, int]) -> DataFrame:
    """Steps that a traversal may take: (src_label, src_id, dst_ord, dst_label, dst_id, type)."""
    steps = oriented(edges, direction)
    if types is not None:
        steps = steps.where(F.col("type").isin(types) if types else F.lit(False))
    targets = nodes.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"), F.col("ord").alias("dst_ord"), "tenant")
    if allowed is not None:
        targets = targets.join(allowed.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id")), ["dst_label", "dst_id"], "left_semi")
    filtered = allowed is not None or (tenant is not None and tenanted)
    if tenant is not None and tenanted:
        targets = targets.where(~F.col("dst_label").isin(tenanted) | (F.col("tenant") == tenant))
    if filtered:
        return steps.join(targets.select("dst_label", "dst_id", "dst_ord"), ["dst_label", "dst_id"])
    table = F.create_map(*[F.lit(x) for pair in ordinals.items() for x in pair])
    return steps.withColumn("dst_ord", table[F.col("dst_label")])


def bfs(roots: DataFrame, steps: DataFrame, max_depth: int, max_nodes: int | None, max_frontier: int | None, stop: Callable[[DataFrame], bool] | None = None, seeds: int | None = None) -> tuple[DataFrame, bool]:
    """Rows (root_table, root_id, node_table, node_id, depth, path, edge_path)
    and whether a limit cut it; ``roots`` has (ord, table, id).

    Only the neighbour is checked, so roots may fail every filter.  A limit
    of None is none.  ``seeds`` is the number of roots where they are a local
    table without repeats."""
    max_nodes, max_frontier = (math.inf if x is None else x for x in (max_nodes, max_frontier))
    keys = ["root_table", "root_id", "node_table", "node_id"]
    start = roots.select(
        F.col("table").alias("root_table"), F.col("id").alias("root_id"), F.col("table").alias("node_table"), F.col("id").alias("node_id"),
        F.lit(0).alias("depth"), F.array(F.struct("ord", "table", "id")).alias("path"), F.array().cast("array<string>").alias("edge_path"),
    )
    levels = Levels("bfs")
    frontier, n = (start, seeds) if seeds is not None else levels.keep(start.dropDuplicates(keys))
    reached, seen, roots_n, capped = frontier, n, n, False
    for depth in range(1, max_depth + 1):
        if not n or (stop is not None and stop(frontier)):
            break
        if seen >= max_nodes or n >= max_frontier:  # some root may be at a limit
            per_root = reached.groupBy("root_table", "root_id").agg(F.count("*").alias("seen"), F.count_if(F.col("depth") == depth - 1).alias("front"))
            full = per_root.where((F.col("seen") >= max_nodes) | (F.col("front") >= max_frontier)).select("root_table", "root_id")
            stuck = full.count()
            if stuck:
                capped = True
                frontier = frontier.join(full, ["root_table", "root_id"], "left_anti")
                if stuck == roots_n:
                    break
        hop = frontier.join(steps, (frontier["node_table"] == steps["src_label"]) & (frontier["node_id"] == steps["src_id"])).select(
            "root_table", "root_id", F.col("dst_label").alias("node_table"), F.col("dst_id").alias("node_id"),
            F.concat("path", F.array(F.struct(F.col("dst_ord").alias("ord"), F.col("dst_label").alias("table"), F.col("dst_id").alias("id")))).alias("path"),
            F.concat("edge_path", F.array("type")).alias("edge_path"),
        )
        fresh = hop.join(reached.select(*keys), keys, "left_anti")
        found = fresh.groupBy(*keys).agg(F.min(F.struct("path", "edge_path")).alias("first")).select(*keys, F.lit(depth).alias("depth"), "first.path", "first.edge_path")
        frontier, n = levels.keep(found)
        if seen + n > max_nodes:
            have = reached.groupBy("root_table", "root_id").agg(F.count("*").alias("seen"))
            order = Window.partitionBy("root_table", "root_id").orderBy("path")
            kept = frontier.withColumn("place", F.row_number().over(order)).join(have, ["root_table", "root_id"]).where(F.col("place") + F.col("seen") <= max_nodes)
            frontier, n = levels.keep(kept.select(*reached.columns))
        reached = reached.unionByName(frontier)
        seen += n
    if seen >= max_nodes:
        per_root = reached.groupBy("root_table", "root_id").count().where(F.col("count") >= max_nodes)
        capped = capped or not per_root.isEmpty()
    return reached, capped


def dfs(root: tuple[int, str, str], ball: DataFrame, steps: DataFrame, max_depth: int, max_nodes: int | None, max_frontier: int | None) -> tuple[list[tuple], bool]:
    """Depth-first order on the driver, over the steps inside a breadth-first
    ball: a node is marked, and its depth fixed, as it is pushed.  The ball is
    bounded by ``max_nodes``; None is no bound."""
    max_nodes, max_frontier = (math.inf if x is None else x for x in (max_nodes, max_frontier))
    inside = ball.select(F.col("node_table").alias("src_label"), F.col("node_id").alias("src_id"))
    target = ball.select(F.col("node_table").alias("dst_label"), F.col("node_id").alias("dst_id"))
    rows = steps.join(inside, ["src_label", "src_id"], "left_semi").join(target, ["dst_label", "dst_id"], "left_semi").select("src_label", "src_id", "dst_ord", "dst_label", "dst_id", "type").collect()
    near: dict[tuple[str, str], list[tuple]] = {}
    for r in rows:
        near.setdefault((r.src_label, r.src_id), []).append((r.dst_ord, r.dst_id, r.type, r.dst_label))
    for v in near.values():
        v.sort()
    first = (root[1], root[2])
    out, marked, capped = [], {first}, False
    stack = [(first, 0, [root], [])]
    while stack:
        here, depth, path, types = stack.pop()
        out.append((*here, depth, path, types))
        if depth >= max_depth:
            continue
        if len(marked) >= max_nodes or len(stack) >= max_frontier:
            capped = True
            break
        for o, i, t, label in reversed(near.get(here, [])):
            if (label, i) not in marked and len(marked) < max_nodes:
                marked.add((label, i))
                stack.append(((label, i), depth + 1, [*path, (o, label, i)], [*types, t]))
    out += [(*here, depth, path, types) for here, depth, path, types in reversed(stack)]
    return out, capped or len(marked) >= max_nodes


def unique_rows(rows: DataFrame, uniqueness: str, ordinals: dict[str, int]) -> DataFrame:
    """``node_global``: each node once, from the first root by table and id."""
    if uniqueness == "node_per_root":
        return rows
    if uniqueness != "node_global":
        raise GraphError("semantic", f"unknown uniqueness {uniqueness}")
    place = F.create_map(*[F.lit(x) for pair in ordinals.items() for x in pair])[F.col("root_table")]
    others = [c for c in rows.columns if c not in ("node_table", "node_id")]
    first = rows.groupBy("node_table", "node_id").agg(F.min(F.struct(place.alias("o"), F.col("root_id").alias("r"), *others)).alias("x"))
    return first.select(*(f"x.{c}" if c in others else c for c in rows.columns))

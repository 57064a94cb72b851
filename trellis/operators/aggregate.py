"""Sums, averages and counts over what a traversal reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.catalog import Catalog, Source, key_text
from trellis.errors import GraphError

FUNCTIONS = ("sum", "avg", "count")
SCOPES = ("returned_nodes", "chosen_parent_path", "all_possible_paths")


def specs(aggregations: object) -> list[tuple[str, str | None, str | None, str]]:
    """(function, table, column, alias) of each aggregation."""
    items = [aggregations] if isinstance(aggregations, dict) else list(aggregations or [])
    if not items:
        raise GraphError("semantic", "aggregate needs an aggregation")
    out = []
    for a in items:
        if extra := set(a) - {"function", "table", "column", "alias"}:
            raise GraphError("semantic", f"unknown keys {sorted(extra)}")
        function = str(a.get("function", "")).lower()
        if function not in FUNCTIONS:
            raise GraphError("semantic", f"unknown aggregate {function}")
        if function != "count" and not (a.get("table") and a.get("column")):
            raise GraphError("semantic", f"{function} needs a table and a column")
        out.append((function, a.get("table"), a.get("column"), a.get("alias") or f"{function}_{a.get('column') or 'all'}"))
    return out


def aggregated(nodes: DataFrame, wanted: list[tuple], catalog: Catalog, sources: dict[str, Source]) -> dict[str, float | int | None]:
    """The aggregates over (node_table, node_id) rows, one for each time a node
    counts.  Nodes are counted before values are looked up, so a node's row is
    read once; specs with one alias share an accumulator."""
    times = nodes.groupBy("node_table", "node_id").agg(F.count("*").alias("times")).persist()
    parts: dict[str, dict[str, float]] = {}
    kinds: dict[str, str] = {}
    for table in {t for _, t, _, _ in wanted}:
        here = [w for w in wanted if w[1] == table]
        if table is None:
            values = times
        else:
            df = sources[catalog.table(table).name].df
            columns = {c for _, _, c, _ in here if c}
            for c in columns:
                if c not in df.columns:
                    raise GraphError("semantic", f"table {table} has no column {c}")
            values = times.where(F.col("node_table") == table).join(df.select(key_text(catalog.tables[table].id_columns).alias("node_id"), *(F.col(c).cast("double").alias(f"v_{c}") if any(w[2] == c and w[0] != "count" for w in here) else F.col(c).alias(f"v_{c}") for c in columns)), "node_id")
        aggs = []
        for i, (function, _, column, _) in enumerate(here):
            present = F.lit(True) if column is None else F.col(f"v_{column}").isNotNull()
            aggs.append(F.sum(F.when(present, F.col("times")).otherwise(0)).alias(f"n{i}"))
            aggs.append((F.sum(F.col(f"v_{column}") * F.col("times")) if function != "count" else F.lit(0.0)).alias(f"s{i}"))
        row = values.agg(*aggs).head()
        for i, (function, _, _, alias) in enumerate(here):
            if kinds.setdefault(alias, function) != function:
                raise GraphError("semantic", f"alias {alias} has two functions")
            acc = parts.setdefault(alias, {"n": 0, "s": 0.0})
            acc["n"] += row[f"n{i}"] or 0
            acc["s"] += row[f"s{i}"] or 0.0
    times.unpersist()
    return {alias: acc["n"] if kinds[alias] == "count" else acc["s"] if kinds[alias] == "sum" else (acc["s"] / acc["n"] if acc["n"] else None) for alias, acc in parts.items()}

"""Deriving nodes and edges from registered tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from trellis.catalog import Catalog, EdgeMapping, Source, key_text
from trellis.errors import GraphError

MAX_WEIGHT = 4294967295
NODE_SCHEMA = "label string, ord int, id string, tenant string"
EDGE_SCHEMA = "src_label string, src_id string, dst_label string, dst_id string, type string, weight bigint, reversed boolean, mapping_id int, source_key string"


@dataclass
class Part:
    """Edges of one mapping whose ends lie in one table each.

    ``rows`` has (src_key, dst_key, type, weight), each edge once; integral
    keys stay numbers, so that a few nodes meet them without a cast of each row."""

    src_label: str
    dst_label: str
    rows: DataFrame
    bidirectional: bool


@dataclass
class Graph:
    """Derived topology: one row for each node, one for each stored orientation of an edge.

    ``parts`` has the same edges by mapping if the table of every end is known."""

    nodes: DataFrame
    edges: DataFrame
    has_unidirectional: bool
    weighted: bool
    parts: list[Part] | None = None

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()


def node_rows(catalog: Catalog, sources: dict[str, Source]) -> DataFrame | None:
    out = None
    for name, table in sorted(catalog.tables.items()):
        df = sources[name].df
        tenant = F.col(table.tenant_column).cast("string") if table.tenant_column else F.lit(None).cast("string")
        part = df.select(F.lit(name).alias("label"), F.lit(catalog.ordinal(name)).alias("ord"), key_text(table.id_columns).alias("id"), tenant.alias("tenant")).where("id is not null")
        out = part if out is None else out.unionByName(part)
    return out


def edge_weight(edge: EdgeMapping) -> Column:
    if not edge.weight_column:
        return F.lit(1).cast("bigint")
    whole = F.round(F.col(edge.weight_column).cast("double")).cast("bigint")
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(MAX_WEIGHT), whole)), F.lit(1)).cast("bigint")


def edge_type(edge: EdgeMapping) -> Column:
    if not edge.label_column:
        return F.lit(edge.label)
    own = F.col(edge.label_column).cast("string")
    return F.when(F.length(F.trim(own)) > 0, own).otherwise(F.lit(edge.label))


def _native(key: Column, kind: DataType | None) -> Column:
    """A key that is one column as a number or text."""
    return key.cast("bigint" if isinstance(kind, IntegralType) else "string")


def raw_edges(catalog: Catalog, sources: dict[str, Source], edge: EdgeMapping, mapping_id: int, rows: DataFrame | None = None) -> tuple[DataFrame, str | None]:
    """One mapping's endpoint keys before they are resolved, and the label its start prefers."""
    source = sources[edge.from_table]
    df = source.df if rows is None else rows
    kinds = {f.name: f.dataType for f in df.schema}
    if edge.from_table in catalog.tables:
        ids = catalog.tables[edge.from_table].id_columns
        key = key_text(ids)
        src, dst, prefer = key, edge.from_column, edge.from_table
        near = _native(F.col(ids[0]), kinds.get(ids[0])) if len(ids) == 1 else key
    else:
        key = key_text(source.primary_key) if source.primary_key else F.xxhash64(*df.columns).cast("string")
        src, dst = F.col(edge.from_column).cast("string"), edge.to_column
        prefer = catalog.source_label(edge, sources)
        near = _native(F.col(edge.from_column), kinds.get(edge.from_column))
    out = df.select(
        src.alias("src_id"), F.col(dst).cast("string").alias("dst_id"), edge_type(edge).alias("type"), edge_weight(edge).alias("weight"),
        F.lit(mapping_id).alias("mapping_id"), key.alias("source_key"), near.alias("src_key"), _native(F.col(dst), kinds.get(dst)).alias("dst_key"),
    ).where("src_id is not null and dst_id is not null and source_key is not null")
    return out, prefer


def complete_sides(catalog: Catalog, sources: dict[str, Source]) -> set[tuple[int, str]]:
    """(mapping, side) where the preferred table has every key, so that its label
    is that of all ends.  Columns of one kind, numbers or text, are looked up
    once each; a table's own rows have their label anyway."""
    out, known = set(), {}
    for i, edge in enumerate(catalog.ordered_edges()):
        own = edge.from_table in catalog.tables
        ends = {"dst": (edge.from_column if own else edge.to_column, edge.to_table)}
        if not own:
            ends["src"] = (edge.from_column, catalog.source_label(edge, sources))
        for side, (column, label) in ends.items():
            ids = catalog.tables[label].id_columns if label in catalog.tables else ()
            if len(ids) != 1:
                continue
            df, nodes = sources[edge.from_table].df, sources[label].df
            kinds = df.schema[column].dataType, nodes.schema[ids[0]].dataType
            if not any(all(isinstance(k, kind) for k in kinds) for kind in (IntegralType, StringType)):
                continue
            here = edge.from_table, column, label
            if here not in known:
                keys = nodes.select(_native(F.col(ids[0]), kinds[1]).alias("k"))
                known[here] = df.select(_native(F.col(column), kinds[0]).alias("k")).where("k is not null").join(keys, "k", "left_anti").isEmpty()
            if known[here]:
                out.add((i, side))
    return out


def _resolve(edges: DataFrame, nodes: DataFrame, side: str, prefer: str | None, sole: bool) -> DataFrame:
    """Adds the label of an endpoint: the preferred table if it has the key,
    else the first table that does; edges without either are dropped."""
    if prefer is not None and sole:
        own = nodes.where(F.col("label") == prefer).select(F.col("id").alias(f"{side}_id"))
        return edges.join(own, f"{side}_id", "left_semi").withColumn(f"{side}_label", F.lit(prefer))
    rank = F.when(F.col("label") == (prefer or ""), -1).otherwise(F.col("ord"))
    found = nodes.groupBy("id").agg(F.min_by("label", rank).alias(f"{side}_label")).withColumnRenamed("id", f"{side}_id")
    return edges.join(found, f"{side}_id")


def resolved_edges(catalog: Catalog, sources: dict[str, Source], nodes: DataFrame, fallback: bool = True, changed: dict[str, DataFrame] | None = None, complete: set[tuple[int, str]] | frozenset = frozenset()) -> DataFrame | None:
    """Edges of all mappings with both orientations; ``changed`` derives those of other rows instead.
    Ends of the sides in ``complete`` are all in the preferred table."""
    out = None
    for i, edge in enumerate(catalog.ordered_edges()):
        if changed is not None and edge.from_table not in changed:
            continue
        rows, prefer = raw_edges(catalog, sources, edge, i, None if changed is None else changed[edge.from_table])
        own = edge.from_table in catalog.tables
        if own or (i, "src") in complete:
            rows = rows.withColumn("src_label", F.lit(prefer))
        else:
            rows = _resolve(rows, nodes, "src", prefer, not fallback and prefer is not None)
        if (i, "dst") in complete:
            rows = rows.withColumn("dst_label", F.lit(edge.to_table))
        else:
            rows = _resolve(rows, nodes, "dst", edge.to_table, not fallback)
        rows = rows.withColumn("reversed", F.lit(False))
        names = [c.split(" ")[0] for c in EDGE_SCHEMA.split(", ")]
        rows = rows.select(*names)
        if edge.bidirectional:
            back = rows.select(F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), "type", "weight", F.lit(True).alias("reversed"), "mapping_id", "source_key")
            rows = rows.unionByName(back)
        out = rows if out is None else out.unionByName(rows)
    return out


def edge_parts(catalog: Catalog, sources: dict[str, Source], complete: set[tuple[int, str]]) -> list[Part] | None:
    out = []
    for i, edge in enumerate(catalog.ordered_edges()):
        if (i, "dst") not in complete or (edge.from_table not in catalog.tables and (i, "src") not in complete):
            return None
        rows, prefer = raw_edges(catalog, sources, edge, i)
        out.append(Part(prefer, edge.to_table, rows.select("src_key", "dst_key", "type", "weight"), edge.bidirectional))
    return out


def build(catalog: Catalog, sources: dict[str, Source], fallback: bool = True) -> Graph:
    """Plans of nodes and edges; only the keys of edges are looked up before they are read."""
    spark = next(iter(sources.values())).df.sparkSession if sources else None
    if spark is None or not catalog.tables:
        raise GraphError("semantic", "no tables are registered")
    nodes = node_rows(catalog, sources)
    complete = complete_sides(catalog, sources)
    edges = resolved_edges(catalog, sources, nodes, fallback, None, complete)
    if edges is None:
        edges = spark.createDataFrame([], EDGE_SCHEMA)
    return Graph(nodes, edges, any(not e.bidirectional for e in catalog.edges), any(e.weight_column for e in catalog.edges), edge_parts(catalog, sources, complete))

"""Registered tables, relationship mappings and filter columns of a graph, and discovery."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.errors import GraphError

#: Types of filter columns with their Spark types.
FILTER_TYPES = {"numeric": "bigint", "boolean": "boolean", "text": "string", "date": "date", "timestamptz": "timestamp", "uuid": "string"}
MAX_EDGE_LABELS = 254
#: The vocabulary of named graphs.
KINDS = ("global", "user", "tenant", "workspace", "subgraph")
RESIDENCIES = ("hot", "warm", "cold")
MATERIALIZATIONS = ("shared", "dedicated")
PROJECTION_MODES = ("csr_readonly", "mutable_overlay")


@dataclass(frozen=True)
class NodeTable:
    name: str
    id_columns: tuple[str, ...]
    columns: tuple[str, ...] | None = None
    tenant_column: str | None = None


@dataclass(frozen=True)
class EdgeMapping:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    label: str
    bidirectional: bool = True
    weight_column: str | None = None
    label_column: str | None = None


@dataclass(frozen=True)
class FilterColumn:
    table: str
    column: str
    type: str = "numeric"


@dataclass(frozen=True)
class Source:
    """A table of the host: rows, and the keys that discovery and edges use."""

    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    #: column, referenced table, referenced column
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    namespace: str = "public"


def key_text(columns: tuple[str, ...] | list[str], of: DataFrame | None = None) -> Column:
    """A key as text: one column cast, several as a JSON array with ", " between."""
    cols = [of[c] if of is not None else F.col(c) for c in columns]
    if len(cols) == 1:
        return cols[0].cast("string")
    quoted = [F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "") for c in cols]
    whole = F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))
    present = cols[0].isNotNull()
    for c in cols[1:]:
        present = present & c.isNotNull()
    return F.when(present, whole)


@dataclass
class Catalog:
    """What one graph has registered; order of tables is that of their names."""

    tables: dict[str, NodeTable] = field(default_factory=dict)
    edges: list[EdgeMapping] = field(default_factory=list)
    filters: list[FilterColumn] = field(default_factory=list)

    def ordinal(self, table: str) -> int:
        return sorted(self.tables).index(table)

    def ordered_edges(self) -> list[EdgeMapping]:
        return sorted(self.edges, key=lambda e: (e.from_table, e.from_column, e.to_table, e.to_column, e.label))

    def table(self, name: str) -> NodeTable:
        if name not in self.tables:
            raise GraphError("semantic", f"unknown label {name}")
        return self.tables[name]

    def properties(self, table: str, df: DataFrame) -> list[str]:
        t = self.table(table)
        return df.columns if t.columns is None else list(dict.fromkeys((*t.id_columns, *t.columns)))

    def add_table(self, source: Source, id_columns: tuple[str, ...], columns: tuple[str, ...] | None, tenant_column: str | None, check: bool) -> None:
        have = set(source.df.columns)
        for c in (*id_columns, *(columns or ()), *((tenant_column,) if tenant_column else ())):
            if c not in have:
                raise GraphError("semantic", f"table {source.name} has no column {c}")
        if not id_columns:
            raise GraphError("semantic", f"table {source.name} needs a key")
        if check and tuple(source.primary_key) != tuple(id_columns):
            keys = source.df.groupBy(*id_columns).count()
            missing = F.lit(False)
            for c in id_columns:
                missing = missing | F.col(c).isNull()
            if not keys.where((F.col("count") > 1) | missing).isEmpty():
                raise GraphError("semantic", f"{', '.join(id_columns)} is not a unique key without nulls of {source.name}")
        self.tables[source.name] = NodeTable(source.name, tuple(id_columns), None if columns is None else tuple(columns), tenant_column)

    def add_edge(self, edge: EdgeMapping, sources: dict[str, Source]) -> None:
        for table in (edge.from_table, edge.to_table):
            if table not in sources:
                raise GraphError("semantic", f"unknown table {table}")
        if edge.to_table not in self.tables:
            raise GraphError("semantic", f"edge target {edge.to_table} is not a registered table")
        have = set(sources[edge.from_table].df.columns)
        fk_style = edge.from_table in self.tables
        for c in (edge.from_column, edge.weight_column, edge.label_column, None if fk_style else edge.to_column):
            if c and c not in have:
                raise GraphError("semantic", f"table {edge.from_table} has no column {c}")
        if fk_style and edge.to_column not in sources[edge.to_table].df.columns:
            raise GraphError("semantic", f"table {edge.to_table} has no column {edge.to_column}")
        if not edge.label:
            raise GraphError("semantic", "an edge needs a label")
        if len({e.label for e in self.edges} | {edge.label}) > MAX_EDGE_LABELS:
            raise GraphError("edge_type_limit", f"more than {MAX_EDGE_LABELS} edge labels")
        self.edges.append(edge)

    def source_label(self, edge: EdgeMapping, sources: dict[str, Source]) -> str | None:
        """Label of an edge's start: the table itself, or what its column refers to."""
        if edge.from_table in self.tables:
            return edge.from_table
        refers = {c: t for c, t, _ in sources[edge.from_table].foreign_keys}
        return refers.get(edge.from_column)

    def add_filter(self, f: FilterColumn, sources: dict[str, Source]) -> None:
        if f.type not in FILTER_TYPES:
            raise GraphError("semantic", f"filter columns can't be of type {f.type}")
        df = sources[self.table(f.table).name].df
        if f.column not in df.columns:
            raise GraphError("semantic", f"table {f.table} has no column {f.column}")
        if f.type == "numeric" and not isinstance(df.schema[f.column].dataType, T.NumericType):
            raise GraphError("semantic", f"{f.table}.{f.column} is not numeric")
        self.filters = [x for x in self.filters if (x.table, x.column) != (f.table, f.column)] + [f]

    def change_edges(self, label: str, /, **changes: object) -> None:
        if label not in {e.label for e in self.edges}:
            raise GraphError("semantic", f"unknown edge label {label}")
        self.edges = [replace(e, **{k: v for k, v in changes.items() if v is not None}) if e.label == label else e for e in self.edges]

    def remove_edge(self, label: str) -> None:
        if label not in {e.label for e in self.edges}:
            raise GraphError("semantic", f"unknown edge label {label}")
        self.edges = [e for e in self.edges if e.label != label]

    def remove_table(self, name: str) -> None:
        self.table(name)
        del self.tables[name]
        self.edges = [e for e in self.edges if name not in (e.from_table, e.to_table)]
        self.filters = [f for f in self.filters if f.table != name]

    def as_map(self) -> dict:
        body = {
            "tables": [asdict(self.tables[t]) for t in sorted(self.tables)],
            "relationships": [asdict(e) for e in self.ordered_edges()],
            "filters": [asdict(f) for f in sorted(self.filters, key=lambda f: (f.table, f.column))],
        }
        return {"fingerprint": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest(), **body}


def edge_label(column: str) -> str:
    """A foreign key's label: its name without trailing ``_id``, then ``_fk``."""
    out = column
    for suffix in ("_id", "_fk"):
        while out.endswith(suffix) and len(out) > len(suffix):
            out = out[: -len(suffix)]
    return out


def discover(sources: list[Source], tenant_column: str | None = None) -> tuple[list[NodeTable], list[EdgeMapping], list[tuple[str, str, str]]]:
    """Tables with a key become node tables, those whose key is made of foreign
    keys alone become junctions, foreign keys become edges."""
    names = {s.name for s in sources}
    tables, edges, items = [], [], []
    for s in sorted(sources, key=lambda s: s.name):
        keys = [fk for fk in s.foreign_keys if fk[1] in names]
        if not s.primary_key:
            items.append(("skipped", s.name, "no primary key"))
            continue
        refers = {c for c, _, _ in keys}
        if len(s.primary_key) > 1 and set(s.primary_key) <= refers:
            (a, at, _), (b, bt, bc) = [fk for fk in keys if fk[0] in s.primary_key][:2]
            edges.append(EdgeMapping(s.name, a, bt, b, edge_label(s.name), True))
            items.append(("junction", s.name, f"{at}.{a} -> {bt}.{bc}"))
            continue
        tenant = tenant_column if tenant_column in s.df.columns else None
        tables.append(NodeTable(s.name, tuple(s.primary_key), None, tenant))
        items.append(("table", s.name, f"key {', '.join(s.primary_key)}"))
        for column, table, target in keys:
            edges.append(EdgeMapping(s.name, column, table, target, edge_label(column), True))
            items.append(("edge", edge_label(column), f"{s.name}.{column} -> {table}.{target}"))
    return tables, edges, items


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

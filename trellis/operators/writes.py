"""Single-row pattern writes on immutable sources.

A write replaces a source by ``base without changed keys, plus new rows``; a
savepoint is the mapping of names to sources, so rolling back is assigning it.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.catalog import Catalog, Source, key_text
from trellis.errors import GraphError
from trellis.plans.planner import Planner
from trellis.plans.syntax import Item, Read, Return, Write


class Overlay:
    """Uncommitted rows of a session, with counts for status and savepoints."""

    def __init__(self) -> None:
        self.added_nodes = self.deleted_nodes = self.added_edges = self.deleted_edges = self.tombstones = 0
        self.saved: dict[str, dict[str, Source]] = {}

    @property
    def dirty(self) -> bool:
        return bool(self.added_nodes or self.deleted_nodes or self.added_edges or self.deleted_edges)

    def clear(self) -> None:
        self.__init__()


def insert(source: Source, row: dict[str, Any]) -> Source:
    """The source with one more row; columns that are not given are null."""
    df = source.df
    values = tuple(_coerced(row.get(f.name), f.dataType) for f in df.schema.fields)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return replace(source, df=df.unionByName(df.sparkSession.createDataFrame([values], schema)))


def delete(source: Source, columns: tuple[str, ...], key: str) -> Source:
    return replace(source, df=source.df.where(~F.coalesce(key_text(columns) == key, F.lit(False))))


def update(source: Source, columns: tuple[str, ...], key: str, changes: dict[str, Any]) -> Source:
    here = F.coalesce(key_text(columns) == key, F.lit(False))
    new = {c: F.when(here, F.lit(_coerced(v, source.df.schema[c].dataType)).cast(source.df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()}
    return replace(source, df=source.df.withColumns(new))


def _coerced(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    try:
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else str(value)
    except (TypeError, ValueError):
        raise GraphError("execution", f"{value!r} does not fit {kind.simpleString()}") from None
    return value


class Writer:
    """Runs one write statement; returns its RETURN rows and the changed sources."""

    def __init__(self, planner: Planner, tenant: str | None) -> None:
        self.planner, self.catalog, self.sources, self.tenant = planner, planner.catalog, dict(planner.sources), tenant

    def run(self, w: Write, overlay: Overlay) -> DataFrame:
        for v in w.returns.items:
            if v.kind == "agg":
                raise GraphError("unsupported", "writes return no aggregates")
        return {"create_node": self.create_node, "create_rel": self.create_rel, "set": self.set_property, "remove": self.remove_property, "delete": self.delete_rel, "detach_delete": self.detach_delete, "merge": self.merge}[w.action](w, overlay)

    # -- parts

    def result(self, w: Write, var: str, label: str, key: str, before: bool = False) -> DataFrame:
        """RETURN over the one written node."""
        sources = self.planner.sources if before else self.sources
        p = Planner(self.catalog, sources, self.planner.graph, self.planner.params, self.tenant, hydrate=self.planner.hydrate)
        from trellis.plans.planner import Binding

        df = p.scan(var, label).where(F.col(f"{var}__id_") == key)
        out = p.returned(df, {var: Binding("node", var, label)}, Read(False, w.patterns or [w.create], None, [], w.returns))
        return out if not before else self.kept(out)

    @staticmethod
    def kept(df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    def one(self, w: Write, items: list[Item], names: list[str]) -> tuple:
        """The only match of a write's patterns."""
        rows = self.planner.read(Read(False, w.patterns, w.where, [], Return(True, items, limit=2))).collect()
        if len(rows) != 1:
            raise GraphError("execution", f"a write needs exactly one match, found {'none' if not rows else 'several'}")
        return tuple(rows[0])

    def label(self, w: Write, var: str) -> str:
        for p in w.patterns:
            for n in p.nodes:
                if n.var == var and n.label:
                    return n.label
        raise GraphError("semantic", f"{var} is not a labelled node")

    def values(self, label: str, props: dict) -> dict[str, Any]:
        table = self.catalog.table(label)
        allowed = self.catalog.properties(label, self.sources[label].df)
        row = {}
        for k, v in props.items():
            if k not in allowed:
                raise GraphError("semantic", f"{label} has no property {k}")
            row[k] = self.planner.value(v)
        if table.tenant_column and self.tenant is not None:
            row[table.tenant_column] = self.tenant
        return row

    def key(self, label: str, row: dict) -> str:
        table = self.catalog.table(label)
        if any(row.get(c) is None for c in table.id_columns):
            raise GraphError("semantic", f"{label} needs its key {', '.join(table.id_columns)}")
        if len(table.id_columns) == 1:
            return str(row[table.id_columns[0]])
        import json

        return "[" + ", ".join(json.dumps(str(row[c]), ensure_ascii=False) for c in table.id_columns) + "]"

    def exists(self, label: str, key: str) -> bool:
        return not self.sources[label].df.where(key_text(self.catalog.table(label).id_columns) == key).isEmpty()

    # -- statements

    def create_node(self, w: Write, overlay: Overlay) -> DataFrame:
        n = w.create.nodes[0]
        if not n.label:
            raise GraphError("semantic", "CREATE needs a label")
        row = self.values(n.label, n.props)
        key = self.key(n.label, row)
        if self.exists(n.label, key):
            raise GraphError("execution", f"{n.label} already has the key {key}")
        self.sources[n.label] = insert(self.sources[n.label], row)
        overlay.added_nodes += 1
        return self.result(w, n.var or "_n", n.label, key)

    def create_rel(self, w: Write, overlay: Overlay) -> DataFrame:
        rel, (left, right) = w.create.rels[0], w.create.nodes
        if rel.direction == "in":
            left, right = right, left
        if rel.direction == "both" or len(rel.types) != 1:
            raise GraphError("unsupported", "CREATE needs a direction and one type")
        a, b = self.label(w, left.var), self.label(w, right.var)
        found = [e for e in self.catalog.ordered_edges() if e.to_table == b and e.from_table not in self.catalog.tables and self.catalog.source_label(e, self.sources) in (a, None) and (e.label == rel.types[0] or e.label_column)]
        if len(found) != 1:
            raise GraphError("semantic", f"{rel.types[0]} is not one edge table from {a} to {b}")
        e = found[0]
        source = self.sources[e.from_table]
        row = {}
        for k, v in rel.props.items():
            if k not in source.df.columns:
                raise GraphError("semantic", f"{e.from_table} has no column {k}")
            row[k] = self.planner.value(v)
        ids = self.pair(w, left.var, right.var)
        row |= {e.from_column: ids[0], e.to_column: ids[1]}
        if e.label_column:
            row.setdefault(e.label_column, rel.types[0])
        self.sources[e.from_table] = insert(source, row)
        overlay.added_edges += 1
        rows = self.planner.sources
        self.planner.sources = self.sources
        try:
            df, scope = None, {}
            for v, label, key in ((left.var, a, ids[0]), (right.var, b, ids[1])):
                part = self.planner.scan(v, label).where(F.col(f"{v}__id_") == str(key))
                df = part if df is None else df.crossJoin(part)  # one row each
                from trellis.plans.planner import Binding

                scope[v] = Binding("node", v, label)
            if rel.var:
                df = df.withColumns({f"{rel.var}__key_": F.lit("new"), f"{rel.var}__type_": F.lit(rel.types[0]), f"{rel.var}__start_": F.struct(F.lit(a).alias("table"), F.lit(str(ids[0])).alias("id")), f"{rel.var}__end_": F.struct(F.lit(b).alias("table"), F.lit(str(ids[1])).alias("id"))})
                scope[rel.var] = Binding("rel", rel.var, None)
            return self.planner.returned(df, scope, Read(False, w.patterns, None, [], w.returns))
        finally:
            self.planner.sources = rows

    def pair(self, w: Write, a: str, b: str) -> tuple[str, str]:
        """Keys of the two matched nodes; each pattern may match one row alone."""
        if len(w.patterns) == 1 and w.patterns[0].rels:
            return self.one(w, [Item("func", "id", (a,), alias="a"), Item("func", "id", (b,), alias="b")], ["a", "b"])
        out = []
        for var in (a, b):
            mine = [p for p in w.patterns if any(n.var == var for n in p.nodes)]
            where = _about(w.where, var)
            out.append(self.one(replace(w, patterns=mine[:1], where=where), [Item("func", "id", (var,), alias="a")], ["a"])[0])
        return tuple(out)

    def set_property(self, w: Write, overlay: Overlay) -> DataFrame:
        (var, path), label = w.target, self.label(w, w.target[0])
        return self.assign(w, var, label, path, self.planner.value(w.value))

    def remove_property(self, w: Write, overlay: Overlay) -> DataFrame:
        (var, path), label = w.target, self.label(w, w.target[0])
        return self.assign(w, var, label, path, None)

    def assign(self, w: Write, var: str, label: str, path: tuple[str, ...], value: Any) -> DataFrame:
        table = self.catalog.table(label)
        if len(path) != 1:
            raise GraphError("unsupported", "only a property itself can be written")
        if path[0] in table.id_columns or path[0] == table.tenant_column:
            raise GraphError("semantic", f"{path[0]} can't be written")
        if path[0] not in self.catalog.properties(label, self.sources[label].df):
            raise GraphError("semantic", f"{label} has no property {path[0]}")
        (key,) = self.one(w, [Item("func", "id", (var,), alias="a")], ["a"])
        self.sources[label] = update(self.sources[label], table.id_columns, key, {path[0]: value})
        return self.result(w, var, label, key)

    def delete_rel(self, w: Write, overlay: Overlay) -> DataFrame:
        rels = [(p, r) for p in w.patterns for r in p.rels if r.var == w.target[0]]
        if not rels:
            raise GraphError("semantic", "DELETE takes the relationship variable of its pattern")
        out = self.kept(self.planner.read(Read(False, w.patterns, w.where, [], w.returns)))
        p = Planner(self.catalog, self.sources, self.planner.graph, self.planner.params, self.tenant)
        df, scope = p.single(Read(False, w.patterns, w.where, [], w.returns))
        var = w.target[0]
        rows = df.select(f"{var}__mapping_", f"{var}__key_").distinct().limit(2).collect()
        if len(rows) != 1:
            raise GraphError("execution", f"a write needs exactly one match, found {'none' if not rows else 'several'}")
        e = self.catalog.ordered_edges()[rows[0][0]]
        if e.from_table in self.catalog.tables:
            raise GraphError("unsupported", "edges of foreign keys are removed by writing the key")
        source = self.sources[e.from_table]
        columns = source.primary_key
        if not columns:
            raise GraphError("unsupported", f"{e.from_table} has no primary key")
        self.sources[e.from_table] = delete(source, columns, rows[0][1])
        overlay.deleted_edges += 1
        overlay.tombstones += 1
        return out

    def detach_delete(self, w: Write, overlay: Overlay) -> DataFrame:
        var, label = w.target[0], self.label(w, w.target[0])
        table = self.catalog.table(label)
        (key,) = self.one(w, [Item("func", "id", (var,), alias="a")], ["a"])
        out = self.result(w, var, label, key, before=True)
        for e in self.catalog.ordered_edges():
            start = self.catalog.source_label(e, self.sources)
            source = self.sources[e.from_table]
            ends = [c for c, of in ((e.from_column, start), (e.to_column, e.to_table)) if of == label]
            if not ends:
                continue
            if e.from_table in self.catalog.tables:
                if e.to_table == label and not source.df.where(F.col(e.from_column).cast("string") == key).isEmpty():
                    raise GraphError("unsupported", f"{e.from_table} rows refer to the node by a foreign key")
                continue
            hit = F.lit(False)
            for c in ends:
                hit = hit | F.coalesce(F.col(c).cast("string") == key, F.lit(False))
            overlay.deleted_edges += source.df.where(hit).count()
            self.sources[e.from_table] = replace(source, df=source.df.where(~hit))
        self.sources[label] = delete(self.sources[label], table.id_columns, key)
        overlay.deleted_nodes += 1
        overlay.tombstones += 1
        return out

    def merge(self, w: Write, overlay: Overlay) -> DataFrame:
        n = w.create.nodes[0]
        if not n.label:
            raise GraphError("semantic", "MERGE needs a label")
        table, row = self.catalog.table(n.label), self.values(n.label, n.props)
        key = self.key(n.label, row)
        found = self.exists(n.label, key)
        then = w.on_match if found else w.on_create
        changes = {}
        if then:
            (var, path), value = then
            if var != n.var or len(path) != 1 or path[0] in table.id_columns:
                raise GraphError("semantic", "MERGE sets a property of its node that is not its key")
            changes = self.values(n.label, {path[0]: value})
            changes = {k: v for k, v in changes.items() if k == path[0]}
        if not found:
            self.sources[n.label] = insert(self.sources[n.label], row | changes)
            overlay.added_nodes += 1
        elif changes:
            self.sources[n.label] = update(self.sources[n.label], table.id_columns, key, changes)
        return self.result(w, n.var or "_n", n.label, key)


def _about(where: Any, var: str) -> Any:
    """The conjuncts of a predicate that concern one variable alone."""
    from trellis.plans.planner import _props
    from trellis.plans.syntax import And, Compare, IdOf

    def uses(x: Any) -> set[str]:
        out = {p.var for p in _props(x)}
        if isinstance(x, Compare):
            out |= {s.var for s in (x.left, x.right) if isinstance(s, IdOf)}
        return out

    parts = where.parts if isinstance(where, And) else [] if where is None else [where]
    mine = [p for p in parts if uses(p) == {var}]
    return None if not mine else mine[0] if len(mine) == 1 else And(mine)

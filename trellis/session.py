"""The session: sources, graphs, queries, writes and maintenance in one place."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from trellis.admin import Admin, GraphEntry
from trellis.catalog import EdgeMapping, FilterColumn, Source, discover, key_text
from trellis.errors import GraphError
from trellis.functions import filters as fl
from trellis.functions.paths import format_path, format_path_column, node_ref
from trellis.operators import aggregate as agg
from trellis.operators import components as comp
from trellis.operators import paths as pth
from trellis.operators import search as srch
from trellis.operators import traverse as trv
from trellis.operators.build import Graph, build
from trellis.operators.writes import Overlay, Writer
from trellis.plans.explain import COMPATIBILITY, compatible, explain
from trellis.plans.parser import parse
from trellis.plans.planner import Planner
from trellis.plans.syntax import Write
from trellis.settings import Settings
from trellis.sources.storage import local

TRAVERSE = "root_table string, root_id string, node_table string, node_id string, depth int, path array<struct<table:string,id:string>>, edge_path array<string>, capped boolean"


#: Rows of a page that may come to the driver.
PAGE = 2_000
#: Edges that are cached though they come from their sources without a join.
CACHED = 20_000_000


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    return rows if n is None else rows.limit(n)


@dataclass
class Session(Admin):
    """A property graph over DataFrames.

    Table-valued functions return DataFrames; a table's name stands where a
    database would give its identifier.
    """

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    sources: dict[str, Source] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.start_admin()
        self.overlay = Overlay()

    # -- sources and registration

    def source(self, name: str, df: DataFrame, primary_key: tuple[str, ...] | list[str] | str = (), foreign_keys: list[tuple[str, str, str]] | tuple = (), namespace: str = "public") -> None:
        """Names a table of the host with its keys."""
        key = (primary_key,) if isinstance(primary_key, str) else tuple(primary_key)
        self.sources[name] = Source(name, df, key, tuple(map(tuple, foreign_keys)), namespace)

    def _source(self, name: str) -> Source:
        if name not in self.sources:
            raise GraphError("semantic", f"unknown table {name}")
        return self.sources[name]

    def add_table(self, table_name: str, id_column: str | list[str] | tuple[str, ...], columns: list[str] | None = None, tenant_column: str | None = None, check: bool = True) -> None:
        self.add_table_to(self.current, table_name, id_column, columns, tenant_column, check)

    def add_table_to_graph(self, graph_name: str, table_name: str, id_column: str | list[str] | tuple[str, ...], columns: list[str] | None = None, tenant_column: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        self.add_table_to(self.find_graph(graph_name, graph_tenant, graph_namespace), table_name, id_column, columns, tenant_column, True)

    def add_table_to(self, g: GraphEntry, table_name: str, id_column: Any, columns: Any, tenant_column: str | None, check: bool) -> None:
        ids = (id_column,) if isinstance(id_column, str) else tuple(id_column)
        g.catalog.add_table(self._source(table_name), ids, None if columns is None else tuple(columns), tenant_column, check)
        g.changed()

    def add_edge(self, from_table: str, from_column: str, to_table: str, to_column: str, label: str, bidirectional: bool = True, weight_column: str | None = None, label_column: str | None = None) -> None:
        self.current.catalog.add_edge(EdgeMapping(from_table, from_column, to_table, to_column, label, bidirectional, weight_column, label_column), self.sources)
        self.current.changed()

    def add_edge_to_graph(self, graph_name: str, from_table: str, from_column: str, to_table: str, to_column: str, label: str, bidirectional: bool = True, weight_column: str | None = None, label_column: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        g.catalog.add_edge(EdgeMapping(from_table, from_column, to_table, to_column, label, bidirectional, weight_column, label_column), self.sources)
        g.changed()

    def add_filter_column(self, table_name: str, column_name: str, column_type: str = "numeric") -> None:
        self.current.catalog.add_filter(FilterColumn(table_name, column_name, column_type), self.sources)
        self.current.changed()

    def add_filter_column_to_graph(self, graph_name: str, table_name: str, column_name: str, column_type: str = "numeric", graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        g.catalog.add_filter(FilterColumn(table_name, column_name, column_type), self.sources)
        g.changed()

    def alter_edge(self, graph_name: str, label: str, bidirectional: bool | None = None, weight_column: str | None = None, label_column: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        g.catalog.change_edges(label, bidirectional=bidirectional, weight_column=weight_column, label_column=label_column)
        g.changed()

    def rename_edge(self, graph_name: str, old_label: str, new_label: str, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        g.catalog.change_edges(old_label, label=new_label)
        g.changed()

    def remove_edge(self, *args: str, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        """``remove_edge(label)`` or ``remove_edge(graph_name, label)``."""
        g = self.current if len(args) == 1 else self.find_graph(args[0], graph_tenant, graph_namespace)
        g.catalog.remove_edge(args[-1])
        g.changed()

    remove_edge_from_graph = remove_edge

    def remove_table(self, table_name: str) -> None:
        self.current.catalog.remove_table(table_name)
        self.current.changed()

    def remove_table_from_graph(self, graph_name: str, table_name: str, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        g.catalog.remove_table(table_name)
        g.changed()

    def registered_tables(self) -> DataFrame:
        return self._tables(self.current)

    def registered_tables_for_graph(self, graph_name: str, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self._tables(self.find_graph(graph_name, graph_tenant, graph_namespace))

    def _tables(self, g: GraphEntry) -> DataFrame:
        rows = [(t.name, list(t.id_columns), None if t.columns is None else list(t.columns), t.tenant_column) for _, t in sorted(g.catalog.tables.items())]
        return self.rows(rows, "table_name string, id_columns array<string>, columns array<string>, tenant_column string")

    def registered_edges(self) -> DataFrame:
        return self._edges(self.current)

    def registered_edges_for_graph(self, graph_name: str, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self._edges(self.find_graph(graph_name, graph_tenant, graph_namespace))

    list_edges = registered_edges_for_graph

    def _edges(self, g: GraphEntry) -> DataFrame:
        rows = [(e.from_table, e.from_column, e.to_table, e.to_column, e.label, e.bidirectional, e.weight_column, e.label_column) for e in g.catalog.ordered_edges()]
        return self.rows(rows, "from_table string, from_column string, to_table string, to_column string, label string, bidirectional boolean, weight_column string, label_column string")

    def graph_map(self, graph_name: str, format: str = "json", graph_tenant: str | None = None, graph_namespace: str | None = None) -> dict:
        if format != "json":
            raise GraphError("semantic", f"unknown format {format}")
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        missing = [t for t in g.catalog.tables if t not in self.sources]
        return {"graph": {"name": g.name, "tenant": g.tenant, "namespace": g.namespace, "kind": g.kind}, "catalog": g.catalog.as_map(), "status": {"built": g.graph is not None, "needs_rebuild": g.needs_rebuild}, "warnings": [f"table {t} is missing" for t in missing]}

    # -- discovery

    def preview_discover(self, schema_name: str = "public", graph_name: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self._discovered([s for s in self.sources.values() if s.namespace == schema_name], None)[2]

    def preview_discover_tables(self, tables: list[str], tenant_column: str | None = None, graph_name: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self._discovered([self._source(t) for t in tables], tenant_column)[2]

    def auto_discover(self, schema_name: str = "public", graph_name: str | None = None, build: bool = True, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self._register([s for s in self.sources.values() if s.namespace == schema_name], None, graph_name, build, graph_tenant, graph_namespace)

    def auto_discover_tables(self, tables: list[str], tenant_column: str | None = None, graph_name: str | None = None, build: bool = True, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self._register([self._source(t) for t in tables], tenant_column, graph_name, build, graph_tenant, graph_namespace)

    def _discovered(self, found: list[Source], tenant_column: str | None) -> tuple:
        tables, edges, items = discover(found, tenant_column)
        return tables, edges, self.rows(items, "item_type string, item_name string, details string")

    def _register(self, found: list[Source], tenant_column: str | None, graph_name: str | None, build_: bool, tenant: str | None, namespace: str | None) -> DataFrame:
        tables, edges, items = self._discovered(found, tenant_column)
        g = self.current if graph_name is None else self.find_graph(graph_name, tenant, namespace)
        for t in tables:
            self.add_table_to(g, t.name, t.id_columns, t.columns, t.tenant_column, False)
        for e in edges:
            g.catalog.add_edge(e, self.sources)
        if build_:
            self._build(g)
        return items

    def create_row_predicate_subgraph(self, graph_name: str, row_predicate: Any, graph_tenant: str | None = None, graph_namespace: str | None = None) -> None:
        raise GraphError("unsupported_operation", "subgraphs by row predicate are not supported")

    # -- build

    def build(self, mode: str | bool | None = None, concurrently: bool | None = None) -> DataFrame:
        """``build()``, ``build(mode)`` or ``build(concurrently=...)``."""
        if isinstance(mode, bool):
            concurrently, mode = mode, None
        if mode is not None:
            self.set_mode(self.current, mode)
        if concurrently is None:
            return self.build_row(self._build(self.current))
        return self.build_job(self.current, concurrently)

    def build_graph(self, graph_name: str, force_persist: bool = False, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        return self.build_row(self._build(g, force_persist))

    def _build(self, g: GraphEntry, save: bool = False) -> GraphEntry:
        self.check_enabled()
        self.require(g, "build")
        began = time.time()
        if g.graph is not None:
            g.graph.unpersist()
        made = build(g.catalog, self.sources)
        made.nodes = made.nodes.persist()
        if made.parts is None:
            made.edges = made.edges.persist()
        g.node_count, g.edge_count = made.nodes.count(), made.edges.count()
        if g.edge_count <= CACHED:
            made.edges = made.edges.persist()
        try:
            self.check_quotas(g)
        except GraphError:
            made.unpersist()
            g.node_count = g.edge_count = 0
            g.graph = None
            raise
        labels = [r.type for r in made.edges.select("type").distinct().limit(256).collect()]
        if len(labels) > 254:
            raise GraphError("edge_type_limit", "more than 254 edge labels")
        g.built(made, labels, (time.time() - began) * 1000)
        if save or self.settings.data_dir:
            g.manifest = self.store(g).save(made, g.applied)
        return g

    def graph(self) -> Graph:
        """The current topology, after pending changes as the freshness setting says."""
        self.check_enabled()
        g = self.current
        self.require(g, "read")
        if g.graph is None:
            raise GraphError("not_built", "the graph is not built")
        if self.pending_rows(g):
            if self.settings.query_freshness == "error_on_pending":
                raise GraphError("execution", "changes are pending")
            if self.settings.query_freshness == "apply_pending_sync":
                self.apply_sync()
        if g.stale:
            self._build(g)
        return g.graph

    # -- search

    def search(self, property_key: str, property_value: str, table_filter: str | None = None, mode: str | None = None, case_sensitive: bool | None = None, max_rows: int | None = 100, row_offset: int = 0, tenant: str | None = None, hydrate: bool | None = None) -> DataFrame:
        out = self._found(property_key, property_value, table_filter, mode, case_sensitive, max_rows, row_offset, tenant)
        hydrate = self.settings.default_hydrate if hydrate is None else hydrate
        out = self.hydrated(out) if hydrate else out.withColumn("node", F.lit(None).cast("string"))
        return out.select("node_table", "node_id", "match_type", "score", "verified", "node", F.col("node_table").alias("node_table_name")).orderBy("node_table", "node_id")

    def search_nodes(self, property_key: str, property_value: str, table_filter: str | None = None, mode: str | None = None, case_sensitive: bool | None = None, max_rows: int | None = 100, row_offset: int = 0, tenant: str | None = None) -> DataFrame:
        out = self._found(property_key, property_value, table_filter, mode, case_sensitive, max_rows, row_offset, tenant)
        return out.select("node_table", "node_id", "match_type", "score", "verified", F.col("node_table").alias("node_table_name"))

    def _found(self, key: str, value: str, table: str | None, mode: str | None, case_sensitive: bool | None, max_rows: int | None, row_offset: int, tenant: str | None) -> DataFrame:
        self.check_enabled()
        self.require(self.current, "read")
        mode = mode or self.settings.default_search_mode
        sensitive = self.settings.default_case_sensitive if case_sensitive is None else case_sensitive
        out = srch.search(self.current.catalog, self.sources, key, value, table, mode, sensitive, tenant or self.settings.tenant)
        out = out.dropDuplicates(["node_table", "node_id"]).orderBy("ord", "node_id")
        out = out.offset(row_offset) if row_offset else out
        return _first(out, max_rows).select("ord", "node_table", "node_id", F.lit(mode).alias("match_type"), F.lit(1.0).cast("float").alias("score"), F.lit(True).alias("verified"))

    def hydrated(self, rows: DataFrame, table: str = "node_table", key: str = "node_id") -> DataFrame:
        """Adds ``node``, the source row as JSON.

        A page of up to ``PAGE`` rows is brought in first: only its tables are
        read, and its keys reach their scans.  More rows join each table."""
        page = local(rows, PAGE)
        whole = None
        for name, t in sorted(self.current.catalog.tables.items()):
            df, condition = self.sources[name].df, None
            if page is not None:
                keys = sorted({k for n, k in zip(page[1][table].to_pylist(), page[1][key].to_pylist(), strict=True) if n == name and k is not None})
                if not keys:
                    continue
                kind = df.schema[t.id_columns[0]].dataType
                native = len(t.id_columns) == 1 and isinstance(kind, (IntegralType, StringType))
                values = [F.lit(k).cast(kind) if native else F.lit(k) for k in keys]
                condition = (F.col(t.id_columns[0]) if native else key_text(t.id_columns)).isin(values)
            found = df if condition is None else df.where(condition)
            props = self.current.catalog.properties(name, df)
            part = found.select(F.lit(name).alias("_t"), key_text(t.id_columns).alias("_k"), F.to_json(F.struct(*props), {"ignoreNullFields": "false"}).alias("node"))
            whole = part if whole is None else whole.unionByName(part)
        rows = rows if page is None else page[0]
        if whole is None:
            return rows.withColumn("node", F.lit(None).cast("string"))
        return rows.join(whole, (rows[table] == whole["_t"]) & (rows[key] == whole["_k"]), "left").drop("_t", "_k")

    # -- traversal

    def _roots(self, seeds: list[tuple[str, str]]) -> DataFrame:
        catalog = self.current.catalog
        rows = dict.fromkeys((catalog.ordinal(catalog.table(t).name), t, str(i)) for t, i in seeds)
        out = self.rows(list(rows), "ord int, table string, id string")
        missing = out.join(self.graph().nodes.select(F.col("label").alias("table"), "id"), ["table", "id"], "left_anti").head()
        if missing is not None:
            raise GraphError("node_not_found", f"there is no node {missing.table}:{missing.id}")
        return out

    def _steps(self, direction: str, edge_types: list[str] | None, pushed: list, tenant: str | None) -> DataFrame:
        g, catalog = self.graph(), self.current.catalog
        if edge_types:
            for t in edge_types:
                if t not in self.current.edge_types:
                    raise GraphError("semantic", f"unknown edge type {t}")
        allowed = fl.allowed_nodes(pushed, catalog, self.sources, g.nodes)
        tenanted = [t.name for t in catalog.tables.values() if t.tenant_column]
        return trv.adjacency(g.edges, g.nodes, direction, edge_types, allowed, tenanted, tenant or self.settings.tenant, {t: catalog.ordinal(t) for t in catalog.tables})

    def traverse(
        self, seed_table: str | list[str], seed_id: str | list[str], max_depth: int | None = None, edge_types: list[str] | None = None, direction: str = "any",
        node_tables: list[str] | None = None, filter: dict | str | None = None, tenant: str | None = None, strategy: str = "bfs", uniqueness: str = "node_global",
        include_start: bool = True, hydrate: bool | None = None, max_rows: int | None = 1000, row_offset: int = 0, max_nodes: int | None = None, max_frontier: int | None = None,
    ) -> DataFrame:
        """From one seed, or from lists of tables and ids."""
        several = not isinstance(seed_table, str)
        seeds = list(zip(seed_table, seed_id, strict=True)) if several else [(seed_table, seed_id)]
        if not seeds:
            raise GraphError("semantic", "traverse needs a start")
        rows = self._traversed(self._roots(seeds), len(seeds) > 1, max_depth, edge_types, direction, node_tables, filter, tenant, strategy, uniqueness, include_start, max_nodes, max_frontier, len({(t, str(i)) for t, i in seeds}))
        return self._page(rows, max_rows, row_offset, hydrate)

    def _traversed(self, roots: DataFrame, several: bool, max_depth: int | None, edge_types: list[str] | None, direction: str, node_tables: list[str] | None, filter: Any, tenant: str | None, strategy: str, uniqueness: str, include_start: bool, max_nodes: int | None = None, max_frontier: int | None = None, seeds: int | None = None) -> DataFrame:
        s, catalog = self.settings, self.current.catalog
        depth = s.default_max_depth if max_depth is None else max_depth
        nodes, front = max_nodes or s.max_nodes, max_frontier or s.max_frontier
        if direction not in ("any", "out", "in"):
            raise GraphError("semantic", f"unknown direction {direction}")
        if strategy not in ("bfs", "dfs"):
            raise GraphError("semantic", f"unknown strategy {strategy}")
        pushed, after = fl.split(fl.parse(filter), catalog)
        steps = self._steps(direction, edge_types, pushed, tenant)
        reached, capped = trv.bfs(roots, steps, depth, nodes, front, seeds=seeds)
        if strategy == "dfs":
            out = []
            for r in roots.collect():  # the seeds of the call
                ball = reached.where((F.col("root_table") == r.table) & (F.col("root_id") == r.id))
                rows, cut = trv.dfs((r.ord, r.table, r.id), ball, steps, depth, nodes, front)
                capped = capped or cut
                out += [(r.table, r.id, t, i, d, [tuple(p) for p in path], types) for t, i, d, path, types in rows]
            reached = self.rows(out, "root_table string, root_id string, node_table string, node_id string, depth int, path array<struct<ord:int,table:string,id:string>>, edge_path array<string>")
        rows = reached.withColumn("path", F.transform("path", lambda p: F.struct(p["table"].alias("table"), p["id"].alias("id")))).withColumn("capped", F.lit(capped))
        if not include_start:
            rows = rows.where("depth > 0")
        if node_tables is not None:
            rows = rows.where(F.col("node_table").isin(node_tables) if node_tables else F.lit(False))
        if after:
            ok = fl.after_rows(after, catalog, self.sources).select(F.col("label").alias("node_table"), F.col("id").alias("node_id"))
            rows = rows.join(ok, ["node_table", "node_id"], "left_semi")
        if several:
            rows = trv.unique_rows(rows, uniqueness, {t: catalog.ordinal(t) for t in catalog.tables})
        elif uniqueness not in ("node_global", "node_per_root"):
            raise GraphError("semantic", f"unknown uniqueness {uniqueness}")
        return rows.select("root_table", "root_id", "node_table", "node_id", "depth", "path", "edge_path", "capped")

    def _page(self, rows: DataFrame, max_rows: int | None, row_offset: int, hydrate: bool | None) -> DataFrame:
        order = ["root_table", "root_id", "depth", "node_table", "node_id"]
        out = rows.orderBy(*order)
        out = out.offset(row_offset) if row_offset else out
        out = _first(out, max_rows)
        hydrate = self.settings.default_hydrate if hydrate is None else hydrate
        out = self.hydrated(out).orderBy(*order) if hydrate else out.withColumn("node", F.lit(None).cast("string"))
        return out.select("root_table", "root_id", "node_table", "node_id", "depth", "path", "edge_path", "node", F.col("root_table").alias("root_table_name"), F.col("node_table").alias("node_table_name"), "capped")

    def traverse_search(
        self, property_key: str, property_value: str, table_filter: str | None = None, search_mode: str | None = None, case_sensitive: bool | None = None, search_max_rows: int = 100,
        search_row_offset: int = 0, max_depth: int | None = None, edge_types: list[str] | None = None, direction: str = "any", node_tables: list[str] | None = None, filter: Any = None,
        tenant: str | None = None, strategy: str = "bfs", uniqueness: str = "node_per_root", include_start: bool = True, hydrate: bool | None = None, max_rows: int | None = 1000, row_offset: int = 0,
    ) -> DataFrame:
        self.graph()
        seeds = self._found(property_key, property_value, table_filter, search_mode, case_sensitive, search_max_rows, search_row_offset, tenant)
        roots = seeds.select("ord", F.col("node_table").alias("table"), F.col("node_id").alias("id"))
        rows = self._traversed(roots, True, max_depth, edge_types, direction, node_tables, filter, tenant, strategy, uniqueness, include_start)
        return self._page(rows, max_rows, row_offset, hydrate)

    def get_node(self, graph_name: str, label: str, id: str, hydrate: bool = True, tenant: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        t = g.catalog.table(label)
        df = self.sources[label].df.where(key_text(t.id_columns) == str(id))
        tenant = tenant or self.settings.tenant
        if tenant is not None and t.tenant_column:
            df = df.where(F.col(t.tenant_column).cast("string") == tenant)
        node = F.to_json(F.struct(*g.catalog.properties(label, df)), {"ignoreNullFields": "false"}) if hydrate else F.lit(None).cast("string")
        return df.select(F.lit(g.id).alias("graph_id"), F.lit(g.name).alias("graph_name"), F.lit(label).alias("node_table"), F.lit(label).alias("node_table_name"), key_text(t.id_columns).alias("node_id"), F.lit(None).cast("bigint").alias("node_idx"), node.alias("node"))

    def get_neighbors(self, graph_name: str, label: str, id: str, direction: str = "any", edge_types: list[str] | None = None, tenant: str | None = None, hydrate: bool = True, max_rows: int | None = 1000, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        self.find_graph(graph_name, graph_tenant, graph_namespace)
        return self.traverse(label, id, 1, edge_types, direction, tenant=tenant, include_start=False, hydrate=hydrate, max_rows=max_rows)

    # -- paths

    def shortest_path(self, source_table: str, source_id: str, target_table: str, target_id: str, max_depth: int = 20, hydrate: bool = True) -> DataFrame:
        roots = self._roots([(source_table, source_id)])
        self._roots([(target_table, target_id)])
        found = pth.shortest_path(roots, self._steps("any", None, [], None), (target_table, str(target_id)), max_depth)
        out = self.rows([(k, t, i, e) for k, (t, i, e) in enumerate(found)], "step int, node_table string, node_id string, edge_label string")
        out = self.hydrated(out).orderBy("step") if hydrate else out.withColumn("node", F.lit(None).cast("string"))
        return out.select("step", "node_table", "node_id", "edge_label", "node", F.col("node_table").alias("node_table_name"))

    def weighted_shortest_path(self, source_table: str, source_id: str, target_table: str, target_id: str) -> DataFrame:
        self._roots([(source_table, source_id), (target_table, target_id)])
        g = self.graph()
        rows: list[tuple] = []
        if self.current.pending_edges:
            raise GraphError("unsupported_operation", "weighted paths need a graph without pending edge changes")
        if g.weighted:
            if self.current.cheapest is None:
                scoped = self.settings.tenant is not None and any(t.tenant_column for t in self.current.catalog.tables.values())
                self.current.cheapest = pth.weighted_steps(self._steps("out", None, [], None), None if scoped else g.parts)
            total = 0
            for k, (t, i, e, w) in enumerate(pth.cheapest_path((source_table, str(source_id)), (target_table, str(target_id)), *self.current.cheapest)):
                total += w
                rows.append((k, t, t, i, e, w if k else None, w, total))
        return self.rows(rows, "step int, node_table string, node_table_name string, node_id string, edge_label string, edge_weight long, step_cost long, total_cost long")

    def path(self, source_table: str, source_id: str, target_table: str, target_id: str, max_depth: int = 20) -> DataFrame:
        found = self.shortest_path(source_table, source_id, target_table, target_id, max_depth)
        steps = found.collect()
        text = format_path([(r.node_table, r.node_id) for r in steps], [r.edge_label for r in steps[1:]]) if steps else None
        return found.select("step", "node_table", "node_table_name", "node_id", "edge_label", F.lit(text).alias("readable_path"), "node")

    # -- components

    def _components(self) -> DataFrame:
        g = self.current
        graph = self.graph()
        if g.components is None:
            g.components = comp.connected_components(graph.nodes, graph.edges).persist()
        return g.components

    def connected_components(self) -> DataFrame:
        return self._components().select("node_table", "node_id", "component_id", "component_size")

    def component_stats(self) -> DataFrame:
        sizes = self._components().groupBy("component_id").agg(F.first("component_size").alias("s"))
        return sizes.agg(F.count("*").cast("int").alias("num_components"), F.coalesce(F.max("s"), F.lit(0)).alias("largest_component"), F.count_if(F.col("s") == 1).cast("int").alias("num_isolated_nodes"), F.coalesce(F.sum("s"), F.lit(0)).cast("int").alias("total_active_nodes"))

    def components(self, max_rows: int = 100, row_offset: int = 0) -> DataFrame:
        out = self._components().groupBy("component_id").agg(F.first("component_size").cast("bigint").alias("component_size")).orderBy(F.desc("component_size"), "component_id").offset(row_offset).limit(max_rows)
        from pyspark.sql import Window

        return out.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("component_size"), "component_id")) + row_offset).cast("int"))  # of one page

    def _members(self, rows: DataFrame, order: list[str], max_rows: int | None, row_offset: int, hydrate: bool) -> DataFrame:
        out = _first(rows.orderBy(*order).offset(row_offset), max_rows)
        out = self.hydrated(out).orderBy(*order) if hydrate else out.withColumn("node", F.lit(None).cast("string"))
        return out.select("component_id", "node_table", "node_id", "node")

    def largest_component(self, max_rows: int | None = 100, row_offset: int = 0, hydrate: bool = True) -> DataFrame:
        first = self.components(1).head()
        return self.component(-1 if first is None else first.component_id, max_rows, row_offset, hydrate)

    def component(self, component_id: int, max_rows: int | None = 100, row_offset: int = 0, hydrate: bool = True) -> DataFrame:
        return self._members(self._components().where(F.col("component_id") == component_id), ["ord", "node_id"], max_rows, row_offset, hydrate)

    def isolated_nodes(self, max_rows: int | None = 100, row_offset: int = 0, hydrate: bool = True) -> DataFrame:
        return self._members(self._components().where("component_size = 1"), ["component_id", "ord", "node_id"], max_rows, row_offset, hydrate)

    # -- aggregation

    def _traversal(self, traversal: dict | str) -> dict:
        t = json.loads(traversal) if isinstance(traversal, str) else dict(traversal)
        known = {"starts", "start", "min_depth", "max_depth", "direction", "edge_types", "node_tables", "filter", "tenant"}
        if extra := set(t) - known:
            raise GraphError("semantic", f"unknown keys {sorted(extra)}")
        starts = t.get("starts") or ([t["start"]] if t.get("start") else [])
        if not starts:
            raise GraphError("semantic", "a traversal needs starts")
        t["starts"] = [node_ref(s) for s in starts]
        return t

    def _walk(self, t: dict) -> tuple[DataFrame, DataFrame, int, int]:
        pushed, after = fl.split(fl.parse(t.get("filter")), self.current.catalog)
        steps = self._steps(t.get("direction", "out"), t.get("edge_types") or None, pushed, t.get("tenant"))
        low, high = int(t.get("min_depth", 0)), int(t.get("max_depth", self.settings.default_max_depth))
        t["after"] = after
        return self._roots(t["starts"]), steps, low, high

    def _kept(self, rows: DataFrame, t: dict) -> DataFrame:
        if t.get("node_tables"):
            rows = rows.where(F.col("node_table").isin(list(t["node_tables"])))
        if t["after"]:
            ok = fl.after_rows(t["after"], self.current.catalog, self.sources).select(F.col("label").alias("node_table"), F.col("id").alias("node_id"))
            rows = rows.join(ok, ["node_table", "node_id"], "left_semi")
        return rows

    def aggregate(self, traversal: dict | str, aggregations: Any, scope: str = "returned_nodes", path_limit: int | None = None) -> dict:
        t, wanted = self._traversal(traversal), agg.specs(json.loads(aggregations) if isinstance(aggregations, str) else aggregations)
        if scope not in agg.SCOPES:
            raise GraphError("semantic", f"unknown scope {scope}")
        roots, steps, low, high = self._walk(t)
        if scope == "all_possible_paths":
            limit = path_limit or self.settings.max_exact_path_count
            found = self._kept(self._ends(pth.simple_paths(roots, steps, low, high, limit)), t)
            if limit is not None and found.limit(limit + 1).count() > limit:
                raise GraphError("resource_limit", f"more than {limit} paths")
            nodes = found.select(F.explode("path").alias("n")).select(F.col("n.table").alias("node_table"), F.col("n.id").alias("node_id"))
        else:
            rows, _ = trv.bfs(roots, steps, high, self.settings.max_nodes, self.settings.max_frontier)
            rows = self._kept(rows.where(F.col("depth") >= low), t)
            nodes = rows.select("node_table", "node_id") if scope == "returned_nodes" else rows.select(F.explode("path").alias("n")).select(F.col("n.table").alias("node_table"), F.col("n.id").alias("node_id"))
        return agg.aggregated(nodes, wanted, self.current.catalog, self.sources)

    @staticmethod
    def _ends(paths: DataFrame) -> DataFrame:
        end = F.element_at("path", -1)
        return paths.withColumns({"node_table": end["table"], "node_id": end["id"]})

    def path_count_estimate(self, traversal: dict | str) -> DataFrame:
        t = self._traversal(traversal)
        roots, steps, low, high = self._walk(t)
        cap = self.settings.max_exact_path_count
        found = self._kept(self._ends(pth.simple_paths(roots, steps, low, high, cap)), t)
        if cap is None:
            return self.rows([(found.count(), True, False)], "estimated_paths long, exact boolean, capped boolean")
        n = found.limit(cap + 1).count()
        return self.rows([(min(n, cap), n <= cap, n > cap)], "estimated_paths long, exact boolean, capped boolean")

    # -- pattern queries

    def planner(self, params: dict | str | None = None, hydrate: bool = True) -> Planner:
        self.check_enabled()
        g = self.current
        params = json.loads(params) if isinstance(params, str) else params
        if g.graph is not None:
            self.graph()
        return Planner(g.catalog, self.sources, g.graph, params, self.settings.tenant, self.settings.strict_comparisons, hydrate)

    def gql_df(self, query: str, params: dict | str | None = None, hydrate: bool = True) -> DataFrame:
        """The rows of a statement as typed columns."""
        statement = parse(query)
        self.require(self.current, "write" if isinstance(statement, Write) else "read")
        p = self.planner(params, hydrate)
        if isinstance(statement, Write):
            return self._written(statement, p)
        out = p.read(statement)
        if (cap := self.settings.row_cap) is not None and statement.returns.limit is None and out.limit(cap + 1).count() > cap:
            raise GraphError("resource_limit", f"more than {cap} rows")
        return out

    def gql(self, query: str, params: dict | str | None = None, hydrate: bool = True) -> DataFrame:
        """The rows of a statement, each as one JSON object."""
        out = self.gql_df(query, params, hydrate)
        return out.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in out.columns)), {"ignoreNullFields": "false"}).alias("row"))

    def gql_explain(self, query: str) -> str:
        self.check_enabled()
        return explain(query, self.current.catalog)

    def cypher(self, query: str, params: dict | str | None = None, hydrate: bool = True) -> DataFrame:
        compatible(query)
        return self.gql(query, params, hydrate)

    def cypher_explain(self, query: str) -> str:
        compatible(query)
        return self.gql_explain(query)

    def cypher_compatibility(self) -> DataFrame:
        return self.rows(list(COMPATIBILITY), "feature string, status string, notes string")

    def pgq(self, _query: str) -> None:
        raise GraphError("unsupported_operation", "SQL/PGQ is not supported")

    def _written(self, statement: Write, p: Planner) -> DataFrame:
        if self.current.projection_mode != "mutable_overlay":
            raise GraphError("read_only", "writes need the projection mode mutable_overlay")
        writer = Writer(p, self.settings.tenant)
        out = writer.run(statement, self.overlay)
        self.sources = writer.sources
        self.current.touched()
        if self.overlay.added_nodes > self.settings.max_tx_delta_nodes or self.overlay.added_edges > self.settings.max_tx_delta_edges:
            raise GraphError("overlay_limit", "the overlay is full")
        return out

    def savepoint(self, name: str) -> None:
        self.overlay.saved[name] = dict(self.sources)

    def rollback_to(self, name: str) -> None:
        if name not in self.overlay.saved:
            raise GraphError("semantic", f"unknown savepoint {name}")
        self.sources = dict(self.overlay.saved[name])
        self.current.touched()

    # -- workflows

    def find(self, property_key: str, property_value: str, table_name: str | None = None, mode: str = "contains", case_sensitive: bool = False, max_rows: int | None = 20, row_offset: int = 0, tenant: str | None = None) -> DataFrame:
        rows = self.search(property_key, property_value, table_name, mode, case_sensitive, max_rows, row_offset, tenant, True)
        return self._ranked(rows, ["node_table", "node_id"], row_offset, max_rows).select("node_table", "node_table_name", "node_id", "match_type", "score", "verified", "rank", "node")

    @staticmethod
    def _ranked(rows: DataFrame, order: list, row_offset: int, max_rows: int | None) -> DataFrame:
        """Numbers rows from 1: a page of bounded size in one task, all rows through a range shuffle."""
        from pyspark.sql import Window

        if max_rows is None:
            rows = comp.placed(rows, order, "rank")
            return rows.withColumn("rank", (F.col("rank") + 1 + row_offset).cast("int"))
        return rows.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) + row_offset).cast("int"))

    def expand(self, seed_table: str, seed_id: str, max_depth: int | None = None, edge_types: list[str] | None = None, direction: str = "any", target_table: str | None = None, target_tables: list[str] | None = None, where_node: Any = None, tenant: str | None = None, max_rows: int | None = 50, row_offset: int = 0, include_start: bool = False) -> DataFrame:
        tables = self._targets(target_table, target_tables)
        rows = self.traverse(seed_table, seed_id, max_depth, edge_types, direction, tables, where_node, tenant, include_start=include_start, max_rows=max_rows, row_offset=row_offset, hydrate=True).persist()
        full = rows.count() == max_rows
        out = self._ranked(rows, ["root_table", "root_id", "depth", "node_table", "node_id"], row_offset, max_rows)
        return out.select("root_table", "root_id", "root_table_name", "node_table", "node_table_name", "node_id", "depth", "rank", "path", "edge_path", format_path_column(F.col("path"), F.col("edge_path")).alias("readable_path"), "node", F.lit(full).alias("truncated"))

    @staticmethod
    def _targets(one: str | None, many: list[str] | None) -> list[str] | None:
        if one is None:
            return many
        return [one, *(many or [])]

    def find_related(
        self, property_key: str, property_value: str, source_table: str | None = None, search_mode: str | None = None, case_sensitive: bool | None = None, search_max_rows: int = 1, search_row_offset: int = 0,
        max_depth: int | None = None, edge_types: list[str] | None = None, direction: str = "any", target_table: str | None = None, target_tables: list[str] | None = None, where_node: Any = None, tenant: str | None = None,
        max_rows: int | None = 20, row_offset: int = 0, include_counts: bool = False, candidate_limit: int | None = 10_000, include_start: bool = False,
    ) -> DataFrame:
        tables = self._targets(target_table, target_tables)
        rows = self.traverse_search(property_key, property_value, source_table, search_mode, case_sensitive, search_max_rows, search_row_offset, max_depth, edge_types, direction, None, None, tenant, "bfs", "node_per_root", include_start, False, candidate_limit, 0).drop("node").persist()
        n = rows.count()
        capped = n > 0 and not rows.where("capped").isEmpty()
        kept = rows if tables is None else rows.where(F.col("node_table").isin(tables))
        pushed, after = fl.split(fl.parse(where_node), self.current.catalog)
        for ok in ([fl.allowed_nodes(pushed, self.current.catalog, self.sources, self.graph().nodes)] if pushed else []) + ([fl.after_rows(after, self.current.catalog, self.sources)] if after else []):
            kept = kept.join(ok.select(F.col("label").alias("node_table"), F.col("id").alias("node_id")), ["node_table", "node_id"], "left_semi")
        total = kept.count() if include_counts else None
        order = ["root_table", "root_id", "depth", "node_table", "node_id"]
        page = self.hydrated(_first(kept.orderBy(*order).offset(row_offset), max_rows))
        return self._ranked(page, order, row_offset, max_rows).select(
            "root_table", "root_id", "root_table_name", "node_table", "node_table_name", "node_id", "depth", F.lit(1.0).cast("float").alias("score"), "rank", "path", "edge_path",
            format_path_column(F.col("path"), F.col("edge_path")).alias("readable_path"), "node", F.lit(n if include_counts else None).cast("bigint").alias("candidate_count"), F.lit(total).cast("bigint").alias("filtered_count"), F.lit(n == candidate_limit or capped).alias("truncated"),
        )

    def connection(self, source_key: str, source_value: str, target_key: str, target_value: str, source_table: str | None = None, target_table: str | None = None, source_k: int = 3, target_k: int = 3, search_mode: str = "contains", max_depth: int = 6) -> DataFrame:
        """The first reachable pair in search order, not the nearest one."""
        ends = [[(r.node_table, r.node_id) for r in self.search_nodes(k, v, t, search_mode, False, n).collect()] for k, v, t, n in ((source_key, source_value, source_table, source_k), (target_key, target_value, target_table, target_k))]
        schema = "source_table_name string, source_id string, target_table_name string, target_id string, hop_count int, step int, node_table string, node_table_name string, node_id string, edge_label string, readable_path string, node string"
        steps = self._steps("any", None, [], None)
        for a in ends[0]:
            for b in ends[1]:
                found = pth.shortest_path(self._roots([a]), steps, b, max_depth)
                if found:
                    text = format_path([(t, i) for t, i, _ in found], [e for _, _, e in found[1:]])
                    rows = self.rows([(*a, *b, len(found) - 1, k, t, t, i, e, text) for k, (t, i, e) in enumerate(found)], schema.rpartition(",")[0])
                    return self.hydrated(rows).orderBy("step").select(*(c.split()[0] for c in schema.split(", ")))
        return self.rows([], schema)

    def neighborhood(self, property_key: str, property_value: str, source_table: str | None = None, search_mode: str = "contains", search_max_rows: int = 1, max_depth: int = 4, edge_types: list[str] | None = None, direction: str = "any", tenant: str | None = None, sample_k: int = 5, node_limit: int | None = 10_000) -> DataFrame:
        rows = self.traverse_search(property_key, property_value, source_table, search_mode, False, search_max_rows, 0, max_depth, edge_types, direction, None, None, tenant, "bfs", "node_global", True, False, node_limit, 0).drop("node").persist()
        cut = rows.count() == node_limit or not rows.where("capped").isEmpty()
        # The page is bounded by node_limit, and so is each list.
        out = rows.groupBy("depth", "node_table").agg(F.count("*").alias("node_count"), F.to_json(F.slice(F.sort_array(F.collect_list("node_id")), 1, sample_k)).alias("sample_nodes"))
        return out.select("depth", "node_table", F.col("node_table").alias("node_table_name"), "node_count", "sample_nodes", F.lit(cut).alias("truncated")).orderBy("depth", "node_table")

    # -- helpers

    def rows(self, rows: list, schema: str) -> DataFrame:
        """A local table; through Arrow the planner knows its size and may broadcast it."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        types = StructType.fromDDL(schema)
        if not rows or any(t.typeName() in ("timestamp", "struct") for t in (f.dataType for f in types)):
            return self.spark.createDataFrame(rows, types)
        arrow = to_arrow_schema(types)
        columns = zip(*rows, strict=True)
        return self.spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow), types)

    @staticmethod
    def new_id() -> str:
        return uuid.uuid4().hex

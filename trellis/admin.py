"""Named graphs, maintenance, change sync, generations, jobs and status."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.catalog import KINDS, MATERIALIZATIONS, PROJECTION_MODES, RESIDENCIES, Catalog, key_text
from trellis.errors import GraphError
from trellis.operators.build import EDGE_SCHEMA, NODE_SCHEMA, Graph, node_rows, resolved_edges
from trellis.sources.snapshot import Manifest, Store
from trellis.sources.storage import shared_folder
from trellis.streaming import sync

GRAPH = "graph_id string, graph_name string, owner_role string, created_by string, tenant string, namespace string, graph_kind string, residency string, materialization string, projection_mode string, created_at timestamp, updated_at timestamp"
PRIVILEGES = ("read", "write", "build", "admin", "owner")
#: The grants that give a privilege.
GIVEN_BY = {"read": set(PRIVILEGES), "write": {"write", "admin", "owner"}, "build": {"build", "admin", "owner"}, "admin": {"admin", "owner"}}
QUOTA_SCOPES = ("global", "tenant", "graph", "role")
QUOTA_DIMENSIONS = ("graphs", "nodes", "edges", "memory_mb", "disk_mb")
BUILD = "nodes_loaded long, edges_loaded long, build_time_ms double, memory_used_mb double, sync_mode string, projection_mode string"
GRANT = "graph_id string, graph_name string, grantee string, privilege string, grantor string, created_at timestamp, updated_at timestamp"
QUOTA = "scope_type string, scope_key string, dimension string, limit_value long, enforcement string, updated_by string, created_at timestamp, updated_at timestamp"
POLICY = "policy_id string, job_id string, graph_id string, graph_name string, enabled boolean, schedule_interval_secs long, max_sync_lag_rows long, next_run_at timestamp, last_status string"
RUN = "job_id string, run_id string, graph_id string, graph_name string, policy_kind string, status string, rows_applied long, error string, started_at timestamp, finished_at timestamp"
BUILD_STATUS = "build_id string, graph_id string, graph_name string, status string, nodes_loaded long, edges_loaded long, build_time_ms double, memory_used_mb double, sync_mode string, projection_mode string, progress_phase string, progress_message string, started_at timestamp, finished_at timestamp, error string"
MAINTENANCE_STATUS = "job_id string, graph_id string, graph_name string, status string, sync_rows_applied long, nodes_after long, edges_after long, vacuum_time_ms double, progress_phase string, progress_message string, started_at timestamp, finished_at timestamp, error string"


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class GraphEntry:
    """A named graph: its catalog, and its topology if it is built."""

    id: str
    name: str
    owner: str
    tenant: str | None = None
    namespace: str | None = None
    kind: str = "user"
    residency: str = "hot"
    materialization: str = "shared"
    projection_mode: str = "csr_readonly"
    created: datetime = field(default_factory=now)
    updated: datetime = field(default_factory=now)
    catalog: Catalog = field(default_factory=Catalog)
    graph: Graph | None = None
    components: DataFrame | None = None
    cheapest: tuple[list, int] | None = None
    edge_types: list[str] = field(default_factory=list)
    node_count: int = 0
    edge_count: int = 0
    build_ms: float = 0.0
    last_build: datetime | None = None
    last_vacuum: datetime | None = None
    needs_rebuild: bool = False
    stale: bool = False
    applied: int = 0
    pending_edges: int = 0
    log: DataFrame | None = None
    log_path: str | None = None
    manifest: Manifest | None = None
    access: int = 0

    def changed(self) -> None:
        self.needs_rebuild, self.updated = True, now()

    def touched(self) -> None:
        self.stale, self.components, self.cheapest = self.graph is not None, None, None

    def built(self, graph: Graph, types: list[str], ms: float) -> None:
        self.graph, self.edge_types, self.build_ms = graph, types, ms
        self.needs_rebuild = self.stale = False
        self.components, self.cheapest, self.last_build, self.pending_edges = None, None, now(), 0

    def row(self) -> tuple:
        return (self.id, self.name, self.owner, self.owner, self.tenant, self.namespace, self.kind, self.residency, self.materialization, self.projection_mode, self.created, self.updated)


class Admin:
    """What a session adds around its queries; state lives on the driver."""

    def start_admin(self) -> None:
        self.user = self.host_user = self.spark.sparkContext.sparkUser()
        first = GraphEntry(self.new_id(), "default", self.user, projection_mode=self.settings.default_projection_mode)
        self.graphs: list[GraphEntry] = [first]
        self.current: GraphEntry = first
        self.grants: list[list] = []
        self.quotas: list[list] = []
        self.job_rows: dict[str, dict] = {}
        self.run_rows: list[dict] = []
        self.builds: dict[str, dict] = {}
        self.upkeep: dict[str, dict] = {}
        self.last_operation: tuple = (None, None, None)
        self.pool = ThreadPoolExecutor(2, "trellis")
        self.lock = threading.RLock()

    def check_enabled(self) -> None:
        if not self.settings.enabled:
            raise GraphError("disabled", "graphs are disabled")

    # -- named graphs

    def find_graph(self, name: str, tenant: str | None = None, namespace: str | None = None) -> GraphEntry:
        for g in self.graphs:
            if (g.name, g.tenant, g.namespace) == (name, tenant, namespace):
                return g
        raise GraphError("semantic", f"unknown graph {name}")

    def _one(self, g: GraphEntry) -> DataFrame:
        return self.rows([g.row()], GRAPH)

    @staticmethod
    def _vocabulary(**words: tuple[str | None, tuple[str, ...]]) -> None:
        for what, (value, allowed) in words.items():
            if value is not None and value not in allowed:
                raise GraphError("semantic", f"{what} can't be {value}")

    def create_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None, graph_kind: str = "user", residency: str = "hot", materialization: str = "shared", projection_mode: str = "csr_readonly") -> DataFrame:
        self._vocabulary(graph_kind=(graph_kind, KINDS), residency=(residency, RESIDENCIES), materialization=(materialization, MATERIALIZATIONS), projection_mode=(projection_mode, PROJECTION_MODES))
        if any((g.name, g.tenant, g.namespace) == (graph_name, tenant, namespace) for g in self.graphs):
            raise GraphError("semantic", f"graph {graph_name} exists")
        for scope, key, dimension, limit, enforcement, *_ in self.quotas:
            if dimension == "graphs" and enforcement == "hard" and scope in ("global", "tenant") and (scope == "global" or key == tenant):
                have = len(self.graphs) if scope == "global" else sum(g.tenant == tenant for g in self.graphs)
                if have >= limit:
                    raise GraphError("resource_limit", f"the quota of {limit} graphs is used up")
        g = GraphEntry(self.new_id(), graph_name, self.user, tenant, namespace, graph_kind, residency, materialization, projection_mode)
        self.graphs.append(g)
        return self._one(g)

    def alter_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None, graph_kind: str | None = None, residency: str | None = None, materialization: str | None = None, projection_mode: str | None = None) -> DataFrame:
        self._vocabulary(graph_kind=(graph_kind, KINDS), residency=(residency, RESIDENCIES), materialization=(materialization, MATERIALIZATIONS), projection_mode=(projection_mode, PROJECTION_MODES))
        g = self.find_graph(graph_name, tenant, namespace)
        self.require(g, "admin")
        g.kind, g.residency = graph_kind or g.kind, residency or g.residency
        g.materialization, g.projection_mode = materialization or g.materialization, projection_mode or g.projection_mode
        g.updated = now()
        return self._one(g)

    def drop_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, tenant, namespace)
        self.require(g, "admin")
        self.graphs.remove(g)
        if g.graph is not None:
            g.graph.unpersist()
        if self.current is g:
            self.current = self.graphs[0] if self.graphs else GraphEntry(self.new_id(), "default", self.user)
        self.grants = [x for x in self.grants if x[0] != g.id]
        return self._one(g)

    def list_graphs(self) -> DataFrame:
        return self.rows([g.row() for g in sorted(self.graphs, key=lambda g: (g.name, g.tenant or "", g.namespace or ""))], GRAPH)

    def current_graph(self) -> DataFrame:
        return self._one(self.current)

    def set_current_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        self.current = self.find_graph(graph_name, tenant, namespace)
        return self._one(self.current)

    def select_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        self.current = self.find_graph(graph_name, tenant, namespace)
        if self.current.graph is None and self.settings.auto_load and self.current.manifest is not None:
            self._load(self.current)
        return self.rows([(self.current.id, self.current.name, self.current.graph is not None)], "graph_id string, graph_name string, loaded boolean")

    def _load(self, g: GraphEntry) -> None:
        made = self.store(g).read()
        if g.residency == "hot":
            made.nodes, made.edges = made.nodes.persist(), made.edges.persist()
        g.node_count, g.edge_count = made.nodes.count(), made.edges.count()
        g.built(made, [r.type for r in made.edges.select("type").distinct().limit(256).collect()], 0.0)
        g.access = time.time_ns() // 1000

    def load_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, tenant, namespace)
        if g.graph is None:
            self._load(g)
        return self.rows([(g.id, g.name, True, g.node_count, g.edge_count, None, g.projection_mode)], "graph_id string, graph_name string, loaded boolean, node_count long, edge_count long, memory_used_mb double, projection_mode string")

    def unload_graph(self, graph_name: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, tenant, namespace)
        was = g.graph is not None
        if was:
            g.graph.unpersist()
            g.graph = g.components = None
        return self.rows([(g.id, g.name, was)], "graph_id string, graph_name string, unloaded boolean")

    def loaded_graphs(self) -> DataFrame:
        rows = [(g.id, g.name, g.residency, g.node_count, g.edge_count, None, g.projection_mode, g.access) for g in self.graphs if g.graph is not None]
        return self.rows(rows, "graph_id string, graph_name string, residency string, node_count long, edge_count long, memory_used_mb double, projection_mode string, last_access_unix_micros long")

    def graph_runtime_status(self) -> DataFrame:
        rows = []
        for g in self.graphs:
            size = self.store(g).size(g.manifest.base) if g.manifest else 0
            rows.append((g.id, g.name, g.residency, g.graph is not None, g.manifest is not None, size, g.node_count, g.edge_count, None, g.projection_mode, g.access))
        return self.rows(rows, "graph_id string, graph_name string, residency string, loaded boolean, artifact_exists boolean, artifact_bytes long, node_count long, edge_count long, memory_used_mb double, projection_mode string, last_access_unix_micros long")

    def set_graph_residency(self, graph_name: str, residency: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        return self.alter_graph(graph_name, tenant, namespace, residency=residency)

    def set_mode(self, g: GraphEntry, mode: str) -> None:
        self._vocabulary(projection_mode=(mode, PROJECTION_MODES))
        g.projection_mode = mode

    # -- grants and quotas

    def act_as(self, user: str) -> None:
        """Whose privileges count from here on; the session's own user has all."""
        self.user = user

    def require(self, g: GraphEntry, privilege: str) -> None:
        if self.user in (self.host_user, g.owner):
            return
        if not GIVEN_BY[privilege] & {x[3] for x in self.grants if (x[0], x[2]) == (g.id, self.user)}:
            raise GraphError("access_denied", f"{self.user} may not {privilege} graph {g.name}")

    def check_quotas(self, g: GraphEntry) -> None:
        """Hard quotas of nodes and edges, over all graphs, a tenant's, a role's or one."""
        for scope, key, dimension, limit, enforcement, *_ in self.quotas:
            if enforcement == "hard" and dimension in ("nodes", "edges"):
                here = [x for x in self.graphs if scope == "global" or (scope == "tenant" and x.tenant == key) or (scope == "graph" and key in (x.name, x.id)) or (scope == "role" and x.owner == key)]
                if g in here and sum(x.node_count if dimension == "nodes" else x.edge_count for x in here) > limit:
                    raise GraphError("resource_limit", f"the quota of {limit} {dimension} is used up")

    def grant_graph(self, graph_name: str, grantee: str, privilege: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        self._vocabulary(privilege=(privilege, PRIVILEGES))
        g = self.find_graph(graph_name, tenant, namespace)
        self.require(g, "admin")
        self.grants = [x for x in self.grants if (x[0], x[2], x[3]) != (g.id, grantee, privilege)]
        self.grants.append([g.id, g.name, grantee, privilege, self.user, now(), now()])
        return self.rows([tuple(self.grants[-1])], GRANT)

    def revoke_graph(self, graph_name: str, grantee: str, privilege: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, tenant, namespace)
        self.require(g, "admin")
        gone = [x for x in self.grants if (x[0], x[2], x[3]) == (g.id, grantee, privilege)]
        self.grants = [x for x in self.grants if x not in gone]
        return self.rows([tuple(x) for x in gone], GRANT)

    def graph_privileges(self, graph_name: str | None = None, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        only = None if graph_name is None else self.find_graph(graph_name, tenant, namespace).id
        return self.rows([tuple(x) for x in self.grants if only in (None, x[0])], GRANT)

    def transfer_graph_ownership(self, graph_name: str, new_owner: str, tenant: str | None = None, namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, tenant, namespace)
        self.require(g, "admin")
        g.owner, g.updated = new_owner, now()
        return self._one(g)

    def set_graph_quota(self, scope_type: str, dimension: str, limit_value: int, scope_key: str | None = None, enforcement: str = "hard") -> DataFrame:
        self._vocabulary(scope_type=(scope_type, QUOTA_SCOPES), dimension=(dimension, QUOTA_DIMENSIONS), enforcement=(enforcement, ("hard", "soft")))
        self.quotas = [q for q in self.quotas if tuple(q[:3]) != (scope_type, scope_key, dimension)]
        self.quotas.append([scope_type, scope_key, dimension, limit_value, enforcement, self.user, now(), now()])
        return self.rows([tuple(self.quotas[-1])], QUOTA)

    def graph_quotas(self) -> DataFrame:
        return self.rows([tuple(q) for q in self.quotas], QUOTA)

    def graph_quota_usage(self) -> DataFrame:
        rows = []
        for scope, key, dimension, limit, enforcement, *_ in self.quotas:
            here = [g for g in self.graphs if scope == "global" or (scope == "tenant" and g.tenant == key) or (scope == "graph" and key in (g.name, g.id)) or (scope == "role" and g.owner == key)]
            used = {"graphs": len(here), "nodes": sum(g.node_count for g in here), "edges": sum(g.edge_count for g in here)}.get(dimension, 0)
            rows.append((scope, key, dimension, limit, used, enforcement, used > limit))
        return self.rows(rows, "scope_type string, scope_key string, dimension string, limit_value long, usage_value long, enforcement string, exceeded boolean")

    # -- builds

    def build_row(self, g: GraphEntry) -> DataFrame:
        return self.rows([(g.node_count, g.edge_count, g.build_ms, None, self.settings.sync_mode, g.projection_mode)], BUILD)

    def _job(self, g: GraphEntry, table: dict[str, dict], work, concurrently: bool) -> dict:
        job = {"id": self.new_id(), "graph": g, "status": "queued", "phase": None, "started": now(), "finished": None, "error": None}
        table[job["id"]] = job

        def run() -> None:
            job["status"] = "running"
            try:
                with self.lock:
                    work(job)
                job["status"] = "completed"
            except Exception as e:
                job["status"], job["error"] = "failed", str(e)
                if not concurrently:
                    raise
            finally:
                job["finished"] = now()

        if concurrently:
            job["future"] = self.pool.submit(run)
        else:
            run()
        return job

    def build_job(self, g: GraphEntry, concurrently: bool) -> DataFrame:
        job = self._job(g, self.builds, lambda job: self._build(g), concurrently)
        return self._build_rows([job]).select("build_id", "status", "nodes_loaded", "edges_loaded", "build_time_ms", "memory_used_mb", "sync_mode", "projection_mode")

    def build_async_graph(self, graph_name: str, projection_mode: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        if projection_mode is not None:
            self.set_mode(g, projection_mode)
        job = self._job(g, self.builds, lambda job: self._build(g), True)
        return self._build_rows([job]).drop("progress_phase", "progress_message", "started_at", "finished_at", "error")

    def _build_rows(self, jobs: list[dict]) -> DataFrame:
        rows = []
        for j in jobs:
            g, done = j["graph"], j["status"] == "completed"
            rows.append((j["id"], g.id, g.name, j["status"], g.node_count if done else None, g.edge_count if done else None, g.build_ms if done else None, None, self.settings.sync_mode, g.projection_mode, j["phase"], None, j["started"], j["finished"], j["error"]))
        return self.rows(rows, BUILD_STATUS)

    def build_status(self, build_id: str) -> DataFrame:
        found = [self.builds[build_id]] if build_id in self.builds else []
        return self._build_rows(found).drop("graph_id", "graph_name", "sync_mode", "projection_mode")

    def build_status_for_graph(self, graph_name: str, graph_tenant: str | None = None, graph_namespace: str | None = None, max_rows: int = 50) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        return self._build_rows([j for j in reversed(self.builds.values()) if j["graph"] is g][:max_rows])

    def wait(self, timeout: float | None = None) -> None:
        """Until all background jobs have ended."""
        for j in (*self.builds.values(), *self.upkeep.values()):
            if "future" in j:
                j["future"].result(timeout)

    def estimate(self) -> DataFrame:
        c = self.current.catalog
        nodes = sum(self.sources[t].df.count() for t in c.tables)
        edges = sum(self.sources[e.from_table].df.count() * (2 if e.bidirectional else 1) for e in c.edges)
        mb = (nodes * 96 + edges * 64) / 1e6
        return self.rows([(nodes, edges, mb, self.settings.memory_limit_mb, mb <= self.settings.memory_limit_mb)], "estimated_nodes long, estimated_edges long, estimated_memory_mb double, memory_limit_mb int, fits_in_memory boolean")

    def build_resource_status(self) -> DataFrame:
        used = self._memory_mb()[1] * 1e6
        return self.rows([(self.settings.maintenance_memory_mb * 1_000_000, int(used), "built" if self.current.graph else None, 0)], "budget_bytes long, peak_bytes long, peak_phase string, pressure_events long")

    # -- change sync

    def enable_sync(self, log: DataFrame | None = None, path: str | None = None) -> None:
        """Attaches a change log, a DataFrame or a folder of Parquet files, to the graph."""
        self.settings.sync_mode = "trigger"
        self.current.log, self.current.log_path = log, path
        if log is None and path is None:
            self.current.log = self.rows([], sync.LOG_SCHEMA)

    def _log(self, g: GraphEntry) -> DataFrame | None:
        if g.log_path is not None:
            return self.spark.read.schema(sync.LOG_SCHEMA).parquet(g.log_path)
        return g.log

    def _max_sync_log_id_for_current_role(self) -> int:
        log = self._log(self.current)
        return 0 if log is None else log.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]

    def _pending_sync_rows_for_current_role(self, applied_sync_id: int) -> int:
        log = self._log(self.current)
        return 0 if log is None else sync.pending(log, applied_sync_id).count()

    def pending_rows(self, g: GraphEntry) -> int:
        log = self._log(g)
        return 0 if log is None else sync.pending(log, g.applied).count()

    def apply_sync(self) -> DataFrame:
        """Replays the log up to the mark it has now."""
        g = self.current
        log = self._log(g)
        done = (0, 0, 0)
        if log is not None:
            mark = self._max_sync_log_id_for_current_role()
            changes = sync.pending(log, g.applied, mark)
            done = self.apply_changes(changes)
            g.applied = max(g.applied, mark)
        return self.rows([done], "inserts_applied long, updates_applied long, deletes_applied long")

    def apply_changes(self, changes: DataFrame) -> tuple[int, int, int]:
        """Applies log rows as one batch; also the function of a stream's batches."""
        g = self.current
        keys = {name: t.id_columns for name, t in g.catalog.tables.items()}
        keys |= {e.from_table: self.sources[e.from_table].primary_key for e in g.catalog.edges if e.from_table not in keys}
        changes = changes.persist()
        sync.check(changes, set(keys))
        done = sync.counts(changes)
        if any(done):
            self._known(changes, g)
            folded = sync.folded(changes).persist()
            for (table,) in folded.select("table").distinct().collect():  # registered tables
                if not keys[table]:
                    raise GraphError("unsupported_operation", f"changes of {table} need its primary key")
                self.sources[table] = sync.apply_table(self.sources[table], tuple(keys[table]), folded.where(F.col("table") == table).select("key", "row"))
                g.pending_edges += table not in g.catalog.tables
            g.touched()
        top = changes.agg(F.max("id")).head()[0]
        if top is not None:
            g.applied = max(g.applied, top)
        return done

    def _known(self, changes: DataFrame, g: GraphEntry) -> None:
        """A node that is deleted must exist, in the sources or earlier in the batch."""
        for name, t in g.catalog.tables.items():
            gone = changes.where((F.col("table") == name) & (F.col("op") == "D")).select(F.col("old_key").alias("k")).distinct()
            there = self.sources[name].df.select(key_text(t.id_columns).alias("k"))
            made = changes.where((F.col("table") == name) & F.col("op").isin("I", "U")).select(F.col("new_key").alias("k"))
            bad = gone.join(there.unionByName(made), "k", "left_anti").head()
            if bad is not None:
                raise GraphError("node_not_found", f"there is no node {name}:{bad.k}")

    def follow_log(self, path: str, checkpoint: str | None = None):
        """A streaming query that applies what the log folder has and ends."""
        return sync.stream(self.spark, path, self.apply_changes, checkpoint or f"{shared_folder(self.spark)}/trellis-sync-{uuid.uuid4().hex}")

    def sync_health(self) -> DataFrame:
        g, s, o = self.current, self.settings, self.overlay
        top, wait = self._max_sync_log_id_for_current_role(), self.pending_rows(g)
        row = (s.sync_mode, s.query_freshness, s.sync_batch_size, g.applied, top, wait, 0, 0, s.edge_buffer_size, o.tombstones > 0, g.needs_rebuild, False, None, g.projection_mode, o.tombstones, 0, o.tombstones > s.compaction_threshold, o.dirty, o.added_nodes, o.deleted_nodes, o.added_edges, o.deleted_edges, 0, wait > 0, g.stale, False, False, False, False, g.applied, False, 1)
        names = "sync_mode string, query_freshness string, sync_batch_size int, applied_sync_id long, max_sync_log_id long, pending_sync_rows long, disabled_trigger_count int, edge_buffer_used int, edge_buffer_size int, needs_vacuum boolean, needs_rebuild boolean, read_only boolean, read_only_reason string, projection_mode string, overlay_tombstone_count int, overlay_memory_bytes long, compaction_recommended boolean, tx_delta_dirty boolean, tx_delta_added_nodes int, tx_delta_deleted_nodes int, tx_delta_added_edges int, tx_delta_deleted_edges int, tx_delta_memory_bytes long, apply_sync_recommended boolean, maintenance_recommended boolean, durable_ingest_recommended boolean, durable_compaction_recommended boolean, durable_gc_recommended boolean, durable_repair_recommended boolean, sync_log_retention_floor long, sync_log_prune_recommended boolean, active_sync_watermark_backends int"
        return self.rows([row], names)

    # -- maintenance

    def _vacuum(self, g: GraphEntry) -> tuple:
        began, before, gone = time.time(), g.node_count, self.overlay.tombstones
        self._build(g)
        self.overlay.clear()
        g.last_vacuum = now()
        return (before, g.node_count, gone, g.edge_count, (time.time() - began) * 1000)

    def vacuum(self) -> DataFrame:
        return self.rows([self._vacuum(self.current)], "nodes_before long, nodes_after long, tombstones_removed long, edges_rebuilt long, vacuum_time_ms double")

    def vacuum_graph(self, graph_name: str, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        return self.rows([self._vacuum(self.find_graph(graph_name, graph_tenant, graph_namespace))], "nodes_before long, nodes_after long, tombstones_removed long, edges_rebuilt long, vacuum_time_ms double")

    def _maintain(self, g: GraphEntry, concurrently: bool) -> dict:
        def work(job: dict) -> None:
            before, self.current = self.current, g
            try:
                job["phase"] = "sync"
                job["applied"] = sum(self.apply_sync().head())
                job["phase"] = "vacuum"
                job["ms"] = self._vacuum(g)[-1]
            finally:
                self.current = before

        return self._job(g, self.upkeep, work, concurrently)

    def _upkeep_rows(self, jobs: list[dict]) -> DataFrame:
        rows = [(j["id"], j["graph"].id, j["graph"].name, j["status"], j.get("applied"), j["graph"].node_count, j["graph"].edge_count, j.get("ms"), j["phase"], None, j["started"], j["finished"], j["error"]) for j in jobs]
        return self.rows(rows, MAINTENANCE_STATUS)

    def maintenance(self, concurrently: bool = False) -> DataFrame:
        return self._upkeep_rows([self._maintain(self.current, concurrently)]).select("job_id", "status", "sync_rows_applied", "nodes_after", "edges_after", "vacuum_time_ms", "error")

    def maintenance_graph(self, graph_name: str, concurrently: bool = False, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        return self._upkeep_rows([self._maintain(g, concurrently)]).drop("progress_phase", "progress_message", "started_at", "finished_at")

    def maintenance_status(self, job_id: str | None = None) -> DataFrame:
        return self._upkeep_rows([j for j in self.upkeep.values() if job_id in (None, j["id"])]).drop("graph_id", "graph_name")

    def maintenance_status_for_graph(self, graph_name: str, graph_tenant: str | None = None, graph_namespace: str | None = None, max_rows: int = 50) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        return self._upkeep_rows([j for j in reversed(self.upkeep.values()) if j["graph"] is g][:max_rows])

    def run_scheduled_maintenance(self) -> DataFrame:
        g = self.current
        wait = self.pending_rows(g)
        if wait:
            self.apply_sync()
        job = self._maintain(g, True) if g.stale or g.needs_rebuild else None
        return self.rows([(wait > 0, job is not None, job and job["id"], wait, 0, "applied pending rows" if wait else "nothing to do")], "applied_sync boolean, maintenance_started boolean, maintenance_job_id string, pending_sync_rows long, edge_buffer_used int, message string")

    # -- durable generations

    def store(self, g: GraphEntry) -> Store:
        folder = self.settings.data_dir or f"{shared_folder(self.spark)}/trellis-graphs"
        return Store(self.spark, f"{folder.rstrip('/')}/{g.id}")

    def save_graph(self) -> Manifest:
        """Writes the current topology as a new generation."""
        graph = self.graph()
        self.current.manifest = self.store(self.current).save(graph, self.current.applied)
        return self.current.manifest

    def ingest_projection(self, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
        """Turns log rows beyond the manifest's mark into one delta segment."""
        g = self.current
        store, log = self.store(g), self._log(g)
        m = store.load()
        if m is None:
            raise GraphError("not_built", "there is no snapshot to add to")
        done, published = 0, 0
        if log is not None:
            changes = sync.pending(log, m.watermark).orderBy("id")
            changes = (changes if max_rows is None else changes.limit(max_rows)).persist()
            done, top = changes.agg(F.count("*"), F.max("id")).head()
            if done:
                nodes, edges = self._deltas(g, changes)
                m = store.add_segment(m, nodes, edges, done, top)
                published = 1
            g.manifest = m
        return self.rows([(done, published, m.watermark)], "rows_ingested long, segments_published long, sync_watermark long")

    def _deltas(self, g: GraphEntry, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Deleted and added nodes and edges of log rows, from their old and new images."""
        folded = sync.folded(changes).persist()
        nodes = self.rows([], f"op string, {NODE_SCHEMA}")
        edges = self.rows([], f"op string, {EDGE_SCHEMA}")
        current = dict(self.sources)
        rows: dict[str, DataFrame] = {}
        for table in sorted({r.table for r in folded.select("table").distinct().collect()}):
            states = folded.where(F.col("table") == table)
            schema = self.sources[table].df.schema
            new = states.where("row is not null").select(F.from_json("row", schema).alias("r")).select("r.*")
            rows[table] = new
            columns = g.catalog.tables[table].id_columns if table in g.catalog.tables else self.sources[table].primary_key
            current[table] = sync.apply_table(self.sources[table], tuple(columns), states.select("key", "row"))
            if table in g.catalog.tables:
                gone = states.where("key is not null").select(F.lit("D").alias("op"), F.lit(table).alias("label"), F.lit(g.catalog.ordinal(table)).alias("ord"), F.col("key").alias("id"), F.lit(None).cast("string").alias("tenant"))
                t = g.catalog.tables[table]
                tenant = F.col(t.tenant_column).cast("string") if t.tenant_column else F.lit(None).cast("string")
                here = new.select(F.lit("I").alias("op"), F.lit(table).alias("label"), F.lit(g.catalog.ordinal(table)).alias("ord"), key_text(t.id_columns).alias("id"), tenant.alias("tenant"))
                nodes = nodes.unionByName(gone).unionByName(here)
            for i, e in enumerate(g.catalog.ordered_edges()):
                if e.from_table == table:
                    gone = states.where("key is not null").select(F.lit("D").alias("op"), *(F.lit(i).alias(c) if c == "mapping_id" else F.col("key").alias(c) if c == "source_key" else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in EDGE_SCHEMA.split(", "))))
                    edges = edges.unionByName(gone)
        added = resolved_edges(g.catalog, current, node_rows(g.catalog, current), True, rows)
        if added is not None:
            edges = edges.unionByName(added.withColumn("op", F.lit("I")).select("op", *(c.split()[0] for c in EDGE_SCHEMA.split(", "))))
        return nodes, edges

    def projection_status(self) -> DataFrame:
        g = self.current
        store = self.store(g)
        m = store.load()
        sizes = [store.size(s["name"]) for s in m.segments] if m else []
        levels = [s["level"] for s in m.segments] if m else []
        wait = self._pending_sync_rows_for_current_role(m.watermark) if m else 0
        base = store.size(m.base) if m else 0
        names = store.names()
        used = {m.base, *(s["name"] for s in m.segments)} if m else set()
        old = [n for n in names if n.startswith(("base-", "segment-")) and n not in used]
        times = m.times if m else {}
        bad = store.validate(m) if m else "no manifest"
        n = len(sizes)
        row = (m.generation if m else None, m.watermark if m else None, wait, base, 0, base + sum(sizes), n, sum(sizes), n, n + 1, *(levels.count(k) for k in range(3)), n, n, 0, 0, 0.0, n, len(old), sum(store.size(x) for x in old), self.active_generation_count(), "valid" if bad is None else bad, times.get("ingest"), times.get("compact"), times.get("gc"), times.get("repair"), wait > 0, n >= 4, len(old) > 0, bad is not None and m is not None)
        ints = "segment_fanout int, read_amplification int, l0_segment_count int, l1_segment_count int, l2_segment_count int, edge_segment_count int, node_segment_count int, dirty_chunk_count int, dirty_chunk_bytes long, tombstone_ratio double, compaction_backlog int, obsolete_file_count int, obsolete_bytes long, active_generation_count int, artifact_validation_state string"
        return self.rows([row], f"manifest_generation long, manifest_watermark long, pending_durable_rows long, base_artifact_bytes long, manifest_bytes long, artifact_bytes long, segment_count int, segment_bytes long, {ints}, last_ingestion_unix_micros long, last_compaction_unix_micros long, last_gc_unix_micros long, last_repair_unix_micros long, ingest_recommended boolean, compaction_recommended boolean, gc_recommended boolean, repair_recommended boolean")

    def projection_compact(self, max_rows: int = 10_000, max_bytes: int | None = None, max_segments: int = 1000, dirty_chunk_segment_threshold: int | None = None) -> DataFrame:
        store = self.store(self.current)
        m = store.load()
        if m is None:
            raise GraphError("not_built", "there is no snapshot")
        n = len(m.segments)
        m = self.current.manifest = store.compact(m) if n else m
        return self.rows([(m.generation, n, int(n > 0), len(m.segments), 0, m.watermark)], "manifest_generation long, segments_compacted int, chunks_rewritten int, segment_count int, dirty_chunk_count int, sync_watermark long")

    def projection_gc(self) -> DataFrame:
        active = {self.current.manifest.generation} if self.current.manifest and self.current.graph else set()
        r = self.store(self.current).collect_garbage(self.settings.projection_retention_generations, active)
        return self.rows([tuple(r.values())], "valid_generations_scanned int, retained_generations array<long>, active_generations array<long>, obsolete_candidates int, protected_candidates int, deleted_files int, deleted_bytes long")

    def projection_repair(self) -> DataFrame:
        store = self.store(self.current)
        m = store.load()
        reason = store.validate(m)
        if reason is None:
            row = ("none", m.generation, False, 0, "valid")
        else:
            self._build(self.current)
            m = self.current.manifest = store.save(self.current.graph, self.current.applied)
            row = ("rebuild", m.generation, True, 1, reason)
        return self.rows([row], "action string, generation_id long, rebuilt boolean, chunks_rewritten int, reason string")

    def active_generation_count(self) -> int:
        return sum(g.manifest is not None and g.graph is not None for g in self.graphs)

    # -- policies and jobs

    def add_sync_policy(self, graph_name: str, schedule_interval_secs: int = 60, max_sync_lag_rows: int | None = None, enabled: bool = True, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        g = self.find_graph(graph_name, graph_tenant, graph_namespace)
        if schedule_interval_secs <= 0:
            raise GraphError("semantic", "an interval is positive")
        job = {"job_id": self.new_id(), "policy_id": self.new_id(), "graph": g, "kind": "sync", "enabled": enabled, "interval": schedule_interval_secs, "lag": max_sync_lag_rows, "max_runtime": None, "max_retries": 3, "next": now(), "last": None, "status": None, "error": None, "sqlstate": None}
        self.job_rows[job["job_id"]] = job
        return self._policies([job])

    def _policies(self, jobs: list[dict]) -> DataFrame:
        return self.rows([(j["policy_id"], j["job_id"], j["graph"].id, j["graph"].name, j["enabled"], j["interval"], j["lag"], j["next"], j["status"]) for j in jobs], POLICY)

    def _policy(self, policy_id: str) -> dict:
        for j in self.job_rows.values():
            if j["policy_id"] == policy_id:
                return j
        raise GraphError("semantic", f"unknown policy {policy_id}")

    def _job_row(self, job_id: str) -> dict:
        if job_id not in self.job_rows:
            raise GraphError("semantic", f"unknown job {job_id}")
        return self.job_rows[job_id]

    @staticmethod
    def _alter(job: dict, **changes: Any) -> None:
        job.update({k: v for k, v in changes.items() if v is not None})

    def alter_sync_policy(self, policy_id: str, schedule_interval_secs: int | None = None, max_sync_lag_rows: int | None = None, enabled: bool | None = None) -> DataFrame:
        job = self._policy(policy_id)
        self._alter(job, interval=schedule_interval_secs, lag=max_sync_lag_rows, enabled=enabled)
        return self._policies([job])

    def drop_sync_policy(self, policy_id: str) -> DataFrame:
        j = self._policy(policy_id)
        del self.job_rows[j["job_id"]]
        return self.rows([(policy_id, j["job_id"], j["graph"].id, j["graph"].name, True)], "policy_id string, job_id string, graph_id string, graph_name string, dropped boolean")

    def _run(self, job: dict, mode: str = "foreground") -> dict:
        g, began = job["graph"], now()
        run = {"run_id": self.new_id(), "job": job, "status": "completed", "rows": 0, "error": None, "sqlstate": None, "started": began, "mode": mode}
        before, self.current = self.current, g
        try:
            run["rows"] = sum(self.apply_sync().head())
        except Exception as e:
            run["status"], run["error"], run["sqlstate"] = "failed", str(e), getattr(e, "sqlstate", "XX000")
        finally:
            self.current = before
        run["finished"] = now()
        job.update(last=run["finished"], next=run["finished"] + timedelta(seconds=job["interval"]), status=run["status"], error=run["error"], sqlstate=run["sqlstate"])
        self.run_rows.append(run)
        return run

    def run_sync_policy(self, policy_id: str) -> DataFrame:
        r = self._run(self._policy(policy_id))
        j = r["job"]
        return self.rows([(policy_id, j["job_id"], r["run_id"], j["graph"].id, j["graph"].name, r["status"], r["rows"], r["error"], r["started"], r["finished"])], "policy_id string, job_id string, run_id string, graph_id string, graph_name string, status string, rows_applied long, error string, started_at timestamp, finished_at timestamp")

    def _of(self, graph_name: str | None, tenant: str | None, namespace: str | None) -> list[dict]:
        only = None if graph_name is None else self.find_graph(graph_name, tenant, namespace)
        return [j for j in self.job_rows.values() if only in (None, j["graph"])]

    def sync_policy_status(self, graph_name: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None, max_rows: int = 50) -> DataFrame:
        rows = [(j["policy_id"], j["job_id"], j["graph"].id, j["graph"].name, j["enabled"], j["interval"], j["lag"], j["next"], j["last"], j["status"], j["error"]) for j in self._of(graph_name, graph_tenant, graph_namespace)[:max_rows]]
        return self.rows(rows, "policy_id string, job_id string, graph_id string, graph_name string, enabled boolean, schedule_interval_secs long, max_sync_lag_rows long, next_run_at timestamp, last_run_at timestamp, last_status string, last_error string")

    def jobs(self, graph_name: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None, max_rows: int = 50) -> DataFrame:
        rows = [(j["job_id"], j["graph"].id, j["graph"].name, j["kind"], j["enabled"], j["interval"], j["max_runtime"], j["max_retries"], j["next"], j["last"], j["status"], j["error"], j["sqlstate"]) for j in self._of(graph_name, graph_tenant, graph_namespace)[:max_rows]]
        return self.rows(rows, "job_id string, graph_id string, graph_name string, policy_kind string, enabled boolean, schedule_interval_secs long, max_runtime_secs long, max_retries int, next_run_at timestamp, last_run_at timestamp, last_status string, last_error string, last_sqlstate string")

    def job_runs(self, job_id: str | None = None, graph_name: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None, max_rows: int = 50) -> DataFrame:
        only = None if graph_name is None else self.find_graph(graph_name, graph_tenant, graph_namespace)
        rows = [(r["run_id"], r["job"]["job_id"], r["job"]["graph"].id, r["job"]["graph"].name, r["status"], r["rows"], 0, r["mode"], r["sqlstate"], r["error"], r["started"], r["finished"]) for r in reversed(self.run_rows) if job_id in (None, r["job"]["job_id"]) and only in (None, r["job"]["graph"])]
        return self.rows(rows[:max_rows], "run_id string, job_id string, graph_id string, graph_name string, status string, rows_applied long, retry_count int, execution_mode string, sqlstate string, error string, started_at timestamp, finished_at timestamp")

    def job_stats(self, graph_name: str | None = None, graph_tenant: str | None = None, graph_namespace: str | None = None) -> DataFrame:
        out: dict[tuple, list] = {}
        for j in self._of(graph_name, graph_tenant, graph_namespace):
            x = out.setdefault((j["graph"].id, j["graph"].name, j["kind"]), [0, 0, 0, 0, None])
            runs = [r for r in self.run_rows if r["job"] is j]
            x[0], x[1] = x[0] + 1, x[1] + len(runs)
            x[2], x[3] = x[2] + sum(r["status"] == "completed" for r in runs), x[3] + sum(r["status"] == "failed" for r in runs)
            x[4] = max([t for t in (x[4], j["last"]) if t], default=None)
        return self.rows([(*k, *v) for k, v in out.items()], "graph_id string, graph_name string, policy_kind string, job_count long, run_count long, completed_runs long, failed_runs long, last_run_at timestamp")

    def _ran(self, runs: list[dict]) -> DataFrame:
        return self.rows([(r["job"]["job_id"], r["run_id"], r["job"]["graph"].id, r["job"]["graph"].name, r["job"]["kind"], r["status"], r["rows"], r["error"], r["started"], r["finished"]) for r in runs], RUN)

    def run_job(self, job_id: str) -> DataFrame:
        return self._ran([self._run(self._job_row(job_id))])

    def alter_job(self, job_id: str, enabled: bool | None = None, schedule_interval_secs: int | None = None, max_runtime_secs: int | None = None, max_retries: int | None = None) -> DataFrame:
        j = self._job_row(job_id)
        self._alter(j, enabled=enabled, interval=schedule_interval_secs, max_runtime=max_runtime_secs, max_retries=max_retries)
        return self.jobs().where(F.col("job_id") == job_id).drop("last_run_at", "last_error", "last_sqlstate")

    def remove_job(self, job_id: str) -> DataFrame:
        j = self._job_row(job_id)
        del self.job_rows[job_id]
        return self.rows([(job_id, j["graph"].id, j["graph"].name, j["kind"], True)], "job_id string, graph_id string, graph_name string, policy_kind string, removed boolean")

    def run_due_jobs(self, max_jobs: int = 64) -> DataFrame:
        due = [j for j in self.job_rows.values() if j["enabled"] and j["next"] <= now()][:max_jobs]
        return self._ran([self._run(j) for j in due])

    def run_due_jobs_async(self, max_jobs: int = 64) -> bool:
        self.pool.submit(self.run_due_jobs, max_jobs)
        return True

    # -- status

    def reset(self) -> None:
        for g in self.graphs:
            if g.graph is not None:
                g.graph.unpersist()
                g.graph = g.components = None
        self.overlay.clear()

    def test_enabled(self) -> bool:
        return self.settings.enabled

    def _selected_graph_id_for_current_role(self) -> str:
        return self.current.id

    def status(self) -> DataFrame:
        g, s, o = self.current, self.settings, self.overlay
        wait = self.pending_rows(g)
        row = (g.node_count, g.edge_count, None, s.memory_limit_mb, s.sync_mode, "pending" if wait else "current", g.last_build, g.last_vacuum, sorted(g.edge_types), 0, g.graph.has_unidirectional if g.graph else None, "drifted" if g.needs_rebuild and g.graph else "valid", wait, g.pending_edges, o.tombstones > 0, g.needs_rebuild, g.applied, wait, None if g.graph else "not built", 0, False, None, g.projection_mode, o.tombstones, 0, o.tombstones > s.compaction_threshold, o.dirty, o.added_nodes, o.deleted_nodes, o.added_edges, o.deleted_edges, 0)
        return self.rows([row], "node_count int, edge_count int, memory_used_mb double, memory_limit_mb int, sync_mode string, sync_status string, last_build timestamp, last_vacuum timestamp, edge_types array<string>, edge_buffer_used int, has_unidirectional_edges boolean, schema_status string, sync_lag long, pending_edge_deltas int, needs_vacuum boolean, needs_rebuild boolean, applied_sync_id long, pending_sync_rows long, invalid_reason string, disabled_trigger_count int, read_only boolean, read_only_reason string, projection_mode string, overlay_tombstone_count int, overlay_memory_bytes long, compaction_recommended boolean, tx_delta_dirty boolean, tx_delta_added_nodes int, tx_delta_deleted_nodes int, tx_delta_added_edges int, tx_delta_deleted_edges int, tx_delta_memory_bytes long")

    def _memory_mb(self) -> tuple[float, float]:
        """The driver's heap in use, and what cached tables hold on all executors."""
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        cached = sum(x.memSize() for x in self.spark.sparkContext._jsc.sc().getRDDStorageInfo())
        return (runtime.totalMemory() - runtime.freeMemory()) / 1e6, cached / 1e6

    def memory_profile(self, concurrent_backends: int = 1) -> DataFrame:
        names = ("active_backend_private_mb", "active_backend_shared_mb", "active_backend_total_mb", "estimated_instance_private_mb", "estimated_instance_shared_mb", "estimated_instance_total_mb")
        own, cached = self._memory_mb()
        return self.rows([(own, cached, own + cached, own * concurrent_backends, cached, own * concurrent_backends + cached, self.settings.memory_limit_mb, concurrent_backends)], ", ".join(f"{n} double" for n in names) + ", memory_limit_mb int, assumed_concurrent_backends int")

    def resource_status(self) -> DataFrame:
        return self.rows([(self.last_operation[0], None, None, None, None, self.last_operation[1], self.last_operation[2])], "operation string, memory_budget_bytes long, memory_peak_bytes long, memory_peak_phase string, disk_peak_bytes long, rows long, work_units long")

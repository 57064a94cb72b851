"""Session settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from trellis.errors import GraphError


@dataclass
class Settings:
    """Limits that bound single-machine memory in a database are optional here:
    Spark spills, so ``row_cap`` is off unless it is set.  ``max_nodes``,
    ``max_frontier`` and ``max_exact_path_count`` of None are no limits."""

    enabled: bool = True
    memory_limit_mb: int = 2048
    query_memory_mb: int = 64
    maintenance_memory_mb: int = 256
    spill_disk_limit_mb: int = 4096
    default_max_depth: int = 5
    default_search_mode: str = "contains"
    default_case_sensitive: bool = False
    default_hydrate: bool = True
    max_nodes: int | None = 100_000
    max_frontier: int | None = 100_000
    max_exact_path_count: int | None = 100_000
    query_work_limit: int = 10_000_000
    operation_timeout_ms: int = 0
    build_batch_size: int = 10_000
    low_memory_build: bool = False
    persist_on_build: bool = True
    auto_load: bool = True
    max_loaded_graphs_per_backend: int = 1
    hot_eager_load: bool = False
    idle_unload_secs: int = 0
    edge_buffer_size: int = 100_000
    sync_batch_size: int = 1_000
    vacuum_interval_secs: int = 60
    data_dir: str | None = None
    sync_mode: str = "manual"
    query_freshness: str = "apply_pending_sync"
    oom_action: str = "error"
    tenant: str | None = None
    build_scan_mode: str = "cursor"
    default_projection_mode: str = "csr_readonly"
    mutable_enabled: bool = False
    max_tx_delta_nodes: int = 100_000
    max_tx_delta_edges: int = 100_000
    max_overlay_memory_mb: int = 256
    compaction_threshold: int = 50_000
    projection_retention_generations: int = 2
    enforce_tenant_scope: bool = True
    allow_rls_tables: bool = False
    row_cap: int | None = None
    strict_comparisons: bool = False

    def set(self, name: str, value: object) -> None:
        if name not in {f.name for f in fields(self)}:
            raise GraphError("semantic", f"unknown setting {name}")
        if name == "query_freshness" and value not in ("apply_pending_sync", "off", "error_on_pending"):
            raise GraphError("semantic", f"query_freshness can't be {value}")
        setattr(self, name, value)

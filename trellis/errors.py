"""Errors with a stable code and SQLSTATE."""

from __future__ import annotations

#: Kind of failure, code, SQLSTATE.
CODES = {
    "internal": ("PG000", "XX000"),
    "out_of_memory": ("PG001", "53200"),
    "access_denied": ("PG002", "42501"),
    "not_built": ("PG003", "55000"),
    "edge_type_limit": ("PG004", "54000"),
    "invalid_filter": ("PG005", "22023"),
    "build_locked": ("PG006", "55P03"),
    "resource_limit": ("PG007", "54000"),
    "edge_buffer_full": ("PG008", "54000"),
    "corrupt_file": ("PG009", "XX001"),
    "node_not_found": ("PG010", "P0002"),
    "incompatible_version": ("PG011", "0A000"),
    "read_only": ("PG012", "55000"),
    "syntax": ("PG013", "42601"),
    "unsupported": ("PG014", "0A000"),
    "semantic": ("PG015", "22023"),
    "parameter": ("PG016", "22023"),
    "execution": ("PG017", "22000"),
    "unsupported_operation": ("PG018", "0A000"),
    "overlay_limit": ("PG019", "54000"),
    "disabled": ("PG020", "55000"),
    "row_security": ("PG021", "55000"),
    "log_pruned": ("PG022", "55000"),
}


class GraphError(Exception):
    """A failure of a graph operation; ``kind`` names it, ``code`` and ``sqlstate`` are stable."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{CODES[kind][0]}: {message}")
        self.kind, self.message = kind, message
        self.code, self.sqlstate = CODES[kind]

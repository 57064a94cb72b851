"""Text forms of node references and paths."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.errors import GraphError


class NodeRef(NamedTuple):
    table: str
    id: str


def node_ref(value: object) -> NodeRef:
    """A reference from a pair, a mapping with table and id, or their JSON."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            raise GraphError("semantic", f"{value!r} is no node reference") from None
    if isinstance(value, dict) and set(value) == {"table", "id"}:
        return NodeRef(str(value["table"]), str(value["id"]))
    if isinstance(value, (list, tuple)) and len(value) == 2:
        return NodeRef(str(value[0]), str(value[1]))
    raise GraphError("semantic", f"{value!r} is no node reference")


def node_ref_string(table_name: str, node_id: str) -> str:
    return json.dumps([table_name, str(node_id)])


def format_path(path: list, edge_path: list[str], separator: str = " | ") -> str:
    """``t:id --label--> t:id`` for each step, joined by the separator."""
    nodes = [f"{p['table']}:{p['id']}" if isinstance(p, dict) else f"{p[0]}:{p[1]}" for p in path]
    if nodes and len(edge_path) != len(nodes) - 1:
        raise GraphError("semantic", "a path has one edge less than nodes")
    if len(nodes) == 1:
        return nodes[0]
    return separator.join(f"{a} --{e}--> {b}" for a, e, b in zip(nodes, edge_path, nodes[1:], strict=False))


def format_path_column(path: Column, edge_path: Column, separator: str = " | ") -> Column:
    """The same over columns of structs with table and id."""
    text = F.transform(path, lambda p: F.concat(p["table"], F.lit(":"), p["id"]))
    steps = F.transform(edge_path, lambda e, i: F.concat(F.get(text, i), F.lit(" --"), e, F.lit("--> "), F.get(text, i + 1)))
    return F.when(F.size(edge_path) == 0, F.get(text, F.lit(0))).otherwise(F.array_join(steps, separator))

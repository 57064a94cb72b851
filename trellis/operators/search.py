"""Text search over the source rows of registered tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.catalog import Catalog, Source, key_text
from trellis.errors import GraphError

MODES = ("contains", "exact", "prefix", "token")


def matches(column: Column, value: str, mode: str, case_sensitive: bool) -> Column:
    text = column.cast("string")
    if not case_sensitive:
        text, value = F.lower(text), value.lower()
    if mode == "contains":
        return text.contains(value)
    if mode == "exact":
        return text == value
    if mode == "prefix":
        return text.startswith(value)
    out = text.isNotNull()
    for token in re.findall(r"[^\W_]+", value):
        out = out & text.rlike(rf"(^|[^\p{{L}}\p{{N}}]){re.escape(token)}($|[^\p{{L}}\p{{N}}])")
    return out


def search(
    catalog: Catalog, sources: dict[str, Source], key: str, value: str, table: str | None = None, mode: str = "contains",
    case_sensitive: bool = False, tenant: str | None = None, nodes: DataFrame | None = None,
) -> DataFrame:
    """(ord, node_table, node_id) of rows whose property matches; null never does.

    A union of one filter for each table that has the property, so predicates
    and column pruning reach every scan."""
    if mode not in MODES:
        raise GraphError("semantic", f"unknown search mode {mode}")
    if value is None:
        raise GraphError("semantic", "search needs a value")
    if table is not None:
        catalog.table(table)
    out = None
    for name, t in sorted(catalog.tables.items()):
        df = sources[name].df
        if table not in (None, name) or key not in catalog.properties(name, df):
            continue
        found = df.where(matches(F.col(key), value, mode, case_sensitive))
        if tenant is not None and t.tenant_column:
            found = found.where(F.col(t.tenant_column).cast("string") == tenant)
        part = found.select(F.lit(catalog.ordinal(name)).alias("ord"), F.lit(name).alias("node_table"), key_text(t.id_columns).alias("node_id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise GraphError("semantic", f"no registered table has the property {key}")
    return out.where("node_id is not null")

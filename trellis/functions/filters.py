"""Structured filters: constructors, and compilation to columns.

A filter is ``{"node": {"where": {column: {operator: value}}}}``; one predicate
a column, all must hold.  Filters on registered filter columns prune a
traversal's expansion; all others are applied to the rows it returns.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.catalog import FILTER_TYPES, Catalog, Source
from trellis.errors import GraphError

#: The operators of a filter, and those that each type takes.
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "between", "in", "not_in", "contains", "prefix", "is_null", "is_not_null")
_ORDERED = {"eq", "neq", "gt", "gte", "lt", "lte", "between", "in", "not_in", "is_null", "is_not_null"}
_EQUAL = {"eq", "neq", "in", "not_in", "is_null", "is_not_null"}
BY_TYPE = {"numeric": _ORDERED, "date": _ORDERED, "timestamptz": _ORDERED, "boolean": _EQUAL, "uuid": _EQUAL, "text": _EQUAL | {"contains", "prefix"}}


def _one(column: str, operator: str, value: Any) -> dict:
    return {"where": {column: {operator: value}}}


def equals(column_name: str, value: Any) -> dict:
    return _one(column_name, "eq", value)


eq = equals


def not_equals(column_name: str, value: Any) -> dict:
    return _one(column_name, "neq", value)


neq = not_equals


def greater_than(column_name: str, value: Any) -> dict:
    return _one(column_name, "gt", value)


gt = greater_than


def at_least(column_name: str, value: Any) -> dict:
    return _one(column_name, "gte", value)


gte = at_least


def less_than(column_name: str, value: Any) -> dict:
    return _one(column_name, "lt", value)


lt = less_than


def at_most(column_name: str, value: Any) -> dict:
    return _one(column_name, "lte", value)


lte = at_most


def between(column_name: str, lower: Any, upper: Any) -> dict:
    return _one(column_name, "between", [lower, upper])


def in_(column_name: str, values: list) -> dict:
    return _one(column_name, "in", list(values))


def not_in(column_name: str, values: list) -> dict:
    return _one(column_name, "not_in", list(values))


def contains_text(column_name: str, value: str) -> dict:
    return _one(column_name, "contains", value)


def prefix_text(column_name: str, value: str) -> dict:
    return _one(column_name, "prefix", value)


def is_null(column_name: str) -> dict:
    return _one(column_name, "is_null", True)


def is_not_null(column_name: str) -> dict:
    return _one(column_name, "is_not_null", True)


def on_node(filter: dict) -> dict:
    return filter if "node" in filter else {"node": filter}


def all_(filters: list[dict]) -> dict:
    """Predicates of all filters; of two on one column the last one stands."""
    where: dict = {}
    for f in filters:
        where |= _where(f)
    return {"where": where}


def _where(filter: dict | str | None) -> dict:
    if filter is None:
        return {}
    if isinstance(filter, str):
        filter = json.loads(filter)
    body = filter.get("node", filter)
    if not isinstance(body, dict) or set(body) - {"where"} or not isinstance(body.get("where", {}), dict):
        raise GraphError("invalid_filter", "a filter has the form {node: {where: {column: {operator: value}}}}")
    return body.get("where", {})


def parse(filter: dict | str | None) -> list[tuple[str, str, Any]]:
    """(column, operator, value) of each predicate; eq and neq of null become null tests."""
    out = []
    for column, predicate in _where(filter).items():
        if not isinstance(predicate, dict) or len(predicate) != 1:
            raise GraphError("invalid_filter", f"{column} needs one operator")
        (operator, value), = predicate.items()
        if operator not in OPERATORS:
            raise GraphError("invalid_filter", f"unknown operator {operator}")
        if operator == "between" and (not isinstance(value, (list, tuple)) or len(value) != 2):
            raise GraphError("invalid_filter", "between takes two bounds")
        if operator in ("in", "not_in") and not isinstance(value, (list, tuple)):
            raise GraphError("invalid_filter", f"{operator} takes a list")
        if operator in ("contains", "prefix") and not isinstance(value, str):
            raise GraphError("invalid_filter", f"{operator} takes a text")
        if value is None and operator in ("eq", "neq"):
            operator = "is_null" if operator == "eq" else "is_not_null"
        out.append((column, operator, value))
    return out


def typed(column: Column, kind: str) -> Column:
    """A filter column's value: numbers round half away from zero to whole ones."""
    if kind == "numeric":
        return F.round(column.cast("double")).cast("bigint")
    if kind == "uuid":
        return F.lower(F.regexp_replace(column.cast("string"), "-", ""))
    return column.cast(FILTER_TYPES[kind])


def _literal(value: Any, kind: str) -> Column:
    if kind == "uuid":
        return F.lit(str(value).replace("-", "").lower())
    if kind == "numeric" and (isinstance(value, bool) or not isinstance(value, (int, float))):
        raise GraphError("invalid_filter", f"{value!r} is not a number")
    return F.lit(value).cast(FILTER_TYPES[kind])


def compiled(column: Column, operator: str, value: Any, literal) -> Column:
    """A predicate as a column that is null where ``column`` is, but for null tests."""
    if operator == "is_null":
        return column.isNull()
    if operator == "is_not_null":
        return column.isNotNull()
    if operator == "eq":
        return column == literal(value)
    if operator == "neq":
        return column != literal(value)
    if operator == "gt":
        return column > literal(value)
    if operator == "gte":
        return column >= literal(value)
    if operator == "lt":
        return column < literal(value)
    if operator == "lte":
        return column <= literal(value)
    if operator == "between":
        return (column >= literal(value[0])) & (column <= literal(value[1]))
    if operator == "in":
        return column.isin([literal(v) for v in value]) if value else F.lit(False)
    if operator == "not_in":
        return column.isNotNull() & (~column.isin([literal(v) for v in value]) if value else F.lit(True))
    if operator == "contains":
        return column.contains(value)
    return column.startswith(value)


def split(predicates: list[tuple[str, str, Any]], catalog: Catalog) -> tuple[list, list]:
    """Predicates on registered filter columns, and the others, each with its table."""
    pushed, after = [], []
    for column, operator, value in predicates:
        tables = [f for f in catalog.filters if f.column == column]
        if len(tables) > 1:
            raise GraphError("invalid_filter", f"{column} is a filter column of several tables")
        if tables:
            if operator not in BY_TYPE[tables[0].type]:
                raise GraphError("invalid_filter", f"{tables[0].type} columns don't take {operator}")
            pushed.append((tables[0], operator, value))
            continue
        after.append((column, operator, value))
    return pushed, after


def allowed_nodes(pushed: list, catalog: Catalog, sources: dict[str, Source], nodes: DataFrame) -> DataFrame | None:
    """(label, id) of the nodes that pass all pushed predicates.  Of tables
    without the column only ``is_null`` lets nodes pass."""
    from trellis.catalog import key_text

    if not pushed:
        return None
    out = None
    for name, table in sorted(catalog.tables.items()):
        condition, possible = F.lit(True), True
        for f, operator, value in pushed:
            if f.table == name:
                kind = f.type
                condition = condition & compiled(typed(F.col(f.column), kind), operator, value, lambda v, k=kind: _literal(v, k))
            elif operator != "is_null":
                possible = False
        if not possible:
            continue
        part = sources[name].df.where(condition).select(F.lit(name).alias("label"), key_text(table.id_columns).alias("id"))
        out = part if out is None else out.unionByName(part)
    return nodes.select("label", "id").where("false") if out is None else out


def after_rows(after: list, catalog: Catalog, sources: dict[str, Source]) -> DataFrame | None:
    """(label, id) of source rows that pass the predicates which are applied to
    results; tables without a column fail, and ``neq`` passes nulls."""
    from trellis.catalog import key_text

    out = None
    for name, table in sorted(catalog.tables.items()):
        df = sources[name].df
        if not all(c in df.columns for c, _, _ in after):
            continue
        condition = F.lit(True)
        for column, operator, value in after:
            c, kind = F.col(column), df.schema[column].dataType
            if operator in ("contains", "prefix"):
                c = c.cast("string")
            elif isinstance(value, (int, float)) and not isinstance(value, bool) and isinstance(kind, T.NumericType):
                c = c.cast("double")
            one = compiled(c, operator, value, F.lit)
            condition = condition & (F.coalesce(one, F.lit(True)) if operator == "neq" else one)
        part = df.where(condition).select(F.lit(name).alias("label"), key_text(table.id_columns).alias("id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise GraphError("invalid_filter", "no registered table has all columns of the filter")
    return out

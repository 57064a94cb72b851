"""Registered queries of catalog, writes, sync, generations, jobs and exact paths, and the same in SQL.

Functions that return one row each are gathered as rows of (step, value).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.errors import GraphError
from trellis.functions import filters as fl
from trellis.functions.paths import format_path, format_path_column, node_ref_string
from trellis.queries import TABLES, _session
from trellis.session import Session
from trellis.settings import Settings
from trellis.streaming.sync import LOG_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]


def _text(value: Any) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return value if isinstance(value, str) else json.dumps(value, default=str)


def _steps(spark: SparkSession, rows: list[tuple[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(step, _text(value)) for step, value in rows], "step string, value string")


def _values(*rows: tuple[str, str], extra: str = "") -> str:
    """SQL of (step, value) rows; ``extra`` adds selects of computed values."""
    listed = ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in rows)
    return f"SELECT * FROM (VALUES {listed}) v(step, value)" + extra


def _new(spark: SparkSession, sf_dir: str, *names: str, mode: str = "csr_readonly", **settings: Any) -> Session:
    """A session of its own with some of the tables as sources."""
    s = Session(spark, Settings(default_projection_mode=mode, max_nodes=None, max_frontier=None, max_exact_path_count=None, **settings))
    for name in names:
        s.source(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), *TABLES[name])
    return s


def _geo(s: Session) -> Session:
    s.add_table("region", "r_regionkey")
    s.add_table("nation", "n_nationkey")
    s.add_edge("nation", "n_regionkey", "region", "r_regionkey", "in_region", False)
    return s


def _failure(run: Callable[[], Any]) -> str:
    try:
        run()
    except GraphError as e:
        return f"{e.code} {e.sqlstate}"
    return "no error"


# -- filters


def filter_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {
        "equals": fl.equals("c", "x"), "equals number": fl.equals("c", 5), "equals boolean": fl.equals("c", True), "eq": fl.eq("c", "x"), "eq number": fl.eq("c", 5), "eq boolean": fl.eq("c", False),
        "not_equals": fl.not_equals("c", "x"), "neq": fl.neq("c", "x"), "neq number": fl.neq("c", 5), "neq boolean": fl.neq("c", True), "greater_than": fl.greater_than("c", 1), "greater_than text": fl.greater_than("c", "2024-01-01"),
        "gt": fl.gt("c", 1), "gt text": fl.gt("c", "a"), "at_least": fl.at_least("c", 1), "gte": fl.gte("c", 1), "gte text": fl.gte("c", "a"), "less_than": fl.less_than("c", 1), "lt": fl.lt("c", 1), "lt text": fl.lt("c", "a"),
        "at_most": fl.at_most("c", 1), "lte": fl.lte("c", 1), "lte text": fl.lte("c", "a"), "between": fl.between("c", 1, 2), "in": fl.in_("c", [1, 2]), "not_in": fl.not_in("c", ["a"]), "contains_text": fl.contains_text("c", "x"),
        "prefix_text": fl.prefix_text("c", "x"), "is_null": fl.is_null("c"), "is_not_null": fl.is_not_null("c"), "on_node": fl.on_node(fl.eq("c", 5)), "all": fl.all_([fl.gt("c", 1), fl.eq("d", "x")]),
    }
    return _steps(spark, list(made.items()))


_CONSTRUCTED = [
    ("equals", "eq", '"x"'), ("equals number", "eq", "5"), ("equals boolean", "eq", "true"), ("eq", "eq", '"x"'), ("eq number", "eq", "5"), ("eq boolean", "eq", "false"), ("not_equals", "neq", '"x"'), ("neq", "neq", '"x"'),
    ("neq number", "neq", "5"), ("neq boolean", "neq", "true"), ("greater_than", "gt", "1"), ("greater_than text", "gt", '"2024-01-01"'), ("gt", "gt", "1"), ("gt text", "gt", '"a"'), ("at_least", "gte", "1"), ("gte", "gte", "1"),
    ("gte text", "gte", '"a"'), ("less_than", "lt", "1"), ("lt", "lt", "1"), ("lt text", "lt", '"a"'), ("at_most", "lte", "1"), ("lte", "lte", "1"), ("lte text", "lte", '"a"'), ("between", "between", "[1, 2]"), ("in", "in", "[1, 2]"),
    ("not_in", "not_in", '["a"]'), ("contains_text", "contains", '"x"'), ("prefix_text", "prefix", '"x"'), ("is_null", "is_null", "true"), ("is_not_null", "is_not_null", "true"),
]
CONSTRUCTORS_SQL = _values(
    *((name, f'{{"where": {{"c": {{"{op}": {value}}}}}}}') for name, op, value in _CONSTRUCTED),
    ("on_node", '{"node": {"where": {"c": {"eq": 5}}}}'), ("all", '{"where": {"c": {"gt": 1}, "d": {"eq": "x"}}}'),
)

#: Operator, filter, and the same over customers in SQL, on registered filter columns.
_PRUNING = [
    ("eq", fl.eq("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'"), ("neq", fl.neq("c_mktsegment", "BUILDING"), "c_mktsegment <> 'BUILDING'"), ("gt", fl.gt("c_acctbal", 2500), "round(c_acctbal) > 2500"),
    ("gte", fl.gte("c_acctbal", 2500), "round(c_acctbal) >= 2500"), ("lt", fl.lt("c_acctbal", 2500), "round(c_acctbal) < 2500"), ("lte", fl.lte("c_acctbal", 2500), "round(c_acctbal) <= 2500"),
    ("between", fl.between("c_acctbal", 100, 5000), "round(c_acctbal) BETWEEN 100 AND 5000"), ("in", fl.in_("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("not_in", fl.not_in("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), ("contains", fl.contains_text("c_mktsegment", "IN"), "contains(c_mktsegment, 'IN')"),
    ("prefix", fl.prefix_text("c_mktsegment", "B"), "starts_with(c_mktsegment, 'B')"), ("is_null", fl.is_null("c_acctbal"), "c_acctbal IS NULL"), ("is_not_null", fl.is_not_null("c_acctbal"), "c_acctbal IS NOT NULL"),
]
#: The same on columns that are no filter columns, applied to the rows of a traversal.
_APPLIED = [
    ("eq", fl.eq("c_custkey", 7), "c_custkey = 7"), ("neq", fl.neq("c_custkey", 7), "c_custkey <> 7"), ("gt", fl.gt("c_custkey", 700), "c_custkey > 700"), ("gte", fl.gte("c_custkey", 700), "c_custkey >= 700"), ("lt", fl.lt("c_custkey", 70), "c_custkey < 70"),
    ("lte", fl.lte("c_custkey", 70), "c_custkey <= 70"), ("between", fl.between("c_custkey", 10, 90), "c_custkey BETWEEN 10 AND 90"), ("in", fl.in_("c_custkey", [1, 2, 3]), "c_custkey IN (1, 2, 3)"), ("not_in", fl.not_in("c_custkey", [1, 2]), "c_custkey NOT IN (1, 2)"),
    ("contains", fl.contains_text("c_name", "7"), "contains(c_name, '7')"), ("prefix", fl.prefix_text("c_name", "C"), "starts_with(c_name, 'C')"), ("is_null", fl.is_null("c_name"), "c_name IS NULL"), ("is_not_null", fl.is_not_null("c_name"), "c_name IS NOT NULL"),
]


def _filtered_session(spark: SparkSession, sf_dir: str) -> Session:
    s = _new(spark, sf_dir, "nation", "customer")
    s.add_table("nation", "n_nationkey")
    s.add_table("customer", "c_custkey")
    s.add_edge("customer", "c_nationkey", "nation", "n_nationkey", "lives_in", False)
    s.add_filter_column("customer", "c_acctbal", "numeric")
    s.add_filter_column_to_graph("default", "customer", "c_mktsegment", "text")
    s.build()
    return s


def _operators(cases: list) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _filtered_session(spark, sf_dir)
        out = None
        for name, wanted, _ in cases:
            found = s.traverse("nation", "3", 1, direction="in", filter=wanted, include_start=False, hydrate=False, max_rows=None)
            part = found.agg(F.count("*").alias("n"), F.min("node_id").alias("least")).select(F.lit(name).alias("operator"), "n", "least")
            out = part if out is None else out.unionByName(part)
        return out

    return run


def _operators_sql(cases: list) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS operator, count(*) AS n, min(CAST(c_custkey AS VARCHAR)) AS least FROM customer WHERE c_nationkey = 3 AND {where}" for name, _, where in cases)


def operators_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which operators the filter columns of each type take."""
    s = _new(spark, sf_dir, "orders", "nation")
    s.add_table("orders", "o_orderkey")
    rows = []
    for kind in ("numeric", "text", "date", "timestamptz", "boolean", "uuid"):
        column = {"numeric": "o_totalprice", "date": "o_orderdate", "timestamptz": "o_orderdate"}.get(kind, "o_orderstatus")
        s.add_filter_column("orders", column, kind)
        for operator in fl.OPERATORS:
            rows.append((f"{kind} {operator}", _failure(lambda o=operator, c=column: fl.split([(c, o, None)], s.current.catalog)) == "no error"))
    rows.append(("numeric on text", _failure(lambda: s.add_filter_column("orders", "o_orderstatus", "numeric"))))
    return _steps(spark, rows)


OPERATORS_SQL = """
SELECT t || ' ' || o AS step,
  CASE WHEN o IN ('contains', 'prefix') THEN CASE WHEN t = 'text' THEN 'true' ELSE 'false' END
       WHEN o IN ('gt', 'gte', 'lt', 'lte', 'between') THEN CASE WHEN t IN ('numeric', 'date', 'timestamptz') THEN 'true' ELSE 'false' END ELSE 'true' END AS value
FROM (VALUES ('numeric'), ('text'), ('date'), ('timestamptz'), ('boolean'), ('uuid')) a(t), (VALUES ('eq'), ('neq'), ('gt'), ('gte'), ('lt'), ('lte'), ('between'), ('in'), ('not_in'), ('contains'), ('prefix'), ('is_null'), ('is_not_null')) b(o)
UNION ALL SELECT 'numeric on text', 'PG015 22023'"""


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = [{"table": "region", "id": "1"}, {"table": "nation", "id": "2"}, {"table": "customer", "id": "3"}]
    return _steps(spark, [
        ("node_ref_string", node_ref_string("nation", 'a"b')), ("format_path", format_path(path, ["up", "in"])), ("separator", format_path(path, ["up", "in"], " ; ")), ("one node", format_path(path[:1], [])),
        ("lengths differ", _failure(lambda: format_path(path, ["up"]))),
    ])


# -- patterns

MORE_PATTERNS: list[tuple[str, str, str, dict | None, Callable[[DataFrame], DataFrame] | None, str]] = [
    ("gql_collect", "trade", "MATCH (s:supplier)-[:based_in]->(n:nation) RETURN n.n_name AS nation, collect(s.s_suppkey) AS suppliers", None,
     lambda d: d.select("nation", F.array_join("suppliers", ",").alias("suppliers")),
     "SELECT n_name AS nation, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    ("gql_distinct_aggregates", "trade", "MATCH (p:part) RETURN p.p_brand AS brand, sum(DISTINCT p.p_size) AS sizes, avg(DISTINCT p.p_size) AS mean, min(DISTINCT p.p_size) AS low, max(DISTINCT p.p_size) AS high, count(DISTINCT p.p_type) AS types", None,
     lambda d: d.withColumns({"sizes": F.col("sizes").cast("long"), "mean": F.round("mean", 4)}),
     "SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes, round(avg(DISTINCT p_size), 4) AS mean, min(p_size) AS low, max(p_size) AS high, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand"),
    ("gql_optional_patterns", "trade", "OPTIONAL MATCH (c:customer)<-[:placed_by]-(o:orders), (c)-[:lives_in]->(n:nation) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS customer, o.o_orderkey AS big_order, n.n_name AS nation", None, None,
     "SELECT c.c_custkey AS customer, o_orderkey AS big_order, n_name AS nation FROM customer c LEFT JOIN orders ON o_custkey = c.c_custkey LEFT JOIN nation ON c.c_nationkey = n_nationkey WHERE o_totalprice > 400000"),
    ("gql_path_parts", "up", "MATCH p=(c:customer)-[:up*1..2]->(r:region) WHERE c.c_custkey < 50 RETURN id(c) AS customer, nodes(p) AS ns, relationships(p) AS rs, length(p) AS hops", None,
     lambda d: d.select("customer", F.size("ns").alias("n_nodes"), F.size("rs").alias("n_edges"), "hops"),
     "SELECT CAST(c_custkey AS VARCHAR) AS customer, 3 AS n_nodes, 2 AS n_edges, 2 AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey < 50"),
]


def _pattern(kind: str, query: str, params: dict | None, after: Callable[[DataFrame], DataFrame] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _session(spark, sf_dir, kind).gql_df(query, params)
        return after(out) if after else out

    return run


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "trade")
    return _steps(spark, [
        ("scan", s.gql_explain("MATCH (a:nation) RETURN a.n_name AS n")), ("lookup", s.gql_explain("MATCH (a:nation) WHERE id(a) = '1' RETURN a")),
        ("expand", s.cypher_explain("MATCH (a:nation)-[:in_region]->(b:region) RETURN a, b.r_name")),
        ("pgq", _failure(lambda: s.pgq(""))), ("unwind", _failure(lambda: s.cypher("UNWIND [1] AS x RETURN x"))), ("unknown label", _failure(lambda: s.gql("MATCH (a:nobody) RETURN a"))),
        ("unbounded", _failure(lambda: s.gql("MATCH (a)-[:knows*]-(b) RETURN a"))), ("missing parameter", _failure(lambda: s.gql("MATCH (a:nation) WHERE a.n_name = $x RETURN a"))), ("read only", _failure(lambda: s.gql("CREATE (a:nation {n_nationkey: 99}) RETURN a"))),
        ("bad filter", _failure(lambda: fl.parse({"where": {"a": {"like": 1}}}))), ("unknown node", _failure(lambda: _session(spark, sf_dir, "geo").traverse("nation", "no"))), ("not built", _failure(lambda: _geo(_new(spark, sf_dir, "region", "nation")).traverse("nation", "1"))),
        ("row predicate", _failure(lambda: s.create_row_predicate_subgraph("g", {}))),
    ])


EXPLAINED_SQL = _values(
    ("scan", "NodeScan(node=a:nation, return=[n])"), ("lookup", "NodeLookup(node=a:nation, lookup=identity, return=[a])"), ("expand", "Expand(source=a:nation, rel=in_region, hydration=edge_row, hops=1..1, target=b:region, return=[a, b.r_name])"),
    ("pgq", "PG018 0A000"), ("unwind", "PG014 0A000"), ("unknown label", "PG015 22023"), ("unbounded", "PG014 0A000"), ("missing parameter", "PG016 22023"), ("read only", "PG012 55000"), ("bad filter", "PG005 22023"), ("unknown node", "PG010 P0002"),
    ("not built", "PG003 55000"), ("row predicate", "PG018 0A000"),
)


# -- traversals with choices


def traverse_least_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes have many paths here; the least by table and id is the one reported."""
    rows = _session(spark, sf_dir, "sales").traverse("part", "7", 2, direction="out", hydrate=False, max_rows=None)
    return rows.select("node_table", "node_id", "depth", format_path_column(F.col("path"), F.col("edge_path")).alias("readable_path"))


_SALES = """e AS (
  SELECT 'orders' AS st, CAST(l_orderkey AS VARCHAR) AS si, 'part' AS dt, CAST(l_partkey AS VARCHAR) AS di, 'contains' AS ty, greatest(1, CAST(round(l_quantity) AS BIGINT)) AS w FROM lineitem
  UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), 'orders', CAST(l_orderkey AS VARCHAR), 'contains', greatest(1, CAST(round(l_quantity) AS BIGINT)) FROM lineitem
  UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), 'supplier', CAST(l_suppkey AS VARCHAR), 'supplied_by', greatest(1, CAST(round(l_quantity) AS BIGINT)) FROM lineitem),
o AS (SELECT * FROM (VALUES ('orders', 0), ('part', 1), ('supplier', 2)) v(t, k))"""
LEAST_PATHS_SQL = f"""
WITH {_SALES}, one AS (SELECT DISTINCT st, si, dt, di, ty FROM e),
p AS (
  SELECT 'part' AS t, '7' AS i, 0 AS d, [{{'k': 1, 'i': '7'}}] AS path, 'part:7' AS said
  UNION ALL SELECT dt, di, 1, [{{'k': 1, 'i': '7'}}, {{'k': k, 'i': di}}], 'part:7 --' || ty || '--> ' || dt || ':' || di FROM one JOIN o ON o.t = dt WHERE st = 'part' AND si = '7'
  UNION ALL SELECT b.dt, b.di, 2, [{{'k': 1, 'i': '7'}}, {{'k': o1.k, 'i': a.di}}, {{'k': o2.k, 'i': b.di}}],
    'part:7 --' || a.ty || '--> ' || a.dt || ':' || a.di || ' | ' || a.dt || ':' || a.di || ' --' || b.ty || '--> ' || b.dt || ':' || b.di
  FROM one a JOIN one b ON a.dt = b.st AND a.di = b.si JOIN o o1 ON o1.t = a.dt JOIN o o2 ON o2.t = b.dt WHERE a.st = 'part' AND a.si = '7'),
r AS (SELECT *, row_number() OVER (PARTITION BY t, i ORDER BY d, path, said) AS place FROM p)
SELECT t AS node_table, i AS node_id, d AS depth, said AS readable_path FROM r WHERE place = 1"""


def traverse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten rows, in the order of rows."""
    rows = _session(spark, sf_dir, "geo").traverse("region", "1", 2, direction="out", hydrate=False, max_rows=10, row_offset=10)
    return rows.select("root_id", "depth", "node_table", "node_id")


_REACH = "SELECT 0 AS depth, 'region' AS node_table, '1' AS node_id UNION ALL SELECT 1, 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, 'customer', CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 2, 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"


def traverse_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a tenant column show one tenant's rows; others show all."""
    s = _new(spark, sf_dir, "nation", "customer")
    s.add_table("nation", "n_nationkey")
    s.add_table("customer", "c_custkey", tenant_column="c_mktsegment")
    s.add_edge("customer", "c_nationkey", "nation", "n_nationkey", "lives_in")
    s.build()
    reached = s.traverse("nation", "4", 1, tenant="BUILDING", hydrate=False, max_rows=None).select(F.lit("traverse").alias("step"), "node_id")
    found = s.search_nodes("c_name", "Customer", "customer", max_rows=None, tenant="MACHINERY").select(F.lit("search").alias("step"), "node_id")
    s.settings.tenant = "BUILDING"
    said = s.gql_df("MATCH (c:customer)-[:lives_in]->(n:nation) WHERE id(n) = '5' RETURN id(c) AS node_id").select(F.lit("pattern").alias("step"), "node_id")
    return reached.unionByName(found).unionByName(said)


TENANTS_SQL = """
SELECT 'traverse' AS step, '4' AS node_id UNION ALL SELECT 'traverse', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 4 AND c_mktsegment = 'BUILDING'
UNION ALL SELECT 'search', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY' AND contains(lower(c_name), 'customer')
UNION ALL SELECT 'pattern', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'"""


# -- registration


def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _new(spark, sf_dir, "region", "nation", "customer", "supplier")
    s.create_graph("g")
    s.add_table_to_graph("g", "region", "r_regionkey", ["r_name"])
    s.add_table_to_graph("g", "nation", ["n_nationkey"])
    s.add_table_to_graph("g", "supplier", "s_suppkey")
    s.add_edge_to_graph("g", "nation", "n_regionkey", "region", "r_regionkey", "in_region")
    s.add_edge_to_graph("g", "supplier", "s_nationkey", "nation", "n_nationkey", "based_in", False)

    def edges() -> list[str]:
        return [f"{r.from_table} {r.label} {r.to_table} {_text(r.bidirectional)} {_text(r.weight_column)}" for r in s.registered_edges_for_graph("g").collect()]

    rows: list[tuple[str, Any]] = [("tables", ",".join(f"{r.table_name}({','.join(r.id_columns)}){_text(r.columns)}" for r in s.registered_tables_for_graph("g").collect())), ("edges", "; ".join(edges()))]
    s.alter_edge("g", "based_in", bidirectional=True, weight_column="s_acctbal")
    s.rename_edge("g", "in_region", "inside")
    rows += [("changed", "; ".join(edges())), ("unknown edge", _failure(lambda: s.remove_edge("g", "nothing")))]
    s.remove_edge("g", "based_in")
    rows.append(("edge removed", "; ".join(edges())))
    s.remove_table_from_graph("g", "region")
    rows += [("table removed", f"{s.registered_tables_for_graph('g').count()} {s.list_edges('g').count()}")]
    found = s.graph_map("g")
    rows += [("map", f"{found['graph']['name']} {[t['name'] for t in found['catalog']['tables']]} {found['status']['built']}"), ("map format", _failure(lambda: s.graph_map("g", "xml")))]
    rows.append(("discovered schema", s.preview_discover().count()))
    s.auto_discover_tables(["region", "nation"], build=False)
    rows.append(("discovered tables", ",".join(r.table_name for r in s.registered_tables().collect())))
    s.remove_table("region")
    rows.append(("left", ",".join(r.table_name for r in s.registered_tables().collect())))
    s.auto_discover(graph_name="g")
    rows.append(("discovered all", f"{s.registered_tables_for_graph('g').count()} {s.registered_edges_for_graph('g').count()}"))
    s.remove_edge_from_graph("g", "n_regionkey")
    rows += [("one less", s.registered_edges_for_graph("g").count()), ("missing column", _failure(lambda: s.add_table("customer", "nothing"))), ("no unique key", _failure(lambda: s.add_table("customer", "c_nationkey")))]
    return _steps(spark, rows)


REGISTRATION_SQL = _values(
    ("tables", 'nation(n_nationkey)null,region(r_regionkey)["r_name"],supplier(s_suppkey)null'), ("edges", "nation in_region region true null; supplier based_in nation false null"), ("changed", "nation inside region true null; supplier based_in nation true s_acctbal"),
    ("unknown edge", "PG015 22023"), ("edge removed", "nation inside region true null"), ("table removed", "2 0"), ("map", "g ['nation', 'supplier'] False"), ("map format", "PG015 22023"), ("discovered schema", "7"), ("discovered tables", "nation,region"), ("left", "nation"),
    ("discovered all", "4 3"), ("one less", "2"), ("missing column", "PG015 22023"), ("no unique key", "PG015 22023"),
)


# -- graphs, grants, quotas


def named_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _new(spark, sf_dir, "region", "nation")

    def row(df: DataFrame) -> str:
        r = df.head()
        return f"{r.graph_name} {_text(r.tenant)} {r.graph_kind} {r.residency} {r.projection_mode}"

    rows: list[tuple[str, Any]] = [("create", row(s.create_graph("a", "t1"))), ("again", _failure(lambda: s.create_graph("a", "t1"))), ("alter", row(s.alter_graph("a", "t1", residency="warm", projection_mode="mutable_overlay")))]
    rows += [("residency", row(s.set_graph_residency("a", "hot", "t1"))), ("bad residency", _failure(lambda: s.set_graph_residency("a", "lukewarm", "t1"))), ("list", ",".join(r.graph_name for r in s.list_graphs().collect()))]
    rows += [("set current", row(s.set_current_graph("a", "t1"))), ("current", s.current_graph().head().graph_name), ("selected", s.select_graph("a", "t1").head().loaded), ("same id", s._selected_graph_id_for_current_role() == s.current_graph().head().graph_id)]
    rows += [("grant", s.grant_graph("a", "someone", "read", "t1").head().privilege), ("grants", s.graph_privileges("a", "t1").count()), ("bad grant", _failure(lambda: s.grant_graph("a", "someone", "sing", "t1"))), ("revoke", s.revoke_graph("a", "someone", "read", "t1").count()), ("no grants", s.graph_privileges().count())]
    rows += [("owner", s.transfer_graph_ownership("a", "another", "t1").head().owner_role), ("quota", s.set_graph_quota("tenant", "graphs", 1, "t1").head().limit_value), ("quotas", s.graph_quotas().count()), ("usage", f"{(u := s.graph_quota_usage().head()).usage_value} {_text(u.exceeded)}")]
    rows += [("over quota", _failure(lambda: s.create_graph("b", "t1"))), ("drop", row(s.drop_graph("a", "t1"))), ("default again", s.current_graph().head().graph_name), ("unknown", _failure(lambda: s.drop_graph("a", "t1"))), ("enabled", s.test_enabled())]
    return _steps(spark, rows)


GRAPHS_SQL = _values(
    ("create", "a t1 user hot csr_readonly"), ("again", "PG015 22023"), ("alter", "a t1 user warm mutable_overlay"), ("residency", "a t1 user hot mutable_overlay"), ("bad residency", "PG015 22023"), ("list", "a,default"), ("set current", "a t1 user hot mutable_overlay"), ("current", "a"),
    ("selected", "false"), ("same id", "true"), ("grant", "read"), ("grants", "1"), ("bad grant", "PG015 22023"), ("revoke", "1"), ("no grants", "0"), ("owner", "another"), ("quota", "1"), ("quotas", "1"), ("usage", "1 false"), ("over quota", "PG007 54000"),
    ("drop", "a t1 user hot mutable_overlay"), ("default again", "default"), ("unknown", "PG015 22023"), ("enabled", "true"),
)


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another user may do before and after grants, and hard quotas of a build."""
    s = _geo(_new(spark, sf_dir, "region", "nation", mode="mutable_overlay"))
    s.build()
    read = "MATCH (r:region) RETURN count(*) AS n"
    rows: list[tuple[str, Any]] = []
    for privilege in (None, "read", "write", "build", "admin"):
        if privilege:
            s.grant_graph("default", "someone", privilege)
        s.act_as("someone")
        tried = {"read": lambda: s.gql_df(read), "traverse": lambda: s.traverse("region", "1", 1), "write": lambda: s.gql("MATCH (r:region) WHERE id(r) = '1' SET r.r_name = 'X' RETURN r"), "build": s.build, "alter": lambda: s.set_graph_residency("default", "hot")}
        rows += [(f"{_text(privilege)} {name}", _failure(run)) for name, run in tried.items()]
        s.act_as(s.host_user)
        if privilege:
            s.revoke_graph("default", "someone", privilege)
    s.set_graph_quota("graph", "nodes", 3, "default")
    rows.append(("nodes", _failure(s.build)))
    s.set_graph_quota("graph", "nodes", 10_000_000, "default")
    s.set_graph_quota("global", "edges", 2, enforcement="soft")
    rows.append(("soft", _failure(s.build)))
    profile = s.memory_profile(2).head()
    rows.append(("memory", profile.active_backend_total_mb >= profile.active_backend_private_mb > 0))
    return _steps(spark, rows)


_MAY = {"null": (), "read": ("read", "traverse"), "write": ("read", "traverse", "write"), "build": ("read", "traverse", "build"), "admin": ("read", "traverse", "write", "build", "alter")}
ACCESS_SQL = _values(
    *((f"{privilege} {name}", "no error" if name in may else "PG002 42501") for privilege, may in _MAY.items() for name in ("read", "traverse", "write", "build", "alter")),
    ("nodes", "PG007 54000"), ("soft", "no error"), ("memory", "true"),
)


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way to build, load, unload and maintain a graph of regions and nations."""
    s = _geo(_new(spark, sf_dir, "region", "nation"))

    def counts(r: Any) -> str:
        return f"{r.nodes_loaded} {r.edges_loaded}"

    rows: list[tuple[str, Any]] = [("build", counts(s.build().head())), ("mode", s.build("mutable_overlay").head().projection_mode), ("build_graph", counts(s.build_graph("default", True).head()))]
    job = s.build(concurrently=True).head()
    other = s.build_async_graph("default", "csr_readonly").head()
    s.wait(600)
    rows += [("build_status", f"{(r := s.build_status(job.build_id).head()).status} {counts(r)}"), ("other", s.build_status(other.build_id).head().status), ("unknown build", s.build_status("none").count()), ("of graph", s.build_status_for_graph("default").count())]
    rows += [("estimate", f"{(r := s.estimate().head()).estimated_nodes} {r.estimated_edges} {_text(r.fits_in_memory)}"), ("resources", s.build_resource_status().head().peak_phase)]
    rows += [("loaded", f"{(r := s.loaded_graphs().head()).graph_name} {r.node_count} {r.edge_count}"), ("runtime", f"{_text((r := s.graph_runtime_status().head()).loaded)} {_text(r.artifact_exists)}"), ("unload", s.unload_graph("default").head().unloaded), ("none loaded", s.loaded_graphs().count())]
    rows += [("load", f"{(r := s.load_graph('default').head()).node_count} {r.edge_count}"), ("active", s.active_generation_count()), ("vacuum", f"{(r := s.vacuum().head()).nodes_after} {r.edges_rebuilt}"), ("vacuum_graph", s.vacuum_graph("default").head().nodes_before)]
    rows += [("maintenance", f"{(r := s.maintenance().head()).status} {r.nodes_after}"), ("maintenance_graph", s.maintenance_graph("default").head().status), ("upkeep", s.maintenance_status().count()), ("upkeep of graph", s.maintenance_status_for_graph("default").count()), ("scheduled", s.run_scheduled_maintenance().head().message)]
    rows += [("profile", s.memory_profile(3).head().assumed_concurrent_backends), ("resource rows", s.resource_status().count()), ("unidirectional", s.status().head().has_unidirectional_edges)]
    s.reset()
    rows.append(("reset", s.loaded_graphs().count()))
    return _steps(spark, rows)


BUILDS_SQL = """
WITH c AS (SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS VARCHAR) AS n, CAST((SELECT count(*) FROM nation) AS VARCHAR) AS e)
SELECT step, CASE WHEN value LIKE '%N%' OR value LIKE '%E%' THEN replace(replace(value, 'N', n), 'E', e) ELSE value END AS value FROM c, (VALUES
('build', 'N E'), ('mode', 'mutable_overlay'), ('build_graph', 'N E'), ('build_status', 'completed N E'), ('other', 'completed'), ('unknown build', '0'), ('of graph', '2'), ('estimate', 'N E true'), ('resources', 'built'), ('loaded', 'default N E'), ('runtime', 'true true'),
('unload', 'true'), ('none loaded', '0'), ('load', 'N E'), ('active', '1'), ('vacuum', 'N E'), ('vacuum_graph', 'N'), ('maintenance', 'completed N'), ('maintenance_graph', 'completed'), ('upkeep', '2'), ('upkeep of graph', '2'), ('scheduled', 'nothing to do'),
('profile', '3'), ('resource rows', '1'), ('unidirectional', 'true'), ('reset', '0')) v(step, value)"""


# -- sync, generations, jobs

_LOG = [
    (1, "nation", "I", None, "100", None, '{"n_nationkey":100,"n_name":"NEW","n_regionkey":1}'),
    (2, "nation", "U", "3", "103", None, '{"n_nationkey":103,"n_name":"RENAMED KEY","n_regionkey":0}'),
    (3, "nation", "D", "4", None, None, None),
    (4, "nation", "U", "100", "100", None, '{"n_nationkey":100,"n_name":"NEWER","n_regionkey":2}'),
]
_AFTER_LOG = "n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL VALUES (100, 'NEWER', 2), (103, 'RENAMED KEY', 0))"


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key changes, an update of an inserted row, then a truncation and what follows it."""
    s = _geo(_new(spark, sf_dir, "region", "nation", query_freshness="off"))
    s.build()
    s.enable_sync(spark.createDataFrame(_LOG, LOG_SCHEMA))
    rows: list[tuple[str, Any]] = [("waiting", s.sync_health().head().pending_sync_rows), ("pending", s._pending_sync_rows_for_current_role(1)), ("last", s._max_sync_log_id_for_current_role())]
    s.settings.set("query_freshness", "error_on_pending")
    rows.append(("stale", _failure(s.graph)))
    s.settings.set("query_freshness", "apply_pending_sync")
    r = s.apply_sync().head()
    rows.append(("applied", f"{r.inserts_applied} {r.updates_applied} {r.deletes_applied}"))
    by_region = s.gql_df("MATCH (n:nation)-[:in_region]->(r:region) RETURN r.r_regionkey AS region, count(*) AS n, max(n.n_name) AS name ORDER BY region").collect()
    rows += [(f"region {x.region}", f"{x.n} {x.name}") for x in by_region]
    rows.append(("reached", s.traverse("nation", "103", 1, hydrate=False).count()))
    s.apply_changes(spark.createDataFrame([(5, "nation", "T", None, None, None, None), (6, "nation", "I", None, "7", None, '{"n_nationkey":7,"n_name":"ONLY","n_regionkey":4}')], LOG_SCHEMA))
    rows += [("truncated", ",".join(x.k for x in s.gql_df("MATCH (n:nation) RETURN id(n) AS k").collect())), ("unknown row", _failure(lambda: s.apply_changes(spark.createDataFrame([(9, "nation", "D", "5", None, None, None)], LOG_SCHEMA))))]
    return _steps(spark, rows)


SYNCED_SQL = f"""
WITH {_AFTER_LOG}
SELECT 'region ' || n_regionkey AS step, count(*) || ' ' || max(n_name) AS value FROM n GROUP BY n_regionkey
UNION ALL SELECT * FROM (VALUES ('waiting', '4'), ('pending', '3'), ('last', '4'), ('stale', 'PG017 22000'), ('applied', '1 2 1'), ('reached', '2'), ('truncated', '7'), ('unknown row', 'PG010 P0002')) v(a, b)"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, a delta segment on it, compaction, garbage and repair."""
    s = _geo(_new(spark, sf_dir, "region", "nation", query_freshness="off"))
    s.build()
    rows: list[tuple[str, Any]] = [("no snapshot", _failure(s.ingest_projection))]
    s.save_graph()
    s.enable_sync(spark.createDataFrame(_LOG, LOG_SCHEMA))
    r = s.projection_status().head()
    rows.append(("saved", f"{r.segment_count} {r.pending_durable_rows} {r.artifact_validation_state}"))
    r = s.ingest_projection().head()
    rows.append(("ingested", f"{r.rows_ingested} {r.segments_published} {r.sync_watermark}"))

    def read() -> str:
        g = s.store(s.current).read()
        return f"{g.nodes.count()} {g.edges.count()} {g.edges.agg(F.sum(F.col('dst_id').cast('long'))).head()[0]}"

    rows += [("layered", read()), ("again", s.ingest_projection().head().rows_ingested)]
    r = s.projection_compact().head()
    rows += [("compacted", f"{r.segments_compacted} {r.segment_count}"), ("compact", read()), ("garbage", s.projection_gc().head().deleted_files > 0), ("sound", s.projection_repair().head().action), ("after", read())]
    return _steps(spark, rows)


GENERATIONS_SQL = f"""
WITH {_AFTER_LOG}, c AS (SELECT (SELECT count(*) FROM n) + (SELECT count(*) FROM region) || ' ' || (SELECT count(*) FROM n) || ' ' || (SELECT sum(n_regionkey) FROM n) AS all_)
SELECT step, coalesce(value, all_) AS value FROM c, (VALUES ('no snapshot', 'PG003 55000'), ('saved', '0 4 valid'), ('ingested', '4 1 4'), ('layered', NULL), ('again', '0'), ('compacted', '1 0'), ('compact', NULL), ('garbage', 'true'), ('sound', 'none'), ('after', NULL)) v(step, value)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _geo(_new(spark, sf_dir, "region", "nation", query_freshness="off"))
    s.build()
    s.enable_sync(spark.createDataFrame(_LOG, LOG_SCHEMA))
    p = s.add_sync_policy("default", 30, 100).head()
    rows: list[tuple[str, Any]] = [("policy", f"{p.graph_name} {_text(p.enabled)} {p.schedule_interval_secs} {p.max_sync_lag_rows}"), ("altered", s.alter_sync_policy(p.policy_id, 60).head().schedule_interval_secs)]
    rows += [("run", f"{(r := s.run_sync_policy(p.policy_id).head()).status} {r.rows_applied}"), ("status", s.sync_policy_status("default").head().last_status), ("jobs", s.jobs("default").head().policy_kind), ("runs", s.job_runs(p.job_id).count())]
    rows += [("run_job", s.run_job(p.job_id).head().rows_applied), ("stats", f"{(r := s.job_stats('default').head()).job_count} {r.run_count} {r.failed_runs}"), ("not due", s.run_due_jobs().count()), ("async", s.run_due_jobs_async()), ("alter_job", s.alter_job(p.job_id, False, max_retries=5).head().max_retries)]
    rows += [("dropped", s.drop_sync_policy(p.policy_id).head().dropped), ("unknown", _failure(lambda: s.run_job(p.job_id)))]
    q = s.add_sync_policy("default").head()
    rows += [("removed", s.remove_job(q.job_id).head().removed), ("none", s.jobs().count()), ("bad interval", _failure(lambda: s.add_sync_policy("default", 0)))]
    return _steps(spark, rows)


JOBS_SQL = _values(
    ("policy", "default true 30 100"), ("altered", "60"), ("run", "completed 4"), ("status", "completed"), ("jobs", "sync"), ("runs", "1"), ("run_job", "0"), ("stats", "1 2 0"), ("not due", "0"), ("async", "true"), ("alter_job", "5"), ("dropped", "true"), ("unknown", "PG015 22023"),
    ("removed", "true"), ("none", "0"), ("bad interval", "PG015 22023"),
)


# -- writes


def _supplies(spark: SparkSession, sf_dir: str) -> Session:
    """Parts and suppliers, and an edge table of who supplies what, as lines tell."""
    s = _new(spark, sf_dir, "part", "supplier", mode="mutable_overlay")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("times")).select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), "times")
    s.source("supplies", pairs, "id", [("part_id", "part", "p_partkey"), ("supplier_id", "supplier", "s_suppkey")])
    s.add_table("part", "p_partkey", check=False)
    s.add_table("supplier", "s_suppkey", check=False)
    s.add_edge("supplies", "part_id", "supplier", "supplier_id", "supplied_by", False)
    return s


def edge_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each supplier after each kind of write, and a rolled back one."""
    s = _supplies(spark, sf_dir)
    s.gql("CREATE (p:part {p_partkey: 90000001, p_name: 'NEW'}) RETURN p")
    for k in (1, 2):
        s.gql("MATCH (p:part), (q:supplier) WHERE id(p) = '90000001' AND id(q) = $k CREATE (p)-[r:supplied_by {id: $r, times: 5}]->(q) RETURN r", {"k": str(k), "r": f"new-{k}"})
    s.gql("MATCH (p:part)-[r:supplied_by]->(q:supplier) WHERE id(p) = '90000001' AND id(q) = '2' DELETE r RETURN id(p) AS p")
    s.gql("MATCH (q:supplier) WHERE id(q) = '3' DETACH DELETE q RETURN q")
    s.gql("MERGE (q:supplier {s_suppkey: 4}) ON MATCH SET q.s_name = 'MERGED' ON CREATE SET q.s_name = 'CREATED' RETURN q")
    s.savepoint("here")
    s.gql("MATCH (q:supplier) WHERE id(q) = '5' DETACH DELETE q RETURN q")
    s.rollback_to("here")
    return s.gql_df("MATCH (p:part)-[r:supplied_by]->(q:supplier) RETURN id(q) AS supplier, q.s_name AS name, count(*) AS parts")


EDGE_WRITES_SQL = """
WITH e AS (SELECT l_partkey AS p, l_suppkey AS q, count(*) AS times FROM lineitem GROUP BY l_partkey, l_suppkey UNION ALL VALUES (90000001, 1, 5))
SELECT CAST(s_suppkey AS VARCHAR) AS supplier, CASE WHEN s_suppkey = 4 THEN 'MERGED' ELSE s_name END AS name, count(*) AS parts
FROM e JOIN supplier ON q = s_suppkey WHERE s_suppkey <> 3 GROUP BY s_suppkey, s_name"""


def write_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _supplies(spark, sf_dir)
    rows = [
        ("key exists", _failure(lambda: s.gql("CREATE (q:supplier {s_suppkey: 1}) RETURN q"))), ("more than one", _failure(lambda: s.gql("MATCH (q:supplier) WHERE q.s_suppkey > 0 SET q.s_name = 'x' RETURN q"))),
        ("unknown property", _failure(lambda: s.gql("CREATE (q:supplier {s_suppkey: 90000001, nothing: 1}) RETURN q"))),
    ]
    s.gql("CREATE (q:supplier {s_suppkey: 90000002}) RETURN q")
    r = s.status().head()
    rows.append(("overlay", f"{_text(r.tx_delta_dirty)} {r.tx_delta_added_nodes}"))
    return _steps(spark, rows)


#: Name, query, the same in SQL (None: rows only).
MORE: list[tuple[str, Query, str | None]] = [
    ("filter_constructors", filter_constructors, CONSTRUCTORS_SQL), ("filter_pruning", _operators(_PRUNING), _operators_sql(_PRUNING)), ("filter_applied", _operators(_APPLIED), _operators_sql(_APPLIED)),
    ("operators_by_type", operators_by_type, OPERATORS_SQL),
    ("text_forms", text_forms, _values(("node_ref_string", '["nation", "a\\"b"]'), ("format_path", "region:1 --up--> nation:2 | nation:2 --in--> customer:3"), ("separator", "region:1 --up--> nation:2 ; nation:2 --in--> customer:3"), ("one node", "region:1"), ("lengths differ", "PG015 22023"))),
    *((name, _pattern(kind, query, params, after), sql) for name, kind, query, params, after, sql in MORE_PATTERNS),
    ("explained", explained, EXPLAINED_SQL), ("traverse_least_paths", traverse_least_paths, LEAST_PATHS_SQL),
    ("traverse_pages", traverse_pages, f"SELECT '1' AS root_id, depth, node_table, node_id FROM ({_REACH}) ORDER BY depth, node_table, node_id LIMIT 10 OFFSET 10"), ("traverse_tenants", traverse_tenants, TENANTS_SQL),
    ("registration", registration, REGISTRATION_SQL), ("named_graphs", named_graphs, GRAPHS_SQL), ("access", access, ACCESS_SQL), ("builds", builds, BUILDS_SQL), ("synced", synced, SYNCED_SQL), ("generations", generations, GENERATIONS_SQL), ("jobs", jobs, JOBS_SQL),
    ("edge_writes", edge_writes, EDGE_WRITES_SQL), ("write_guards", write_guards, _values(("key exists", "PG017 22000"), ("more than one", "PG017 22000"), ("unknown property", "PG015 22023"), ("overlay", "true 1"))),
]


def queries() -> dict[str, Query]:
    return {name: run for name, run, _ in MORE}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in MORE if sql}

"""The library's query set over the star-schema tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import filters as fl
from trellis.functions.paths import format_path_column
from trellis.session import Session
from trellis.settings import Settings
from trellis.streaming.sync import LOG_SCHEMA

TABLES = {
    "region": ("r_regionkey", []),
    "nation": ("n_nationkey", [("n_regionkey", "region", "r_regionkey")]),
    "customer": ("c_custkey", [("c_nationkey", "nation", "n_nationkey")]),
    "supplier": ("s_suppkey", [("s_nationkey", "nation", "n_nationkey")]),
    "part": ("p_partkey", []),
    "orders": ("o_orderkey", [("o_custkey", "customer", "c_custkey")]),
    "lineitem": ((), [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")]),
    "events": ("event_id", [("user_id", "customer", "c_custkey")]),
    "documents": ("doc_id", []),
    "labels": ("doc_id", [("doc_id", "documents", "doc_id")]),
    "conversations": (("conv_id", "turn"), []),
}
_kept: dict[tuple, Session] = {}


def _session(spark: SparkSession, sf_dir: str, kind: str) -> Session:
    """One session for each folder and kind of graph, so that a built graph is reused."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _kept:
        s = Session(spark, Settings(max_nodes=None, max_frontier=None, max_exact_path_count=None))
        for name, (pk, fks) in TABLES.items():
            s.source(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), pk, fks)
        {"trade": _trade, "up": _up, "geo": _geo, "sales": _sales}[kind](s)
        _kept[key] = s
    return _kept[key]


def _tables(s: Session, *names: str) -> None:
    for name in names:
        s.add_table(name, TABLES[name][0], check=False)


def _trade(s: Session) -> None:
    """All tables; every edge has its own label and one direction."""
    _tables(s, "region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "labels", "conversations")
    s.add_edge("nation", "n_regionkey", "region", "r_regionkey", "in_region", False)
    s.add_edge("customer", "c_nationkey", "nation", "n_nationkey", "lives_in", False)
    s.add_edge("supplier", "s_nationkey", "nation", "n_nationkey", "based_in", False)
    s.add_edge("orders", "o_custkey", "customer", "c_custkey", "placed_by", False)
    s.add_edge("lineitem", "l_orderkey", "part", "l_partkey", "contains", False, "l_quantity")
    s.add_edge("lineitem", "l_partkey", "supplier", "l_suppkey", "supplied_by", False)
    s.add_edge("lineitem", "l_orderkey", "supplier", "l_suppkey", "returned", False, None, "l_returnflag")
    s.add_edge("events", "user_id", "customer", "c_custkey", "by_user", False)
    s.add_edge("labels", "doc_id", "documents", "doc_id", "about", False)


def _up(s: Session) -> None:
    """The hierarchy under one label, so that a pattern can climb it."""
    _tables(s, "region", "nation", "customer", "orders")
    s.add_edge("nation", "n_regionkey", "region", "r_regionkey", "up", False)
    s.add_edge("customer", "c_nationkey", "nation", "n_nationkey", "up", False)
    s.add_edge("orders", "o_custkey", "customer", "c_custkey", "up", False)
    s.add_filter_column("customer", "c_acctbal", "numeric")
    s.build()


def _geo(s: Session) -> None:
    """Regions to suppliers, travelled both ways."""
    _tables(s, "region", "nation", "customer", "supplier", "part")
    s.add_edge("nation", "n_regionkey", "region", "r_regionkey", "in_region")
    s.add_edge("customer", "c_nationkey", "nation", "n_nationkey", "lives_in")
    s.add_edge("supplier", "s_nationkey", "nation", "n_nationkey", "based_in")
    s.build()


def _sales(s: Session) -> None:
    """Orders and parts with line quantities as weights."""
    _tables(s, "orders", "part", "supplier")
    s.add_edge("lineitem", "l_orderkey", "part", "l_partkey", "contains", True, "l_quantity")
    s.add_edge("lineitem", "l_partkey", "supplier", "l_suppkey", "supplied_by", False, "l_quantity")
    s.build()


def _gql(kind: str, query: str, params: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _session(spark, sf_dir, kind).gql_df(query, params)


#: Name, graph, pattern query, parameters, the same in SQL.
PATTERNS: list[tuple[str, str, str, dict | None, str]] = [
    ("gql_one_hop", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer) WHERE o.o_orderstatus = $s RETURN o.o_orderkey AS order_id, c.c_name AS customer", {"s": "F"},
     "SELECT o_orderkey AS order_id, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
    ("gql_node_scan", "trade", "MATCH (p:part) WHERE p.p_size >= 10 AND p.p_size < 20 OR p.p_retailprice > 1900 RETURN p.p_partkey AS part, p.p_size AS size", None,
     "SELECT p_partkey AS part, p_size AS size FROM part WHERE (p_size >= 10 AND p_size < 20) OR p_retailprice > 1900"),
    ("gql_node_lookup", "trade", "MATCH (c:customer) WHERE id(c) = '42' RETURN id(c) AS node_id, c.c_name AS name", None,
     "SELECT CAST(c_custkey AS VARCHAR) AS node_id, c_name AS name FROM customer WHERE c_custkey = 42"),
    ("gql_not_and_in", "trade", "MATCH (c:customer) WHERE NOT c.c_mktsegment IN ['BUILDING', 'MACHINERY'] AND c.c_acctbal <= 100 RETURN c.c_custkey AS customer, c.c_mktsegment AS segment", None,
     "SELECT c_custkey AS customer, c_mktsegment AS segment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal <= 100"),
    ("gql_null_tests", "trade", "MATCH (c:customer) WHERE c.c_name IS NOT NULL AND NOT c.c_nationkey IS NULL RETURN count(*) AS n", None,
     "SELECT count(*) AS n FROM customer WHERE c_name IS NOT NULL AND c_nationkey IS NOT NULL"),
    ("gql_inline_properties", "trade", "MATCH (n:nation {n_regionkey: $r}) RETURN n.n_name AS nation", {"r": 2},
     "SELECT n_name AS nation FROM nation WHERE n_regionkey = 2"),
    ("gql_distinct", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer) RETURN DISTINCT c.c_mktsegment AS segment, o.o_orderstatus AS status", None,
     "SELECT DISTINCT c_mktsegment AS segment, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("gql_order_skip_limit", "trade", "MATCH (o:orders) RETURN o.o_orderkey AS k, o.o_totalprice AS price ORDER BY price DESC, k SKIP 5 LIMIT 20", None,
     "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY price DESC NULLS LAST, k LIMIT 20 OFFSET 5"),
    ("gql_aggregates", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer) RETURN c.c_mktsegment AS segment, count(*) AS n, sum(o.o_totalprice) AS total, avg(o.o_totalprice) AS mean, min(o.o_totalprice) AS lowest, max(o.o_totalprice) AS highest", None,
     "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    ("gql_count_distinct", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer) RETURN o.o_orderpriority AS priority, count(DISTINCT c.c_custkey) AS customers, count(o) AS orders", None,
     "SELECT o_orderpriority AS priority, count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority"),
    ("gql_aggregate_of_nothing", "trade", "MATCH (c:customer) WHERE c.c_acctbal > 1000000 RETURN count(*) AS n, sum(c.c_acctbal) AS total", None,
     "SELECT count(*) AS n, sum(c_acctbal) AS total FROM customer WHERE c_acctbal > 1000000"),
    ("gql_inbound", "trade", "MATCH (r:region)<-[:in_region]-(n:nation) RETURN r.r_name AS region, n.n_name AS nation", None,
     "SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey"),
    ("gql_undirected", "trade", "MATCH (n:nation)-[:in_region]-(r:region) RETURN n.n_name AS nation, r.r_name AS region", None,
     "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    ("gql_reverse_rows", "geo", "MATCH (r:region)-[:in_region]->(n:nation) RETURN r.r_name AS region, count(n) AS nations", None,
     "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    ("gql_optional", "trade", "OPTIONAL MATCH (c:customer)<-[:placed_by]-(o:orders) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS customer, o.o_orderkey AS big_order", None,
     "SELECT c_custkey AS customer, o_orderkey AS big_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000"),
    ("gql_optional_node", "trade", "OPTIONAL MATCH (c:customer) WHERE c.c_acctbal > 1000000 RETURN count(*) AS all_rows, count(c) AS customers", None,
     "SELECT 1 AS all_rows, 0 AS customers"),
    ("gql_chain", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer), (c)-[:lives_in]->(n:nation), (n)-[:in_region]->(r:region) RETURN r.r_name AS region, count(*) AS n, sum(o.o_totalprice) AS total", None,
     "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    ("gql_edge_table", "trade", "MATCH (o:orders)-[:contains]->(p:part) WHERE o.o_orderstatus = 'O' RETURN p.p_brand AS brand, count(*) AS line_count", None,
     "SELECT p_brand AS brand, count(*) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'O' GROUP BY p_brand"),
    ("gql_dynamic_label", "trade", "MATCH (o:orders)-[:R]->(s:supplier) RETURN s.s_name AS supplier, count(*) AS returned", None,
     "SELECT s_name AS supplier, count(*) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY s_name"),
    ("gql_shared_target", "trade", "MATCH (a:customer)-[:lives_in]->(n:nation), (s:supplier)-[:based_in]->(n) RETURN n.n_name AS nation, count(*) AS pairs", None,
     "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"),
    ("gql_with", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer) WITH DISTINCT c.c_custkey AS k, o.o_orderstatus AS st RETURN st AS status, count(*) AS customers", None,
     "SELECT st AS status, count(*) AS customers FROM (SELECT DISTINCT c_custkey AS k, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY st"),
    ("gql_with_aggregate", "trade", "MATCH (o:orders)-[:placed_by]->(c:customer), (c)-[:lives_in]->(n:nation) WITH c.c_custkey AS k, n.n_name AS nation, count(*) AS orders RETURN nation AS nation, max(orders) AS most", None,
     "SELECT nation, max(orders) AS most FROM (SELECT c_custkey, n_name AS nation, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY nation"),
    ("gql_json_path", "trade", "MATCH (e:events)-[:by_user]->(c:customer) WHERE e.props.k = 7 RETURN e.event_id AS event, c.c_custkey AS customer", None,
     "SELECT event_id AS event, c_custkey AS customer FROM events JOIN customer ON user_id = c_custkey WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7"),
    ("gql_timestamps", "trade", "MATCH (o:orders) WHERE o.o_orderdate >= '1996-01-01' AND o.o_orderdate < '1996-07-01' RETURN o.o_orderkey AS k", None,
     "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'"),
    ("gql_composite_key", "trade", "MATCH (t:conversations) WHERE t.role = 'assistant' RETURN id(t) AS node_id, t.conv_id AS conv_id", None,
     "SELECT '[\"' || conv_id || '\", \"' || turn || '\"]' AS node_id, conv_id FROM conversations WHERE role = 'assistant'"),
    ("gql_labels", "trade", "MATCH (l:labels)-[:about]->(d:documents) WHERE l.toxic = 1 RETURN d.lang AS lang, count(*) AS n", None,
     "SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY lang"),
    ("gql_variable_length", "up", "MATCH (o:orders)-[:up*1..3]->(r:region) WHERE o.o_orderstatus = 'P' RETURN r.r_name AS region, count(*) AS orders", None,
     "SELECT r_name AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P' GROUP BY r_name"),
    ("gql_variable_length_join", "up", "MATCH (o:orders)-[:up*2]->(n:nation), (n)-[:up]->(r:region) RETURN n.n_name AS nation, r.r_name AS region, count(*) AS orders", None,
     "SELECT n_name AS nation, r_name AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name"),
    ("gql_wildcard_path", "up", "MATCH p=(c:customer)-[]->()-[:up*1..2]->(r:region) RETURN id(c) AS customer, id(r) AS region, length(p) AS hops", None,
     "SELECT CAST(c_custkey AS VARCHAR) AS customer, CAST(r_regionkey AS VARCHAR) AS region, 2 AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
]

_ROUND = {"total": 2, "mean": 4}


def _rounded(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Sums of doubles depend on their order in the last digits."""

    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({c: F.round(c, n) for c, n in _ROUND.items() if c in df.columns})

    return rounded


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("root_id", "node_table", "node_id", "depth")


def traverse_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_session(spark, sf_dir, "up").traverse("region", "1", 2, direction="in", hydrate=False, max_rows=None))


def traverse_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_session(spark, sf_dir, "geo").traverse("supplier", "7", 3, hydrate=False, max_rows=None))


def traverse_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_session(spark, sf_dir, "up").traverse(["nation", "nation", "nation"], ["3", "4", "5"], 2, direction="in", uniqueness="node_per_root", hydrate=False, max_rows=None))


def traverse_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_session(spark, sf_dir, "up").traverse(["customer", "customer", "nation"], ["3", "4", "5"], 3, hydrate=False, max_rows=None)).select("node_table", "node_id")


def traverse_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "up")
    return _flat(s.traverse("nation", "3", 3, direction="in", filter=fl.on_node(fl.at_least("c_acctbal", 5000)), hydrate=False, max_rows=None))


def traverse_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "up")
    return _flat(s.traverse("nation", "3", 3, direction="in", filter=fl.all_([fl.equals("o_orderstatus", "P"), fl.greater_than("o_totalprice", 50000)]), hydrate=False, max_rows=None))


def traverse_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_session(spark, sf_dir, "geo").traverse("region", "2", 2, ["in_region", "based_in"], node_tables=["supplier"], hydrate=False, max_rows=None))


def traverse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _session(spark, sf_dir, "up").traverse("customer", "11", 3, hydrate=False, max_rows=None)
    return rows.select("node_id", "depth", format_path_column(F.col("path"), F.col("edge_path")).alias("readable_path"))


def traverse_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "up").traverse("nation", "6", 2, direction="in", strategy="dfs", hydrate=False, max_rows=None).select("node_table", "node_id", "depth")


def traverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_session(spark, sf_dir, "up").traverse_search("n_name", "NATION_1", "nation", "prefix", True, max_depth=1, hydrate=False, max_rows=None))


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").get_neighbors("default", "nation", "9", hydrate=False, max_rows=None).select("node_table", "node_id", "depth")


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").get_node("default", "customer", "17", hydrate=False).select("node_table", "node_id")


def _search(mode: str, value: str, sensitive: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _session(spark, sf_dir, "trade").search_nodes("p_name", value, "part", mode, sensitive, None).select("node_table", "node_id", "match_type")

    return run


def hydrated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").search("s_name", "supplier", "supplier", max_rows=None).select("node_id", F.get_json_object("node", "$.s_name").alias("name"))


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "up").shortest_path("customer", "5", "region", _region_of(spark, sf_dir, 5), hydrate=False).select("step", "node_table", "node_id", "edge_label")


def _region_of(spark: SparkSession, sf_dir: str, customer: int) -> str:
    s = _session(spark, sf_dir, "trade")
    return s.gql_df("MATCH (c:customer)-[:lives_in]->(n:nation), (n)-[:in_region]->(r:region) WHERE c.c_custkey = $c RETURN id(r) AS r", {"c": customer}).head().r


def cheapest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "sales")
    a, b = (r.k for r in s.gql_df("MATCH (o:orders)-[:contains]->(p:part) RETURN DISTINCT id(o) AS k ORDER BY k LIMIT 2").collect())
    return s.weighted_shortest_path("orders", a, "orders", b).agg(F.max("total_cost").alias("cost"))


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").component_stats()


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").components(10).select("component_size", "rank")


def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").connected_components().select("node_table", "node_id", "component_size")


def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").largest_component(None, hydrate=False).select("node_table", "node_id")


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").isolated_nodes(None, hydrate=False).select("node_table", "node_id")


def _aggregate(scope: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _session(spark, sf_dir, "up")
        found = s.aggregate(
            {"starts": [["nation", "3"]], "max_depth": 2, "direction": "in"},
            [{"function": f, "table": "customer", "column": "c_acctbal", "alias": a} for f, a in (("sum", "total"), ("count", "n"))], scope, None,
        )
        return s.rows([(round(found["total"], 2), found["n"])], "total double, n long")

    return run


def path_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").path_count_estimate({"starts": [["region", "1"]], "min_depth": 1, "max_depth": 2, "direction": "out"})


def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").find("c_name", "customer", "customer", max_rows=None).select("node_id", "rank")


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").expand("region", "0", 2, target_table="supplier", max_rows=None).select("node_table", "node_id", "depth", "readable_path", "truncated")


def find_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").find_related("n_name", "NATION_2", "nation", "exact", True, max_depth=1, target_table="supplier", max_rows=None, candidate_limit=None, include_counts=True).select("node_table", "node_id", "depth", "filtered_count")


def readable_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "up").path("customer", "5", "region", _region_of(spark, sf_dir, 5)).select("step", "node_id", "readable_path")


def connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").connection("n_name", "NATION_1", "n_name", "NATION_6", "nation", "nation", 1, 1, "exact").select("source_id", "target_id", "hop_count", "step")


def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").neighborhood("n_name", "NATION_4", "nation", "exact", max_depth=1, node_limit=None).select("depth", "node_table", "node_count", "truncated")


def registered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "up").registered_edges().select("from_table", "from_column", "to_table", "label", "bidirectional")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "trade").preview_discover_tables(["region", "nation", "customer"])


def built_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "geo").status().select("node_count", "edge_count", "has_unidirectional_edges")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "trade").gql("MATCH (r:region) RETURN r, id(r) AS k")


def compatible_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "trade")
    return s.cypher("MATCH (n:nation) RETURN n.n_name AS nation").select(F.get_json_object("row", "$.nation").alias("nation"))


def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "trade").cypher_compatibility()


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region after an insertion, an update that moves one, and a deletion."""
    s = Session(spark)
    for name in ("region", "nation"):
        s.source(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), *TABLES[name])
    _tables(s, "region", "nation")
    s.add_edge("nation", "n_regionkey", "region", "r_regionkey", "in_region", False)
    s.build()
    log = [
        (1, "nation", "I", None, "100", None, '{"n_nationkey":100,"n_name":"NEW","n_regionkey":1}'),
        (2, "nation", "U", "3", "3", None, '{"n_nationkey":3,"n_name":"MOVED","n_regionkey":0}'),
        (3, "nation", "D", "4", None, None, None),
    ]
    s.enable_sync(spark.createDataFrame(log, LOG_SCHEMA))
    s.apply_sync()
    return s.gql_df("MATCH (n:nation)-[:in_region]->(r:region) RETURN r.r_regionkey AS region, count(*) AS nations, min(n.n_name) AS first")


def overlay_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions after each kind of node write."""
    s = Session(spark, Settings(default_projection_mode="mutable_overlay"))
    s.source("region", spark.read.parquet(f"{sf_dir}/region.parquet"), "r_regionkey")
    _tables(s, "region")
    s.gql("CREATE (r:region {r_regionkey: 10, r_name: 'TEN'}) RETURN r")
    s.gql("MERGE (r:region {r_regionkey: 11}) ON CREATE SET r.r_name = 'ELEVEN' RETURN r")
    s.gql("MATCH (r:region) WHERE id(r) = '0' SET r.r_name = 'ZERO' RETURN r")
    s.gql("MATCH (r:region) WHERE id(r) = '1' REMOVE r.r_name RETURN r")
    s.gql("MATCH (r:region) WHERE id(r) = '2' DETACH DELETE r RETURN r")
    return s.gql_df("MATCH (r:region) RETURN r.r_regionkey AS region, r.r_name AS name")


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "geo")
    s.save_graph()
    g = s.store(s.current).read()
    return g.edges.groupBy("type").agg(F.count("*").alias("n"))


_UP_EDGES = "(SELECT 'region' AS st, CAST(r_regionkey AS VARCHAR) AS si, 'nation' AS dt, CAST(n_nationkey AS VARCHAR) AS di FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), 'customer', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), 'orders', CAST(o_orderkey AS VARCHAR) FROM orders)"
_GEO_ONE = "SELECT 'nation' AS st, CAST(n_nationkey AS VARCHAR) AS si, 'region' AS dt, CAST(n_regionkey AS VARCHAR) AS di, 'in_region' AS ty FROM nation UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), 'lives_in' FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR), 'based_in' FROM supplier"
_GEO_EDGES = f"(SELECT * FROM ({_GEO_ONE}) UNION ALL SELECT dt, di, st, si, ty FROM ({_GEO_ONE}))"


def _bfs_sql(edges: str, roots: str, depth: int, where: str = "true", step: str = "true") -> str:
    return f"""
WITH RECURSIVE e AS (SELECT * FROM {edges}), r AS (
  SELECT ri AS root_id, rt AS t, ri AS i, 0 AS d FROM (VALUES {roots}) v(rt, ri)
  UNION SELECT r.root_id, e.dt, e.di, r.d + 1 FROM r JOIN e ON e.st = r.t AND e.si = r.i WHERE r.d < {depth} AND {step}
)
SELECT root_id, t AS node_table, i AS node_id, min(d) AS depth FROM r WHERE {where} GROUP BY root_id, t, i"""


_GEO_COMPONENTS = """
WITH c AS (SELECT 'region' AS node_table, CAST(r_regionkey AS VARCHAR) AS node_id, r_regionkey AS comp FROM region
 UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_regionkey FROM nation
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 1000 + p_partkey FROM part),
 z AS (SELECT *, count(*) OVER (PARTITION BY comp) AS component_size FROM c)
"""

#: Name, query, the same in SQL (None: rows only).
OTHERS: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = [
    ("traverse_depth", traverse_depth, _bfs_sql(_UP_EDGES, "('region', '1')", 2)),
    ("traverse_both_ways", traverse_both_ways, _bfs_sql(_GEO_EDGES, "('supplier', '7')", 3)),
    ("traverse_roots", traverse_roots, _bfs_sql(_UP_EDGES, "('nation', '3'), ('nation', '4'), ('nation', '5')", 2)),
    ("traverse_unique", traverse_unique, "WITH RECURSIVE e AS (SELECT dt AS st, di AS si, st AS dt, si AS di FROM " + _UP_EDGES + "), r AS (SELECT rt AS t, ri AS i, 0 AS d FROM (VALUES ('customer', '3'), ('customer', '4'), ('nation', '5')) v(rt, ri) UNION SELECT e.dt, e.di, r.d + 1 FROM r JOIN e ON e.st = r.t AND e.si = r.i WHERE r.d < 3) SELECT DISTINCT t AS node_table, i AS node_id FROM r"),
    ("traverse_pruned", traverse_pruned, _bfs_sql(_UP_EDGES, "('nation', '3')", 3, "true", "e.dt = 'customer' AND e.di IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE round(c_acctbal) >= 5000)")),
    ("traverse_filtered", traverse_filtered, _bfs_sql(_UP_EDGES, "('nation', '3')", 3, "t = 'orders' AND i IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 50000)")),
    ("traverse_typed", traverse_typed, _bfs_sql(_GEO_EDGES, "('region', '2')", 2, "t = 'supplier'", "e.ty IN ('in_region', 'based_in')")),
    ("traverse_paths", traverse_paths, """
     WITH x AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 11)
     SELECT CAST(c_custkey AS VARCHAR) AS node_id, 0 AS depth, 'customer:' || c_custkey AS readable_path FROM x
     UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 1, 'customer:' || c_custkey || ' --up--> nation:' || n_nationkey FROM x
     UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 2, 'customer:' || c_custkey || ' --up--> nation:' || n_nationkey || ' | nation:' || n_nationkey || ' --up--> region:' || n_regionkey FROM x"""),
    ("traverse_depth_first", traverse_depth_first, "SELECT node_table, node_id, depth FROM (" + _bfs_sql(_UP_EDGES, "('nation', '6')", 2) + ")"),
    ("traverse_search", traverse_search, """
     WITH s AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE starts_with(n_name, 'NATION_1'))
     SELECT CAST(k AS VARCHAR) AS root_id, 'nation' AS node_table, CAST(k AS VARCHAR) AS node_id, 0 AS depth FROM s UNION ALL SELECT CAST(k AS VARCHAR), 'region', CAST(r AS VARCHAR), 1 FROM s"""),
    ("neighbors", neighbors, "SELECT dt AS node_table, di AS node_id, 1 AS depth FROM " + _GEO_EDGES + " WHERE st = 'nation' AND si = '9'"),
    ("node", node, "SELECT 'customer' AS node_table, CAST(c_custkey AS VARCHAR) AS node_id FROM customer WHERE c_custkey = 17"),
    *((f"search_{mode}", _search(mode, value, sensitive), f"SELECT 'part' AS node_table, CAST(p_partkey AS VARCHAR) AS node_id, '{mode}' AS match_type FROM part WHERE {where}")
      for mode, value, sensitive, where in (
          ("contains", "L GI", False, "contains(lower(p_name), 'l gi')"), ("exact", "Blue Bolt", False, "lower(p_name) = 'blue bolt'"),
          ("prefix", "red w", True, "starts_with(p_name, 'red w')"), ("token", "gear hot", False, "regexp_matches(lower(p_name), '(^|[^a-z0-9])gear($|[^a-z0-9])') AND regexp_matches(lower(p_name), '(^|[^a-z0-9])hot($|[^a-z0-9])')"))),
    ("hydrated_search", hydrated_search, "SELECT CAST(s_suppkey AS VARCHAR) AS node_id, s_name AS name FROM supplier WHERE contains(lower(s_name), 'supplier')"),
    ("shortest_path", shortest_path, """
     WITH x AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5)
     SELECT 0 AS step, 'customer' AS node_table, CAST(c_custkey AS VARCHAR) AS node_id, CAST(NULL AS VARCHAR) AS edge_label FROM x
     UNION ALL SELECT 1, 'nation', CAST(n_nationkey AS VARCHAR), 'up' FROM x UNION ALL SELECT 2, 'region', CAST(n_regionkey AS VARCHAR), 'up' FROM x"""),
    ("cheapest_path", cheapest_path, """
     WITH RECURSIVE e AS MATERIALIZED (SELECT si, di, min(w) AS w FROM (
       SELECT 'o' || l_orderkey AS si, 'p' || l_partkey AS di, greatest(1, CAST(round(l_quantity) AS BIGINT)) AS w FROM lineitem
       UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, greatest(1, CAST(round(l_quantity) AS BIGINT)) FROM lineitem
       UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, greatest(1, CAST(round(l_quantity) AS BIGINT)) FROM lineitem) GROUP BY si, di),
     ends AS (SELECT min(k) AS a, max(k) AS b FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem ORDER BY k LIMIT 2)),
     best(n, c) USING KEY (n) AS (
       SELECT 'o' || a, CAST(0 AS BIGINT) FROM ends
       UNION SELECT e.di, min(best.c + e.w) FROM best JOIN e ON e.si = best.n LEFT JOIN recurring.best AS old ON old.n = e.di
       WHERE best.c + e.w < coalesce(old.c, 1000000) AND best.c + e.w <= coalesce((SELECT r.c FROM recurring.best r, ends WHERE r.n = 'o' || b), 1000000) GROUP BY e.di)
     SELECT max(c) AS cost FROM best, ends WHERE n = 'o' || b"""),
    ("component_stats", component_stats, _GEO_COMPONENTS + "SELECT CAST(count(DISTINCT comp) AS INTEGER) AS num_components, CAST(max(component_size) AS INTEGER) AS largest_component, CAST(count(*) FILTER (component_size = 1) AS INTEGER) AS num_isolated_nodes, CAST(count(*) AS INTEGER) AS total_active_nodes FROM z"),
    ("component_sizes", component_sizes, _GEO_COMPONENTS + "SELECT component_size, CAST(row_number() OVER (ORDER BY component_size DESC) AS INTEGER) AS rank FROM (SELECT comp, any_value(component_size) AS component_size FROM z GROUP BY comp) ORDER BY component_size DESC LIMIT 10"),
    ("component_members", component_members, _GEO_COMPONENTS + "SELECT node_table, node_id, CAST(component_size AS INTEGER) AS component_size FROM z"),
    ("largest_component", largest_component, _GEO_COMPONENTS + """
     SELECT node_table, node_id FROM z WHERE comp = (
       SELECT comp FROM z GROUP BY comp ORDER BY max(component_size) DESC, min({'t': node_table, 'i': node_id}) LIMIT 1)"""),
    ("isolated_nodes", isolated_nodes, _GEO_COMPONENTS + "SELECT node_table, node_id FROM z WHERE component_size = 1"),
    ("aggregate_nodes", _aggregate("returned_nodes"), "SELECT round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer WHERE c_nationkey = 3"),
    ("aggregate_parent_paths", _aggregate("chosen_parent_path"), "SELECT round(sum(c_acctbal * (1 + k)), 2) AS total, CAST(sum(1 + k) AS BIGINT) AS n FROM (SELECT c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS k FROM customer WHERE c_nationkey = 3)"),
    ("aggregate_all_paths", _aggregate("all_possible_paths"), "SELECT round(sum(c_acctbal * (1 + k)), 2) AS total, CAST(sum(1 + k) AS BIGINT) AS n FROM (SELECT c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS k FROM customer WHERE c_nationkey = 3)"),
    ("path_count", path_count, "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1) AS estimated_paths, true AS exact, false AS capped"),
    ("find", find, "SELECT CAST(c_custkey AS VARCHAR) AS node_id, CAST(row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS INTEGER) AS rank FROM customer WHERE contains(lower(c_name), 'customer')"),
    ("expand", expand, "SELECT 'supplier' AS node_table, CAST(s_suppkey AS VARCHAR) AS node_id, 2 AS depth, 'region:0 --in_region--> nation:' || n_nationkey || ' | nation:' || n_nationkey || ' --based_in--> supplier:' || s_suppkey AS readable_path, false AS truncated FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0"),
    ("find_related", find_related, "SELECT 'supplier' AS node_table, CAST(s_suppkey AS VARCHAR) AS node_id, 1 AS depth, count(*) OVER () AS filtered_count FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_2'"),
    ("readable_path", readable_path, """
     WITH x AS (SELECT c_custkey, n_nationkey, n_regionkey, 'customer:' || c_custkey || ' --up--> nation:' || n_nationkey || ' | nation:' || n_nationkey || ' --up--> region:' || n_regionkey AS p FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5)
     SELECT 0 AS step, CAST(c_custkey AS VARCHAR) AS node_id, p AS readable_path FROM x UNION ALL SELECT 1, CAST(n_nationkey AS VARCHAR), p FROM x UNION ALL SELECT 2, CAST(n_regionkey AS VARCHAR), p FROM x"""),
    ("connection", connection, "SELECT '1' AS source_id, '6' AS target_id, 2 AS hop_count, CAST(s AS INTEGER) AS step FROM range(3) t(s) WHERE (SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_name IN ('NATION_1', 'NATION_6')) = 1"),
    ("neighborhood", neighborhood, "WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_name = 'NATION_4') SELECT 0 AS depth, 'nation' AS node_table, 1 AS node_count, false AS truncated UNION ALL SELECT 1, dt, count(*), false FROM " + _GEO_EDGES + " JOIN n ON st = 'nation' AND si = CAST(k AS VARCHAR) GROUP BY dt"),
    ("registered_edges", registered_edges, "SELECT * FROM (VALUES ('customer', 'c_nationkey', 'nation', 'up', false), ('nation', 'n_regionkey', 'region', 'up', false), ('orders', 'o_custkey', 'customer', 'up', false)) v(from_table, from_column, to_table, label, bidirectional)"),
    ("discovered", discovered, "SELECT * FROM (VALUES ('table', 'customer', 'key c_custkey'), ('edge', 'c_nationkey', 'customer.c_nationkey -> nation.n_nationkey'), ('table', 'nation', 'key n_nationkey'), ('edge', 'n_regionkey', 'nation.n_regionkey -> region.r_regionkey'), ('table', 'region', 'key r_regionkey')) v(item_type, item_name, details)"),
    ("built_counts", built_counts, "SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS INTEGER) AS node_count, CAST((SELECT count(*) FROM " + _GEO_EDGES + ") AS INTEGER) AS edge_count, false AS has_unidirectional_edges"),
    ("json_rows", json_rows, """SELECT '{"r":{"_id":{"table":"region","id":"' || r_regionkey || '"},"_labels":["region"],"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"},"k":"' || r_regionkey || '"}' AS row FROM region"""),
    ("compatible_dialect", compatible_dialect, "SELECT n_name AS nation FROM nation"),
    ("compatibility", compatibility, """SELECT * FROM (VALUES
     ('node MATCH', 'supported', 'node patterns share the planner of gql()'),
     ('single relationship MATCH', 'supported', 'directed, inbound, undirected, optional and bounded patterns share the planner'),
     ('RETURN, WITH, ORDER BY, SKIP, LIMIT', 'supported', 'projection, order, paging, DISTINCT, aggregates and path functions share the planner'),
     ('mapped writes', 'supported', 'CREATE, SET, REMOVE, DELETE, DETACH DELETE and MERGE for registered mappings'),
     ('Cypher procedures and UNWIND', 'rejected', 'CALL, YIELD, UNWIND, FOREACH and procedures have no mapping to tables'),
     ('Cypher DDL', 'rejected', 'indexes, constraints, databases and schemas belong to the tables'' owner'),
     ('Full openCypher compatibility', 'not claimed', 'a narrow compatible dialect, not the whole language')) v(feature, status, notes)"""),
    ("log_replay", log_replay, "WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL VALUES (100, 'NEW', 1), (3, 'MOVED', 0)) SELECT r_regionkey AS region, count(*) AS nations, min(n_name) AS first FROM n JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey"),
    ("overlay_writes", overlay_writes, "SELECT r_regionkey AS region, CASE WHEN r_regionkey = 0 THEN 'ZERO' WHEN r_regionkey <> 1 THEN r_name END AS name FROM region WHERE r_regionkey <> 2 UNION ALL VALUES (10, 'TEN'), (11, 'ELEVEN')"),
    ("snapshot_round_trip", snapshot_round_trip, "SELECT ty AS type, count(*) AS n FROM " + _GEO_EDGES + " GROUP BY ty"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _rounded(_gql(kind, query, params)) for name, kind, query, params, _ in PATTERNS}
    return found | {name: run for name, run, _ in OTHERS}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, _, _, _, sql in PATTERNS}
    return found | {name: sql for name, _, sql in OTHERS if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their value by region, from a three-hop pattern."""
    return queries()["gql_chain"](spark, sf_dir)

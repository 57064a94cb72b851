"""Golden values and rules on small graphs."""

from __future__ import annotations

import random

import pytest

from trellis import GraphError, Session, Settings, filters, format_path, node_ref_string
from trellis.streaming.sync import LOG_SCHEMA, normalised


def friends(spark, users=(("u1", "Alice", 37), ("u2", "Bob", 41)), links=(("f1", "u1", "u2"),), mode="csr_readonly", both=False, build=True):
    s = Session(spark, Settings(default_projection_mode=mode))
    s.source("users", spark.createDataFrame(list(users), "id string, name string, age int"), "id")
    s.source("friendships", spark.createDataFrame(list(links), "id string, user_id string, friend_id string"), "id", [("user_id", "users", "id"), ("friend_id", "users", "id")])
    s.add_table("users", "id", ["name", "age"])
    s.add_edge("friendships", "user_id", "users", "friend_id", "friend", both)
    if build:
        s.build()
    return s


def weighted(spark):
    s = Session(spark)
    s.source("nodes", spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, name string"), "id")
    edges = [("e1", "a", "b", 5, "expensive"), ("e2", "b", "d", 5, None), ("e3", "a", "c", 1, ""), ("e4", "c", "d", 1, "cheap")]
    s.source("edges", spark.createDataFrame(edges, "id string, src string, dst string, cost int, rel_type string"), "id", [("src", "nodes", "id"), ("dst", "nodes", "id")])
    s.add_table("nodes", "id")
    s.add_edge("edges", "src", "nodes", "dst", "route", False, "cost", "rel_type")
    s.build()
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_cheapest_path(spark):
    s = weighted(spark)
    found = s.weighted_shortest_path("nodes", "a", "nodes", "d").collect()
    assert [(r.step, r.node_id, r.edge_label, r.edge_weight, r.step_cost, r.total_cost) for r in found] == [(0, "a", None, None, 0, 0), (1, "c", "route", 1, 1, 1), (2, "d", "cheap", 1, 1, 2)]
    assert rows(s.weighted_shortest_path("nodes", "d", "nodes", "a")) == []
    assert [r.total_cost for r in s.weighted_shortest_path("nodes", "b", "nodes", "b").collect()] == [0]
    assert rows(s.traverse("nodes", "d", direction="out", include_start=False, hydrate=False)) == []
    assert sorted(r.node_id for r in s.traverse("nodes", "d", 1, direction="in", include_start=False, hydrate=False).collect()) == ["b", "c"]


def ways(spark, edges, kind, both):
    """A weighted graph of nodes 0 to 39; with text keys some ends are in a second table."""
    s = Session(spark)
    s.source("a", spark.range(40).selectExpr(f"cast(id as {kind}) as k"), "k")
    s.source("b", spark.range(40, 44).selectExpr(f"cast(id as {kind}) as k"), "k")
    s.source("e", spark.createDataFrame(edges, "x int, y int, w int").selectExpr(f"cast(x as {kind}) as x", f"cast(y as {kind}) as y", "w"), (), [("x", "a", "k")])
    s.add_table("a", "k"), s.add_table("b", "k")
    s.add_edge("e", "x", "a", "y", "way", both, "w")
    s.build()
    return s


@pytest.mark.parametrize(("kind", "both", "n", "small"), [("int", False, 40, None), ("bigint", True, 40, 5), ("string", False, 44, None), ("string", True, 44, 5)])
def test_cheapest_path_against_brute_force(spark, monkeypatch, kind, both, n, small):
    from trellis.operators import paths

    if small:
        monkeypatch.setattr(paths, "SMALL", small)
    rng = random.Random(n + both)
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 30)) for _ in range(70)]
    steps = edges + [(y, x, w) for x, y, w in edges if both]
    s = ways(spark, edges, kind, both)
    assert (s.graph().parts is None) == (n > 40)
    table = lambda k: "a" if k < 40 else "b"
    for x, y in [(0, 1), (2, 39), (5, 5), (7, 31)]:
        cost = {x: 0}
        for _ in range(n):
            for p, q, w in steps:
                if p in cost and cost[p] + w < cost.get(q, 10**9):
                    cost[q] = cost[p] + w
        found = s.weighted_shortest_path(table(x), str(x), table(y), str(y)).collect()
        assert [r.total_cost for r in found[-1:]] == [cost[k] for k in (y,) if k in cost]
        nodes = [int(r.node_id) for r in found]
        assert nodes[:1] + nodes[-1:] == [x, y] * (y in cost)
        assert all((p, q, r.edge_weight) in steps for p, q, r in zip(nodes, nodes[1:], found[1:], strict=False))


def test_cheapest_path_reaches_little_from_both_ends(spark, monkeypatch):
    """A tree of 1,093 nodes below the start, all nearer than the target, is not searched."""
    from trellis.operators import paths

    sides = []
    begin = paths.Side.__init__
    monkeypatch.setattr(paths.Side, "__init__", lambda self, *a: (begin(self, *a), sides.append(self))[0])
    s = Session(spark)
    s.source("n", spark.range(2000).selectExpr("id as k"), "k")
    tree = [((i - 1) // 3, i, 1) for i in range(1, 1093)]
    s.source("e", spark.createDataFrame([*tree, (0, 1500, 20), (1500, 1501, 20)], "x long, y long, w int"), (), [("x", "n", "k"), ("y", "n", "k")])
    s.add_table("n", "k")
    s.add_edge("e", "x", "n", "y", "way", False, "w")
    s.build()
    assert "Join" not in s.graph().edges._jdf.queryExecution().analyzed().toString()
    assert [r.total_cost for r in s.weighted_shortest_path("n", "0", "n", "1501").collect()] == [0, 20, 40]
    assert sum(len(x.known) for x in sides) < 20


def test_aggregates(spark):
    two = [{"function": "sum", "table": "users", "column": "age", "alias": "s"}, {"function": "avg", "table": "users", "column": "age", "alias": "a"}, {"function": "count", "table": "users", "column": "id", "alias": "n"}]
    s = friends(spark)
    assert s.aggregate({"starts": [["users", "u1"]], "max_depth": 1}, two) == {"s": 78.0, "a": 39.0, "n": 2}
    s = friends(spark, [("u1", "Alice", 37), ("u2", "Bob", 41), ("u3", "Cara", 29)], [("f1", "u1", "u2"), ("f2", "u2", "u3")])
    chosen = s.aggregate({"starts": [["users", "u1"]], "min_depth": 2, "max_depth": 2}, two, "chosen_parent_path")
    assert chosen["s"] == 107.0
    s = friends(spark, [("u1", "Alice", 37), ("u2", "Bob", 41), ("u3", "Cara", 29)], [("f1", "u1", "u2"), ("f2", "u1", "u3")])
    star = s.aggregate({"starts": [["users", "u1"]], "max_depth": 1}, two, "all_possible_paths")
    assert (star["s"], star["n"]) == (181.0, 5)
    with pytest.raises(GraphError):
        s.aggregate({"starts": []}, two)


def test_path_counts(spark):
    s = friends(spark)
    t = {"starts": [["users", "u1"]], "max_depth": 1}
    assert rows(s.path_count_estimate(t)) == [(2, True, False)]
    s.settings.max_exact_path_count = 1
    assert rows(s.path_count_estimate(t)) == [(1, False, True)]


def test_caps_and_seeds(spark):
    s = friends(spark)
    assert {r.capped for r in s.traverse("users", "u1", hydrate=False, max_nodes=2).collect()} == {True}
    assert {r.capped for r in s.traverse("users", "u1", hydrate=False).collect()} == {False}
    with pytest.raises(GraphError) as e:
        s.traverse("users", "nobody")
    assert (e.value.code, e.value.sqlstate) == ("PG010", "P0002")
    assert rows(s.get_node("default", "users", "nobody")) == []
    assert rows(s.shortest_path("users", "u2", "users", "u1", hydrate=False)) == []


def test_tenants(spark):
    s = Session(spark)
    s.source("t", spark.createDataFrame([("a1", "A", None), ("a2", "A", "a1"), ("b1", "B", "a1")], "id string, tenant_id string, parent_id string"), "id")
    s.add_table("t", "id", tenant_column="tenant_id")
    s.add_edge("t", "parent_id", "t", "id", "parent")
    s.build()
    assert sorted(r.node_id for r in s.traverse("t", "a1", tenant="A", hydrate=False).collect()) == ["a1", "a2"]
    assert sorted(r.node_id for r in s.traverse("t", "b1", tenant="A", hydrate=False).collect()) == ["a1", "a2", "b1"]


def test_edges_fall_back_to_other_tables_and_drop_orphans(spark):
    s = Session(spark)
    s.source("a", spark.createDataFrame([("1", "x"), ("2", "1"), ("3", None), ("4", "nowhere")], "id string, ref string"), "id")
    s.source("b", spark.createDataFrame([("x",)], "id string"), "id")
    s.add_table("a", "id")
    s.add_table("b", "id")
    s.add_edge("a", "ref", "a", "id", "ref", False)
    s.build()
    assert sorted(rows(s.graph().edges.select("src_id", "dst_label", "dst_id"))) == [("1", "b", "x"), ("2", "a", "1")]


def test_patterns(spark):
    s = friends(spark, [("u1", "Alice", 37), ("u2", "Bob", 41), ("u3", "Cara", 29)], [("f1", "u1", "u2"), ("f2", "u1", "u2"), ("f3", "u3", "u3")])
    q = "MATCH (a:users)-[r:friend]->(b:users) RETURN a.name AS a, b.name AS b"
    assert sorted(rows(s.gql_df(q))) == [("Alice", "Bob"), ("Alice", "Bob"), ("Cara", "Cara")]
    assert sorted(rows(s.gql_df("MATCH (a:users)-[:friend*1..2]->(b:users) RETURN a.name AS a, b.name AS b"))) == [("Alice", "Bob"), ("Alice", "Bob")]
    r = s.gql_df("MATCH (a:users)-[r:friend]->(b:users) WHERE id(a) = 'u1' RETURN r LIMIT 1").head().r
    assert (r._type, r._start.id, r._end.id, r.user_id) == ("friend", "u1", "u2", "u1")
    got = rows(s.gql_df("OPTIONAL MATCH (a:users)-[:friend]->(b:users) WHERE b.name = 'Alice' RETURN a.name AS a, b.name AS b ORDER BY a SKIP 1 LIMIT 1"))
    assert got == [("Bob", None)]
    assert rows(s.gql_df("MATCH (a:users) RETURN collect(a.name) AS names")) == [(["Alice", "Bob", "Cara"],)]
    text = s.gql("MATCH (a:users) WHERE a.age > 40 RETURN a").head().row
    assert text == '{"a":{"_id":{"table":"users","id":"u2"},"_labels":["users"],"id":"u2","name":"Bob","age":41}}'


def test_long_bounds_do_not_grow_the_plan(spark):
    n = 7
    s = friends(spark, [(f"n{i}", "x", i) for i in range(n)], [(f"e{i}", f"n{i}", f"n{i + 1}") for i in range(n - 1)])
    for low, high in ((1, 2), (2, 5), (5, 64), (9, 64)):
        got = rows(s.gql_df(f"MATCH (a:users)-[:friend*{low}..{high}]->(b:users) RETURN id(a) AS a, id(b) AS b"))
        assert sorted(got) == [(f"n{i}", f"n{j}") for i in range(n) for j in range(i + 1, n) if low <= j - i <= high]
        path = rows(s.gql_df(f"MATCH p=(a:users)-[:friend*{low}..{high}]->(b:users) WHERE b.age > 3 RETURN id(a) AS a, id(b) AS b, length(p) AS n"))
        assert sorted(path) == [(f"n{i}", f"n{j}", j - i) for i in range(n) for j in range(max(4, i + 1), n) if low <= j - i <= high]


def test_names_of_edges_change(spark):
    s = friends(spark, build=False)
    s.rename_edge("default", "friend", "knows")
    s.alter_edge("default", "knows", bidirectional=True)
    assert [(r.label, r.bidirectional) for r in s.registered_edges().collect()] == [("knows", True)]


def test_two_valued_logic(spark):
    s = Session(spark)
    s.source("t", spark.createDataFrame([("1", None, '{"a":null,"b":2}'), ("2", 5, '{"a":1}'), ("3", 7, "bad")], "id string, x int, j string"), "id")
    s.add_table("t", "id")

    def ids(where, params=None):
        return sorted(r.k for r in s.gql_df(f"MATCH (t:t) WHERE {where} RETURN t.id AS k", params).collect())

    assert ids("t.x = null") == ["1"]
    assert ids("t.x <> 5") == ["1", "3"]
    assert ids("NOT t.x > 5") == ["1", "2"]
    assert ids("t.x IN [5, null]") == ["1", "2"]
    assert ids("t.j.a IS NULL") == ["1"]
    assert ids("t.j.a IS NOT NULL") == ["2"]
    assert ids("t.j.b = 2") == ["1"]
    assert ids("t.x = $v", {"v": 7}) == ["3"]
    assert ids("t.x = 'text'") == []
    with pytest.raises(GraphError) as e:
        ids("t.x = $v")
    assert e.value.code == "PG016"
    s.settings.strict_comparisons = True
    with pytest.raises(Exception, match="PG017"):
        ids("t.x > 5")


#: Statements outside the language, their SQLSTATE and a part of the message.
REJECTED = [
    ("MATCH (a)-[:knows*]-(b) RETURN a", "0A000", "explicit upper bound"),
    ("MATCH (a) RETURN a UNION MATCH (b) RETURN b", "42601", "expected end of query"),
    ("CALL foo() RETURN 1", "42601", "expected MATCH clause"),
    ("MATCH (a)-[:x]->(b)-[:y]->(c) RETURN c", "0A000", "exactly one relationship"),
    ("MATCH (a), (b) RETURN a", "0A000", "fixed single-relationship patterns"),
    ("OPTIONAL MATCH (a)-[:x]->(b)-[:y]->(c) RETURN c", "0A000", "exactly one relationship"),
    ("MATCH (a) RETURN CASE WHEN true THEN 1 ELSE 0 END", "42601", "expected end of query"),
    ("MATCH (a) RETURN a SKIP -1", "42601", "SKIP requires an integer"),
    ("MATCH (a) DELETE a RETURN a", "0A000", "exactly one relationship"),
    ("GRAPH_TABLE (g MATCH (a) COLUMNS (a.id))", "42601", "expected MATCH clause"),
]


@pytest.mark.parametrize(("query", "sqlstate", "message"), REJECTED)
def test_rejected(spark, query, sqlstate, message):
    s = friends(spark, build=False)
    with pytest.raises(GraphError) as e:
        s.gql(query)
    assert e.value.sqlstate == sqlstate and message in str(e.value)


@pytest.mark.parametrize("query", ["MATCH (a:nobody) RETURN a", "MATCH (a:users)-[:x]->(b:users) RETURN a", "MATCH (a:users) RETURN a.nothing", "MATCH (a:users) RETURN b"])
def test_unknown_names(spark, query):
    with pytest.raises(GraphError) as e:
        friends(spark, build=False).gql(query)
    assert e.value.code == "PG015"


def test_cypher_front_end(spark):
    s = friends(spark, build=False)
    for query in ("UNWIND [1] AS x RETURN x", "CREATE INDEX i", "MATCH (a:users) RETURN a UNION MATCH (a:users) RETURN a"):
        with pytest.raises(GraphError) as e:
            s.cypher(query)
        assert e.value.code == "PG014"
    with pytest.raises(GraphError):
        s.pgq("")
    assert s.gql_explain("MATCH (a:users)-[:friend]->(b:users) RETURN a, b.name") == "Expand(source=a:users, rel=friend, hydration=edge_row, hops=1..1, target=b:users, return=[a, b.name])"
    assert s.gql_explain("MATCH (a:users) WHERE id(a) = 'u1' RETURN a") == "NodeLookup(node=a:users, lookup=identity, return=[a])"
    assert s.gql_explain("MATCH (a:users) RETURN a.name AS n") == "NodeScan(node=a:users, return=[n])"


def test_writes(spark):
    s = friends(spark, mode="mutable_overlay")
    s.savepoint("before")
    s.gql("CREATE (u:users {id: 'u3', name: 'Cara', age: 29}) RETURN u")
    s.gql("MATCH (a:users), (b:users) WHERE id(a) = 'u2' AND id(b) = 'u3' CREATE (a)-[r:friend {id: 'f2'}]->(b) RETURN a.name AS a, b.name AS b, r")
    assert rows(s.gql_df("MATCH (a:users)-[:friend]->(b:users) WHERE b.name = 'Cara' RETURN a.name AS a")) == [("Bob",)]
    out = s.gql_df("MATCH (a:users)-[r:friend]->(b:users) WHERE id(a) = 'u1' DELETE r RETURN a.name AS a").collect()
    assert [tuple(r) for r in out] == [("Alice",)]
    assert rows(s.gql_df("MATCH (a:users)-[:friend]->(b:users) RETURN count(*) AS n")) == [(1,)]
    s.gql("MERGE (u:users {id: 'u2'}) ON MATCH SET u.age = 42 RETURN u")
    assert rows(s.gql_df("MATCH (u:users) WHERE id(u) = 'u2' RETURN u.age AS age")) == [(42,)]
    with pytest.raises(GraphError):
        s.gql("CREATE (u:users {id: 'u3'}) RETURN u")
    with pytest.raises(GraphError):
        s.gql("MATCH (u:users) WHERE u.age > 0 SET u.name = 'x' RETURN u")
    s.rollback_to("before")
    assert rows(s.gql_df("MATCH (u:users) RETURN count(*) AS n")) == [(2,)]
    s.gql("MATCH (u:users) WHERE id(u) = 'u2' DETACH DELETE u RETURN u")
    assert [r.node_id for r in s.traverse("users", "u1", hydrate=False).collect()] == ["u1"]
    with pytest.raises(GraphError) as e:
        friends(spark).gql("CREATE (u:users {id: 'u9'}) RETURN u")
    assert e.value.code == "PG012"


def test_filters(spark):
    assert filters.equals("age", 3) == {"where": {"age": {"eq": 3}}}
    assert filters.on_node(filters.between("age", 1, 2)) == {"node": {"where": {"age": {"between": [1, 2]}}}}
    assert filters.all_([filters.gt("age", 1), filters.lt("age", 9), filters.eq("name", "x")]) == {"where": {"age": {"lt": 9}, "name": {"eq": "x"}}}
    assert filters.parse(filters.neq("a", None)) == [("a", "is_not_null", None)]
    with pytest.raises(GraphError):
        filters.parse({"where": {"a": {"like": 1}}})
    s = friends(spark, [("u1", "Alice", 37), ("u2", None, 41), ("u3", "Cara", 29)], [("f1", "u1", "u2"), ("f2", "u1", "u3")], build=False)
    s.add_filter_column("users", "age", "numeric")
    s.build()

    def ids(f):
        return sorted(r.node_id for r in s.traverse("users", "u1", filter=f, hydrate=False).collect())

    assert ids(filters.at_least("age", 40)) == ["u1", "u2"]  # the seed is exempt
    assert ids(filters.neq("name", "Cara")) == ["u1", "u2"]  # applied to rows; null differs
    assert ids(filters.in_("age", [29])) == ["u1", "u3"]
    with pytest.raises(GraphError):
        ids(filters.contains_text("age", "4"))


def test_text_forms():
    assert format_path([{"table": "users", "id": "u1"}, {"table": "users", "id": "u2"}], ["friend"]) == "users:u1 --friend--> users:u2"
    assert node_ref_string("users", "u1") == '["users", "u1"]'


def test_composite_keys(spark):
    s = Session(spark)
    s.source("c", spark.createDataFrame([("org1", "emp1"), ("org1", 'e"2')], "org_id string, user_id string"), ("org_id", "user_id"))
    s.add_table("c", ["org_id", "user_id"])
    assert sorted(r.k for r in s.gql_df("MATCH (c:c) RETURN id(c) AS k").collect()) == ['["org1", "e\\"2"]', '["org1", "emp1"]']


def test_discovery_and_names(spark):
    s = friends(spark, build=False)
    s.source("links", spark.createDataFrame([("u1", "u2")], "left_id string, right_id string"), ("left_id", "right_id"), [("left_id", "users", "id"), ("right_id", "users", "id")])
    found = rows(s.preview_discover())
    assert ("junction", "links", "users.left_id -> users.id") in found
    assert ("edge", "user", "friendships.user_id -> users.id") in found
    s.create_graph("g2", tenant="t")
    s.set_current_graph("g2", "t")
    with pytest.raises(GraphError) as e:
        s.traverse("users", "u1")
    assert e.value.code in ("PG015", "PG003")
    assert s.list_graphs().count() == 2
    s.grant_graph("g2", "someone", "read", "t")
    assert s.graph_privileges("g2", "t").count() == 1
    s.set_graph_quota("global", "graphs", 2)
    with pytest.raises(GraphError):
        s.create_graph("g3")
    assert rows(s.graph_quota_usage().select("usage_value", "exceeded")) == [(2, False)]
    s.drop_graph("g2", "t")
    assert s.current.name == "default"


def test_sync_and_snapshots(spark):
    s = friends(spark)
    log = [(1, "users", "I", None, "u3", None, '{"id":"u3","name":"Cara","age":29}'), (2, "friendships", "I", None, "f2", None, '{"id":"f2","user_id":"u2","friend_id":"u3"}'), (3, "users", "U", "u1", "u1", None, '{"id":"u1","name":"Alicia","age":38}')]
    s.save_graph()
    s.enable_sync(spark.createDataFrame(log, LOG_SCHEMA))
    assert s.sync_health().head().pending_sync_rows == 3
    assert rows(s.ingest_projection()) == [(3, 1, 3)]
    g = s.store(s.current).read()
    assert sorted(r.id for r in g.nodes.collect()) == ["u1", "u2", "u3"] and g.edges.count() == 2
    assert rows(s.projection_compact().select("segments_compacted", "segment_count")) == [(1, 0)]
    assert s.store(s.current).read().edges.count() == 2
    assert s.projection_gc().head().deleted_files > 0
    assert sorted(r.node_id for r in s.traverse("users", "u1", hydrate=False).collect()) == ["u1", "u2", "u3"]  # applies what is pending
    assert s.current.applied == 3
    with pytest.raises(GraphError) as e:
        s.apply_changes(spark.createDataFrame([(4, "users", "D", "nobody", None, None, None)], LOG_SCHEMA))
    assert e.value.code == "PG010"
    cut = normalised(spark.createDataFrame([(1, "t", "I", "k"), (2, "t", "D", "k"), (3, "t", "I", "m"), (4, "t", "D", "m"), (5, "t", "I", "m")], "id long, table string, op string, key string"))
    assert rows(cut.select("key", "op")) == [("m", "D")]


def test_stream(spark, tmp_path):
    s = friends(spark)
    spark.createDataFrame([(1, "users", "T", None, None, None, None), (2, "users", "I", None, "u7", None, '{"id":"u7","name":"Gil","age":1}')], LOG_SCHEMA).write.parquet(str(tmp_path / "log"))
    s.follow_log(str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert [r.k for r in s.gql_df("MATCH (u:users) RETURN id(u) AS k").collect()] == ["u7"]


def test_jobs(spark):
    s = friends(spark)
    s.enable_sync(spark.createDataFrame([(1, "users", "I", None, "u3", None, '{"id":"u3","name":"C","age":1}')], LOG_SCHEMA))
    job = s.add_sync_policy("default").head()
    assert [r.rows_applied for r in s.run_due_jobs().collect()] == [1]
    assert s.job_stats().head().completed_runs == 1
    assert s.run_due_jobs().count() == 0
    s.alter_job(job.job_id, enabled=False)
    assert s.drop_sync_policy(job.policy_id).head().dropped
    build = s.build(concurrently=True).head()
    s.wait(60)
    assert s.build_status(build.build_id).head().status == "completed"
    assert s.maintenance().head().status == "completed"


def test_components_of_a_long_chain(spark):
    n = 60
    s = friends(spark, [(f"n{i:03d}", "x", i) for i in range(n)], [(f"e{i}", f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 2)])
    assert rows(s.component_stats()) == [(2, n - 1, 1, n)]
    assert rows(s.components()) == [(0, n - 1, 1), (n - 1, 1, 2)]


def test_filters_and_columns_reach_the_scan(spark, capsys):
    from trellis import queries as q

    q.queries()["gql_one_hop"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(o_orderstatus,F)" in plan and "struct<c_custkey:bigint,c_name:string>" in plan
    assert "Python" not in plan and "Cartesian" not in plan


def test_limits_of_none_are_none(spark):
    n = 1100
    users = [(f"u{i}", f"User {i}", i) for i in range(n)] + [(f"x{i}", "Alone", i) for i in range(n)]
    s = friends(spark, users, [(f"f{i}", "u0", f"u{i}") for i in range(1, n)])
    for x in ("max_nodes", "max_frontier", "max_exact_path_count"):
        s.settings.set(x, 5)
    t = {"starts": [["users", "u0"]], "min_depth": 1, "max_depth": 1, "direction": "out"}
    assert s.traverse("users", "u0", 1, max_rows=None).count() == 5
    assert rows(s.path_count_estimate(t)) == [(5, False, True)]
    for x in ("max_nodes", "max_frontier", "max_exact_path_count"):
        s.settings.set(x, None)
    assert s.traverse("users", "u0", 1, hydrate=False, max_rows=None).count() == n
    assert s.traverse("users", "u0", 1, strategy="dfs", hydrate=False, max_rows=None).count() == n
    assert rows(s.path_count_estimate(t)) == [(n - 1, True, False)]
    assert s.search_nodes("name", "user", "users", max_rows=None).count() == n
    assert s.largest_component(None, hydrate=False).count() == n == s.isolated_nodes(None, hydrate=False).count()


def test_registered_queries_are_not_cut(spark):
    from trellis import queries

    found = queries.queries()
    sf = "/root/testdata/sf0.01"
    largest = queries._session(spark, sf, "geo").components(1).head().component_size
    assert found["largest_component"](spark, sf).count() == largest > 50

"""Binds a parsed read to the catalog and composes its DataFrame plan.

Patterns become equi-joins on the source tables themselves, on native key
types where both sides agree: a foreign-key edge whose start is in scope costs
one join, an edge table two.  Predicates and projections are left to Catalyst,
which pushes them to the scans; nothing runs until the result is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.catalog import Catalog, EdgeMapping, Source, key_text
from trellis.errors import GraphError
from trellis.operators.build import Graph, edge_type
from trellis.plans.syntax import And, Compare, IdOf, IsNull, Item, ListOf, Literal, NodePattern, Not, Or, Param, Pattern, Prop, Read, RelPattern
from trellis.sources.storage import written

MAX_WINDOW = 10_000
#: Hops of a bounded path that are one plan together.
UNROLLED = 3


@dataclass(frozen=True)
class Binding:
    kind: str  # node, rel, rels, path, value
    prefix: str
    label: str | None = None
    nullable: bool = False


Scope = dict[str, Binding]


class Planner:
    def __init__(self, catalog: Catalog, sources: dict[str, Source], graph: Graph | None, params: dict | None = None, tenant: str | None = None, strict: bool = False, hydrate: bool = True) -> None:
        self.catalog, self.sources, self.graph = catalog, sources, graph
        self.params, self.tenant, self.strict, self.hydrate = params or {}, tenant, strict, hydrate
        self.anonymous = 0

    # -- statements

    def read(self, q: Read) -> DataFrame:
        """Flat typed columns, named as RETURN names them."""
        self.check(q)
        if any(p.path for p in q.patterns):
            df, scope = self.wildcard(q)
        elif len(q.patterns) > 1:
            df, scope = self.joined(q)
        elif not q.patterns[0].rels:
            df, scope = self.nodes_only(q)
        else:
            df, scope = self.single(q)
        for w in q.withs:
            df, scope = self.project_with(df, scope, w, len(q.patterns) > 1)
        return self.returned(df, scope, q)

    def check(self, q: Read) -> None:
        wild = any(p.path for p in q.patterns)
        if wild:
            if len(q.patterns) > 1:
                raise GraphError("unsupported", "a path pattern stands alone")
            if q.optional or q.withs or q.returns.order or any(i.kind == "agg" for i in q.returns.items):
                raise GraphError("unsupported", "path patterns take no OPTIONAL, WITH, aggregates or ORDER BY")
            return
        if len(q.patterns) > 1 and any(not p.rels for p in q.patterns):
            raise GraphError("unsupported", "several patterns must be fixed single-relationship patterns")
        for p in q.patterns:
            for r in p.rels:
                if len(r.types) != 1:
                    raise GraphError("unsupported", "a relationship pattern needs exactly one type")
                if r.props:
                    raise GraphError("unsupported", "relationship property maps are not supported")
        names = [i.label for i in q.returns.items]
        if len(set(names)) != len(names):
            raise GraphError("semantic", "RETURN names a column twice")
        if (q.returns.skip or 0) + (q.returns.limit or 0) > MAX_WINDOW:
            raise GraphError("semantic", f"SKIP and LIMIT together go to {MAX_WINDOW}")

    # -- matching

    def fresh(self, kind: str) -> str:
        self.anonymous += 1
        return f"_{kind}{self.anonymous}"

    def scan(self, var: str, label: str) -> DataFrame:
        """A label's source rows, each column under the variable's name, with the key as text."""
        table = self.catalog.table(label)
        df = self.sources[label].df
        if self.tenant is not None and table.tenant_column:
            df = df.where(F.col(table.tenant_column).cast("string") == self.tenant)
        for c in table.id_columns:
            df = df.where(F.col(c).isNotNull())
        return df.select(*(F.col(c).alias(f"{var}__{c}") for c in df.columns), key_text(table.id_columns).alias(f"{var}__id_"))

    def key(self, var: str, label: str) -> tuple[str, T.DataType]:
        table = self.catalog.table(label)
        if len(table.id_columns) == 1:
            c = table.id_columns[0]
            return f"{var}__{c}", self.sources[label].df.schema[c].dataType
        return f"{var}__id_", T.StringType()

    @staticmethod
    def same(a: str, at: T.DataType, b: str, bt: T.DataType) -> Column:
        """Equality of key columns: native where types agree or widen, else as text."""
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if at == bt or (isinstance(at, whole) and isinstance(bt, whole)):
            return F.col(a) == F.col(b)
        return F.col(a).cast("string") == F.col(b).cast("string")

    def label_of(self, n: NodePattern, scope: Scope) -> str:
        if n.var in scope:
            bound = scope[n.var]
            if bound.kind != "node" or (n.label and n.label != bound.label):
                raise GraphError("semantic", f"{n.var} is bound to something else")
            return bound.label
        if not n.label:
            raise GraphError("semantic", "a new node needs a label")
        self.catalog.table(n.label)
        return n.label

    def alternatives(self, source: str, rel: RelPattern, target: str) -> list[tuple[EdgeMapping, bool]]:
        """Mappings that connect the labels, and whether the pattern's left end
        is the mapping's target; generated reverse rows count as edges."""
        kind = rel.types[0]
        typed = [e for e in self.catalog.ordered_edges() if e.label == kind or e.label_column]
        if not typed:
            raise GraphError("semantic", f"unknown relationship type {kind}")
        out = []
        for e in typed:
            start = self.catalog.source_label(e, self.sources)
            for back in (False, True):
                a, b = (target, source) if back else (source, target)
                if e.to_table != b or start not in (a, None):
                    continue
                registered = rel.direction == "both" or (rel.direction == "in") == back
                if registered or e.bidirectional:
                    out.append((e, back))
        if not out:
            raise GraphError("semantic", f"{kind} does not connect {source} and {target}")
        return out

    def expand(self, df: DataFrame | None, scope: Scope, left: NodePattern, rel: RelPattern, right: NodePattern) -> tuple[DataFrame, Scope]:
        """Joins a relationship and what it brings in; ``df`` None starts from scans."""
        a_label, b_label = self.label_of(left, scope), self.label_of(right, scope)
        a, b = left.var or self.fresh("n"), right.var or self.fresh("n")
        r = rel.var or self.fresh("r")
        if r in scope:
            raise GraphError("semantic", f"{r} is bound to something else")
        found = self.alternatives(a_label, rel, b_label)
        parts = [self.expand_one(df, scope, a, a_label, b, b_label, r, e, back, rel.types[0], len(found) > 1 and back) for e, back in found]
        if len(parts) > 1:
            # Columns that only some mappings bring are not kept.
            common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
            parts = [p.select(*common) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        scope = scope | {a: Binding("node", a, a_label), b: Binding("node", b, b_label), r: Binding("rel", r, found[0][0].from_table if len(found) == 1 else None)}
        for n, v in ((left, a), (right, b)):
            if n.props:
                out = out.where(self.property_map(n, v, scope, out))
        return out, scope

    def expand_one(self, df: DataFrame | None, scope: Scope, a: str, a_label: str, b: str, b_label: str, r: str, e: EdgeMapping, back: bool, kind: str, drop_loops: bool) -> DataFrame:
        f, f_label, t, t_label = (b, b_label, a, a_label) if back else (a, a_label, b, b_label)
        bound = set(scope) if df is not None else set()
        if a == b and a not in bound:
            df, bound = self.scan(a, a_label) if df is None else df.crossJoin(self.scan(a, a_label)), bound | {a}
        t_key, t_type = self.key(t, t_label)
        types = self.sources[e.from_table].df.schema
        if e.from_table in self.catalog.tables:
            on = self.same(f"{f}__{e.from_column}", types[e.from_column].dataType, t_key, t_type)
            if df is None:
                df, bound = self.scan(f, f_label), {f}
            elif f not in bound and t not in bound:
                df, bound = df.crossJoin(self.scan(f, f_label)), bound | {f}
            if f in bound and t in bound:
                df = df.where(on)
            else:
                new, label = (t, t_label) if f in bound else (f, f_label)
                df = df.join(self.scan(new, label), on)
            key, of = F.col(f"{f}__id_"), f
        else:
            f_key, f_type = self.key(f, f_label)
            edge = self.sources[e.from_table]
            key_cols = edge.primary_key or tuple(edge.df.columns)
            own = key_text(key_cols) if edge.primary_key else F.xxhash64(*key_cols).cast("string")
            rows = edge.df.where(F.col(e.from_column).isNotNull() & F.col(e.to_column).isNotNull()).select(*(F.col(c).alias(f"{r}__{c}") for c in edge.df.columns), own.alias(f"{r}__key_"))
            on_f = self.same(f"{r}__{e.from_column}", types[e.from_column].dataType, f_key, f_type)
            on_t = self.same(f"{r}__{e.to_column}", types[e.to_column].dataType, t_key, t_type)
            if df is None:
                df, bound = self.scan(a, a_label), {a}
            elif a not in bound and b not in bound:
                df, bound = df.crossJoin(self.scan(a, a_label)), bound | {a}
            if f in bound and t in bound:
                df = df.join(rows, on_f & on_t)
            elif f in bound:
                df = df.join(rows, on_f).join(self.scan(t, t_label), on_t)
            else:
                df = df.join(rows, on_t).join(self.scan(f, f_label), on_f)
            key, of = F.col(f"{r}__key_"), r
        if e.label_column:
            own_type = edge_type(replace(e, label_column=f"{of}__{e.label_column}"))
            df = df.where(own_type == kind)
        if drop_loops and f_label == t_label:
            df = df.where(F.col(f"{f}__id_") != F.col(f"{t}__id_"))
        return df.withColumns({
            f"{r}__key_": key, f"{r}__type_": F.lit(kind), f"{r}__mapping_": F.lit(self.catalog.ordered_edges().index(e)),
            f"{r}__start_": F.struct(F.lit(f_label).alias("table"), F.col(f"{f}__id_").alias("id")),
            f"{r}__end_": F.struct(F.lit(t_label).alias("table"), F.col(f"{t}__id_").alias("id")),
        })

    def nodes_only(self, q: Read) -> tuple[DataFrame, Scope]:
        n = q.patterns[0].nodes[0]
        label, var = self.label_of(n, {}), n.var or self.fresh("n")
        df, scope = self.scan(var, label), {var: Binding("node", var, label, q.optional)}
        if n.props:
            df = df.where(self.property_map(n, var, scope, df))
        if q.where is not None:
            df = df.where(self.predicate(q.where, scope, df))
        if q.optional:  # one row of nulls where nothing is left
            one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
            df = one.join(df.withColumn("_hit", F.lit(1)), F.col("_one") == F.col("_hit"), "left").drop("_one", "_hit")
        return df, scope

    def single(self, q: Read) -> tuple[DataFrame, Scope]:
        p = q.patterns[0]
        left, right, rel = p.nodes[0], p.nodes[1], p.rels[0]
        left = replace(left, var=left.var or self.fresh("n"))
        right = replace(right, var=right.var or self.fresh("n"))
        match = self.variable(None, {}, left, rel, right, True) if rel.hops else self.expand(None, {}, left, rel, right)
        df, scope = match
        if q.where is not None:
            df = df.where(self.predicate(q.where, scope, df))
        if not q.optional:
            return df, scope
        # The predicate decides which matches count; a start without one is kept with nulls.
        a, label = left.var, self.label_of(left, {})
        base = self.scan(a, label)
        if left.props:
            base = base.where(self.property_map(left, a, scope, base))
        mine = set(base.columns)
        other = df.select(F.col(f"{a}__id_").alias("_match"), *(c for c in df.columns if c not in mine))
        scope = {k: b if k == a else replace(b, nullable=True) for k, b in scope.items()}
        return base.join(other, F.col(f"{a}__id_") == F.col("_match"), "left").drop("_match"), scope

    def joined(self, q: Read) -> tuple[DataFrame, Scope]:
        df, scope = None, {}
        for k, p in enumerate(q.patterns):
            left, right, rel = p.nodes[0], p.nodes[1], p.rels[0]
            left, right = replace(left, var=left.var or self.fresh("n")), replace(right, var=right.var or self.fresh("n"))
            before = df
            new_df, new_scope = self.variable(df, scope, left, rel, right, False) if rel.hops else self.expand(df, scope, left, rel, right)
            if q.optional and k == 0:
                a, label = left.var, self.label_of(left, {})
                base = self.scan(a, label)
                if left.props:
                    base = base.where(self.property_map(left, a, new_scope, base))
                mine = set(base.columns)
                other = new_df.select(F.col(f"{a}__id_").alias("_match"), *(c for c in new_df.columns if c not in mine))
                df = base.join(other, F.col(f"{a}__id_") == F.col("_match"), "left").drop("_match")
                scope = {v: b if v == a else replace(b, nullable=True) for v, b in new_scope.items()}
            elif q.optional:
                # An unmatched row stays, and keeps nulls in all later patterns.
                tagged = before.withColumn("_row", F.monotonically_increasing_id()).persist()
                more, new_scope = self.variable(tagged, scope, left, rel, right, False) if rel.hops else self.expand(tagged, scope, left, rel, right)
                extra = more.select(F.col("_row").alias("_match"), *(c for c in more.columns if c not in tagged.columns))
                df = tagged.join(extra, F.col("_row") == F.col("_match"), "left").drop("_match", "_row")
                scope = {v: b if v in scope else replace(b, nullable=True) for v, b in new_scope.items()}
            else:
                df, scope = new_df, new_scope
        if q.where is not None:
            df = df.where(self.predicate(q.where, scope, df))
        return df, scope

    def need_graph(self) -> Graph:
        if self.graph is None:
            raise GraphError("not_built", "the graph is not built")
        return self.graph

    def steps(self, types: tuple[str, ...], direction: str) -> DataFrame:
        """Stored edges as steps (from and to labels and ids, and the relationship's identity)."""
        e = self.need_graph().edges
        if types:
            e = e.where(F.col("type").isin(list(types)))
        start = F.struct(F.when(F.col("reversed"), F.col("dst_label")).otherwise(F.col("src_label")).alias("table"), F.when(F.col("reversed"), F.col("dst_id")).otherwise(F.col("src_id")).alias("id"))
        end = F.struct(F.when(F.col("reversed"), F.col("src_label")).otherwise(F.col("dst_label")).alias("table"), F.when(F.col("reversed"), F.col("src_id")).otherwise(F.col("dst_id")).alias("id"))
        rel = F.struct(F.col("type").alias("_type"), start.alias("_start"), end.alias("_end"), F.col("mapping_id").alias("_mapping"), F.col("source_key").alias("_key")).alias("step_rel")
        out = e.select("src_label", "src_id", "dst_label", "dst_id", rel)
        back = e.select(F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), rel)
        if direction == "out":
            return out
        return back if direction == "in" else out.unionByName(back).distinct()

    @staticmethod
    def level(walks: DataFrame, hop: int, high: int) -> tuple[DataFrame, bool]:
        """Walks of one more hop, and whether longer ones are possible.  Past
        ``UNROLLED`` hops each level is a table of its own, so that the plan
        does not grow with the bound, and an empty level ends the search."""
        if hop < UNROLLED or hop == high:
            return walks, True
        walks = written(walks, "walks")
        return walks, not walks.isEmpty()

    def variable(self, df: DataFrame | None, scope: Scope, left: NodePattern, rel: RelPattern, right: NodePattern, simple: bool) -> tuple[DataFrame, Scope]:
        """Paths of bounded length: without repeated nodes where a pattern
        stands alone, walks where it is joined with others."""
        a_label, b_label = self.label_of(left, scope), self.label_of(right, scope)
        a, b, r = left.var or self.fresh("n"), right.var or self.fresh("n"), rel.var or self.fresh("r")
        if not any(e.label == rel.types[0] or e.label_column for e in self.catalog.edges):
            raise GraphError("semantic", f"unknown relationship type {rel.types[0]}")
        if df is None:
            df = self.scan(a, a_label)
            scope = {a: Binding("node", a, a_label)}
            if left.props:
                df = df.where(self.property_map(left, a, scope, df))
        elif left.var not in scope:
            df = df.crossJoin(self.scan(a, a_label))
            scope = scope | {a: Binding("node", a, a_label)}
        steps = self.steps(rel.types, rel.direction)
        start = df.select(F.col(f"{a}__id_").alias("_from")).distinct()
        here = F.struct(F.lit(a_label).alias("table"), F.col("_from").alias("id"))
        walks = start.select("_from", F.array(here).alias("_nodes"), F.array().cast(T.ArrayType(steps.schema["step_rel"].dataType)).alias("_rels"))
        low, high = rel.hops
        last, out = F.element_at("_nodes", -1), None
        for hop in range(1, high + 1):
            to = F.struct(F.col("dst_label").alias("table"), F.col("dst_id").alias("id"))
            grown = walks.join(steps, (last["table"] == F.col("src_label")) & (last["id"] == F.col("src_id")))
            if simple:
                grown = grown.where(~F.array_contains("_nodes", to))
            walks = grown.select("_from", F.concat("_nodes", F.array(to)).alias("_nodes"), F.concat("_rels", F.array("step_rel")).alias("_rels"))
            walks, more = self.level(walks, hop, high)
            if hop >= low:
                ends = walks.where(last["table"] == b_label)
                out = ends if out is None else out.unionByName(ends)
            if not more:
                break
        out = walks.where("false") if out is None else out
        out = out.select("_from", last["id"].alias("_to"), F.col("_nodes").alias(f"{r}__nodes_"), F.col("_rels").alias(f"{r}__rels_"))
        df = df.join(out, F.col(f"{a}__id_") == F.col("_from")).drop("_from")
        if b in scope:
            df = df.where(F.col(f"{b}__id_") == F.col("_to")).drop("_to")
        else:
            df = df.join(self.scan(b, b_label), F.col("_to") == F.col(f"{b}__id_")).drop("_to")
        scope = scope | {b: Binding("node", b, b_label), r: Binding("rels", r)}
        if right.props:
            df = df.where(self.property_map(right, b, scope, df))
        return df, scope

    def wildcard(self, q: Read) -> tuple[DataFrame, Scope]:
        """A path of any labels and types; each sequence of relationships once."""
        p = q.patterns[0]
        nodes = self.need_graph().nodes
        first = p.nodes[0]
        for n in p.nodes:
            if n.props:
                raise GraphError("unsupported", "path patterns take no property maps")
            if n.label:
                self.catalog.table(n.label)
        known = {e.label for e in self.catalog.edges}
        dynamic = any(e.label_column for e in self.catalog.edges)
        for r in p.rels:
            if not dynamic and set(r.types) - known:
                raise GraphError("semantic", f"unknown relationship type {sorted(set(r.types) - known)[0]}")
        if self.tenant is not None:
            tenanted = [t.name for t in self.catalog.tables.values() if t.tenant_column]
            nodes = nodes.where(~F.col("label").isin(tenanted) | (F.col("tenant") == self.tenant))
        begin = nodes if first.label is None else nodes.where(F.col("label") == first.label)
        rel_type = self.steps((), "out").schema["step_rel"].dataType
        df = begin.select(F.array(F.struct(F.col("label").alias("table"), "id")).alias("_nodes"), F.array().cast(T.ArrayType(rel_type)).alias("_rels"), F.array(F.lit(0)).alias("_marks"))
        last = F.element_at("_nodes", -1)
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            steps, (low, high) = self.steps(r.types, r.direction), r.hops or (1, 1)
            out, now = None, df
            for hop in range(1, high + 1):
                to = F.struct(F.col("dst_label").alias("table"), F.col("dst_id").alias("id"))
                now = now.join(steps, (last["table"] == F.col("src_label")) & (last["id"] == F.col("src_id"))).select(F.concat("_nodes", F.array(to)).alias("_nodes"), F.concat("_rels", F.array("step_rel")).alias("_rels"), "_marks")
                now, more = self.level(now, hop, high)
                if hop >= low:
                    ends = now if n.label is None else now.where(last["table"] == n.label)
                    out = ends if out is None else out.unionByName(ends)
                if not more:
                    break
            out = now.where("false") if out is None else out
            df = out.withColumn("_marks", F.concat("_marks", F.array(F.size("_nodes") - 1)))
        if self.tenant is not None:
            # every node of a path must be visible
            ok = nodes.select(F.struct(F.col("label").alias("table"), "id").alias("_ok"))
            df = df.withColumn("_w", F.monotonically_increasing_id())
            bad = df.select("_w", F.explode("_nodes").alias("_ok")).join(ok, "_ok", "left_anti").select("_w").distinct()
            df = df.join(bad, "_w", "left_anti").drop("_w")
        df = df.withColumn("_canon", F.transform("_rels", lambda x: F.struct(x["_start"], x["_end"], x["_type"], x["_mapping"], x["_key"]))).dropDuplicates(["_canon"]).drop("_canon")
        scope: Scope = {}
        for k, n in enumerate(p.nodes):
            if n.var:
                at = F.get("_nodes", F.get("_marks", F.lit(k)))
                df = df.withColumns({f"{n.var}__table_": at["table"], f"{n.var}__id_": at["id"]})
                scope[n.var] = Binding("node", n.var, n.label)
        for k, r in enumerate(p.rels):
            if r.var:
                part = F.slice("_rels", F.get("_marks", F.lit(k)) + 1, F.get("_marks", F.lit(k + 1)) - F.get("_marks", F.lit(k)))
                df = df.withColumns({f"{r.var}__rels_": part, f"{r.var}__nodes_": F.col("_nodes")})
                scope[r.var] = Binding("rels", r.var)
        scope[p.path] = Binding("path", "", None)
        if q.where is not None:
            df = self.with_properties(df, scope, q.where)
            df = df.where(self.predicate(q.where, scope, df))
        return df, scope

    def with_properties(self, df: DataFrame, scope: Scope, expr: Any) -> DataFrame:
        for var in {x.var for x in _props(expr)}:
            b = scope.get(var)
            if b is None or b.kind != "node":
                raise GraphError("semantic", f"unknown variable {var}")
            if b.label is None:
                raise GraphError("unsupported", f"{var} needs a label for its properties")
            df = df.join(self.scan(var, b.label).withColumnRenamed(f"{var}__id_", "_own"), F.col(f"{var}__id_") == F.col("_own"), "left").drop("_own")
        return df

    # -- expressions

    def column(self, var: str, path: tuple[str, ...], scope: Scope) -> tuple[Column, T.DataType]:
        """A property and its type; a dotted path goes into JSON text, variants or structs."""
        b = scope.get(var)
        if b is None:
            raise GraphError("semantic", f"unknown variable {var}")
        if b.kind == "value":
            raise GraphError("semantic", f"{var} has no properties")
        if b.kind != "node":
            raise GraphError("unsupported", "properties of relationships and paths can't be read")
        df = self.sources[self.catalog.table(b.label).name].df
        if path[0] not in self.catalog.properties(b.label, df):
            raise GraphError("semantic", f"{b.label} has no property {path[0]}")
        c, kind = F.col(f"{b.prefix}__{path[0]}"), df.schema[path[0]].dataType
        rest = list(path[1:])
        while rest and isinstance(kind, T.StructType):
            if rest[0] not in kind.names:
                raise GraphError("semantic", f"{path[0]} has no field {rest[0]}")
            c, kind = c[rest[0]], kind[rest[0]].dataType
            rest.pop(0)
        if rest:
            whole = c if isinstance(kind, T.VariantType) else F.try_parse_json(c)
            c, kind = F.try_variant_get(whole, "$." + ".".join(rest), "variant"), T.VariantType()
        return c, kind

    def value(self, x: Any) -> Any:
        if isinstance(x, Literal):
            return x.value
        if isinstance(x, Param):
            if x.name not in self.params:
                raise GraphError("parameter", f"parameter {x.name} is missing")
            return self.params[x.name]
        if isinstance(x, ListOf):
            return [self.value(i) for i in x.items]
        raise GraphError("semantic", "a literal or parameter is needed")

    def operand(self, x: Any, scope: Scope) -> tuple[Column | None, T.DataType | None, Any]:
        """(column, type, None) of a property, or (None, None, value)."""
        if isinstance(x, Prop):
            return *self.column(x.var, x.path, scope), None
        if isinstance(x, IdOf):
            if x.var not in scope or scope[x.var].kind != "node":
                raise GraphError("semantic", f"unknown variable {x.var}")
            return F.col(f"{scope[x.var].prefix}__id_"), T.StringType(), None
        return None, None, self.value(x)

    def predicate(self, x: Any, scope: Scope, df: DataFrame, plain: bool = True) -> Column:
        """Two-valued: a comparison that is not true is false.

        Outside NOT a filter takes null for false by itself, so comparisons stay
        ``plain`` there and reach the scans; inside it they are made non-null."""
        if isinstance(x, And):
            out = self.predicate(x.parts[0], scope, df, plain)
            for p in x.parts[1:]:
                out = out & self.predicate(p, scope, df, plain)
            return out
        if isinstance(x, Or):
            out = self.predicate(x.parts[0], scope, df, plain)
            for p in x.parts[1:]:
                out = out | self.predicate(p, scope, df, plain)
            return out
        if isinstance(x, Not):
            return ~self.predicate(x.inner, scope, df, False)
        out = self.comparison(x, scope)
        return out if plain else F.coalesce(out, F.lit(False))

    def comparison(self, x: Any, scope: Scope) -> Column:
        if isinstance(x, IsNull):
            c, kind, v = self.operand(x.operand, scope)
            if c is None:
                return F.lit((v is None) != x.negated)
            if isinstance(kind, T.VariantType):
                missing = c.isNull()
                null = F.is_variant_null(c)
                return F.coalesce((~null if x.negated else null) & ~missing, F.lit(False))
            return c.isNotNull() if x.negated else c.isNull()
        a, at, av = self.operand(x.left, scope)
        b, bt, bv = self.operand(x.right, scope)
        if x.op == "IN":
            if b is not None or not isinstance(bv, list):
                raise GraphError("execution", "IN needs a list")
            if a is None:
                return F.lit(av in bv)
            out = F.lit(False)
            known = [v for v in bv if v is not None and self.comparable(at, v)]
            if known and not isinstance(at, T.VariantType):
                out = a.isin([self.literal(v, at) for v in known])
            elif known:
                for v in known:
                    out = out | self.equal(a, at, None, None, v)
            return out | a.isNull() if None in bv else out
        if a is None and b is None:
            return F.lit(self.plain(x.op, av, bv))
        if a is None:
            a, at, b, bt, bv = b, bt, None, None, av
            x = Compare({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(x.op, x.op), None, None)
        if x.op == "=":
            return self.equal(a, at, b, bt, bv)
        if x.op == "<>":
            if isinstance(at, T.VariantType):
                return ~F.coalesce(self.equal(a, at, b, bt, bv), F.lit(False)) & a.isNotNull()
            if b is None and bv is not None and self.comparable(at, bv):
                return (a != self.literal(bv, at)) | a.isNull()
            return ~F.coalesce(self.equal(a, at, b, bt, bv), F.lit(False))
        return self.ordered(x.op, a, at, b, bt, bv)

    @staticmethod
    def plain(op: str, a: Any, b: Any) -> bool:
        if op in ("=", "<>"):
            return (a == b and type(a) is type(b)) == (op == "=")
        if type(a) is not type(b) and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
            raise GraphError("execution", "values of unlike types have no order")
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    @staticmethod
    def comparable(kind: T.DataType, v: Any) -> bool:
        if isinstance(kind, T.VariantType):
            return True
        if isinstance(v, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(v, (int, float)):
            return isinstance(kind, T.NumericType)
        return isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))

    @staticmethod
    def literal(v: Any, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(v).try_cast(kind)
        return F.lit(v)

    def equal(self, a: Column, at: T.DataType, b: Column | None, bt: T.DataType | None, v: Any) -> Column:
        if b is not None:
            if isinstance(at, T.NumericType) != isinstance(bt, T.NumericType):
                return a.isNull() & b.isNull()
            return a.eqNullSafe(b)
        if v is None:
            return F.coalesce(F.is_variant_null(a), F.lit(False)) if isinstance(at, T.VariantType) else a.isNull()
        if isinstance(at, T.VariantType):
            kind = "boolean" if isinstance(v, bool) else "double" if isinstance(v, (int, float)) else "string"
            known = {"boolean": ["BOOLEAN"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "string": ["STRING"]}[kind]
            typed = F.regexp_replace(F.schema_of_variant(a), r"\(.*", "").isin(known)
            return F.coalesce(typed & (F.try_variant_get(a, "$", kind) == F.lit(v)), F.lit(False))
        if not self.comparable(at, v):
            return F.lit(False)
        return a == self.literal(v, at)

    def ordered(self, op: str, a: Column, at: T.DataType, b: Column | None, bt: T.DataType | None, v: Any) -> Column:
        if b is None:
            if isinstance(at, T.VariantType):
                a = F.try_variant_get(a, "$", "double" if isinstance(v, (int, float)) else "string")
                b, ok = F.lit(v), v is not None and not isinstance(v, bool)
            else:
                ok = v is not None and not isinstance(v, bool) and self.comparable(at, v)
                b = self.literal(v, at) if ok else F.lit(None)
        else:
            ok = isinstance(at, T.NumericType) == isinstance(bt, T.NumericType)
        if not ok:
            if self.strict:
                raise GraphError("execution", "ordered comparison of null or unlike types")
            return F.lit(False)
        out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if self.strict:
            return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("PG017: ordered comparison of null")).cast("boolean")).otherwise(out)
        return out

    def property_map(self, n: NodePattern, var: str, scope: Scope, df: DataFrame) -> Column:
        scope = scope if var in scope else scope | {var: Binding("node", var, n.label)}
        out = F.lit(True)
        for k, v in n.props.items():
            value = self.value(v)
            out = out & self.predicate(Compare("=", Prop(var, (k,)), Literal(value)), scope, df)
        return out

    # -- projection

    def entity(self, var: str, scope: Scope, df: DataFrame) -> Column:
        """A variable as a value: node, relationship, list of them or path."""
        b = scope.get(var)
        if b is None:
            raise GraphError("semantic", f"unknown variable {var}")
        if b.kind == "value":
            return F.col(b.prefix)
        if b.kind == "node":
            identity = F.struct((F.lit(b.label) if b.label else F.col(f"{b.prefix}__table_")).alias("table"), F.col(f"{b.prefix}__id_").alias("id")).alias("_id")
            labels = F.array(F.lit(b.label) if b.label else F.col(f"{b.prefix}__table_")).alias("_labels")
            props = []
            if self.hydrate and b.label and f"{b.prefix}__{self.catalog.table(b.label).id_columns[0]}" in df.columns:
                source = self.sources[b.label].df
                props = [F.col(f"{b.prefix}__{c}").alias(c) for c in self.catalog.properties(b.label, source)]
            return F.when(F.col(f"{b.prefix}__id_").isNotNull(), F.struct(identity, labels, *props))
        if b.kind == "rel":
            props = []
            edge_only = b.label is not None and b.label not in self.catalog.tables
            if self.hydrate and edge_only:
                props = [F.col(f"{b.prefix}__{c}").alias(c) for c in self.sources[b.label].df.columns if f"{b.prefix}__{c}" in df.columns]
            return F.when(F.col(f"{b.prefix}__key_").isNotNull(), F.struct(F.col(f"{b.prefix}__type_").alias("_type"), F.col(f"{b.prefix}__start_").alias("_start"), F.col(f"{b.prefix}__end_").alias("_end"), *props))
        if b.kind == "rels":
            return F.transform(f"{b.prefix}__rels_", lambda x: F.struct(x["_type"], x["_start"], x["_end"]))
        return F.struct(F.struct(F.col("_nodes").alias("nodes"), F.transform("_rels", lambda x: F.struct(x["_type"], x["_start"], x["_end"])).alias("relationships")).alias("_path"))

    def item(self, i: Item, scope: Scope, df: DataFrame) -> Column:
        if i.kind == "var":
            return self.entity(i.name, scope, df)
        if i.kind == "prop":
            c, kind = self.column(i.name, i.path, scope)
            return c.cast("string") if isinstance(kind, T.VariantType) else c
        if i.kind == "agg":
            return self.aggregate(i, scope, df)
        if len(i.args) != 1:
            raise GraphError("semantic", f"{i.name} takes one argument")
        b = scope.get(i.args[0])
        if i.name == "id":
            if b is None or b.kind != "node":
                raise GraphError("semantic", "id takes a node")
            return F.col(f"{b.prefix}__id_")
        if b is None or b.kind != "path":
            raise GraphError("semantic", f"{i.name} takes a path")
        if i.name == "length":
            return F.size("_rels").cast("bigint")
        if i.name == "nodes":
            return F.col("_nodes")
        return F.transform("_rels", lambda x: F.struct(x["_type"], x["_start"], x["_end"]))

    def aggregate(self, i: Item, scope: Scope, df: DataFrame) -> Column:
        if not i.args:
            return F.count(F.lit(1))
        var = i.args[0]
        b = scope.get(var)
        if b is None:
            raise GraphError("semantic", f"unknown variable {var}")
        if i.path:
            c, kind = self.column(var, i.path, scope)
            if isinstance(kind, T.VariantType):
                c = c.cast("double") if i.name in ("sum", "avg") else c.cast("string")
        elif b.kind == "value":
            c, kind = F.col(b.prefix), df.schema[b.prefix].dataType
        elif i.name == "count":
            c, kind = F.col(f"{b.prefix}__id_" if b.kind == "node" else f"{b.prefix}__key_" if b.kind == "rel" else f"{b.prefix}__rels_"), None
            if i.distinct and b.kind == "rel":
                c = F.struct(f"{b.prefix}__mapping_", f"{b.prefix}__key_")
                c = F.when(F.col(f"{b.prefix}__key_").isNotNull(), c)
        elif i.name == "collect":
            c, kind = self.entity(var, scope, df), None
        else:
            raise GraphError("semantic", f"{i.name} takes a property")
        if i.name == "count":
            return F.countDistinct(c) if i.distinct else F.count(c)
        if i.name in ("sum", "avg"):
            if kind is not None and not isinstance(kind, (T.NumericType, T.VariantType)):
                raise GraphError("execution", f"{i.name} takes numbers")
            c = c.cast("double")
            if i.name == "sum":
                return F.sum_distinct(c) if i.distinct else F.sum(c)
            return F.sum_distinct(c) / F.countDistinct(c) if i.distinct else F.avg(c)
        if i.name in ("min", "max"):
            return (F.min if i.name == "min" else F.max)(c)
        return F.sort_array(F.collect_set(c) if i.distinct else F.collect_list(c))

    def project_with(self, df: DataFrame, scope: Scope, w: Any, several: bool) -> tuple[DataFrame, Scope]:
        aggs = [i for i in w.items if i.kind == "agg"]
        if aggs and not several:
            raise GraphError("unsupported", "aggregates in WITH need several patterns")
        if any(i.kind == "func" for i in w.items):
            raise GraphError("unsupported", "functions in WITH are not supported")
        new: Scope = {}
        values: dict[str, Column] = {}
        carried: list[str] = []
        for i in w.items:
            name = i.label
            if name in new:
                raise GraphError("semantic", f"WITH names {name} twice")
            if i.kind == "var" and i.name in scope and scope[i.name].kind != "value":
                new[name] = scope[i.name]
                carried += [c for c in df.columns if c.startswith(f"{scope[i.name].prefix}__")]
            else:
                if not i.alias and i.kind != "var":
                    raise GraphError("semantic", "WITH items need an alias")
                values[f"w__{name}"] = self.item(i, scope, df)
                new[name] = Binding("value", f"w__{name}")
        carried = list(dict.fromkeys(carried))
        if aggs:
            keys = [*carried, *(c.alias(k) for k, c in values.items() if not any(f"w__{a.label}" == k for a in aggs))]
            grouped = {f"w__{a.label}" for a in aggs}
            out = df.groupBy(*keys).agg(*(c.alias(k) for k, c in values.items() if k in grouped)) if keys else df.agg(*(c.alias(k) for k, c in values.items()))
        else:
            out = df.select(*carried, *(c.alias(k) for k, c in values.items()))
        if w.distinct:
            identity = [c for c in out.columns if c.startswith("w__") or c.endswith(("__id_", "__key_", "__rels_"))]
            out = out.dropDuplicates(identity)
        return out, new

    def returned(self, df: DataFrame, scope: Scope, q: Read) -> DataFrame:
        r = q.returns
        if any(b.kind == "path" for b in scope.values()):
            need = [Prop(i.name, i.path) for i in r.items if i.kind == "prop"]
            if need:
                df = self.with_properties(df, scope, need)
        aggs = any(i.kind == "agg" for i in r.items)
        columns = {i.label: self.item(i, scope, df) for i in r.items}
        names = list(columns)
        order: list[tuple[str, bool]] = []
        hidden: dict[str, Column] = {}
        for k, ((var, path), down) in enumerate(r.order):
            name = ".".join((var, *path))
            if name in columns:
                order.append((name, down))
            elif path and not aggs and not r.distinct:
                hidden[f"_sort{k}"] = self.column(var, path, scope)[0]
                order.append((f"_sort{k}", down))
            else:
                raise GraphError("semantic", f"ORDER BY {name} is not returned")
        if aggs:
            kinds = {i.label: i.kind for i in r.items}
            keys = [columns[n].alias(n) for n in names if kinds[n] != "agg"]
            found = [columns[n].alias(n) for n in names if kinds[n] == "agg"]
            out = (df.groupBy(*keys).agg(*found) if keys else df.agg(*found)).select(*(F.col(f"`{n}`") for n in names))
        else:
            out = df.select(*(c.alias(n) for n, c in (columns | hidden).items()))
        if r.distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*(F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() for n, down in order))
        if r.skip:
            out = out.offset(r.skip)
        if r.limit is not None:
            out = out.limit(r.limit)
        return out.select(*(F.col(f"`{n}`") for n in names)) if hidden else out


def _props(x: Any) -> list[Prop]:
    if isinstance(x, Prop):
        return [x]
    if isinstance(x, (And, Or)):
        return [p for y in x.parts for p in _props(y)]
    if isinstance(x, Not):
        return _props(x.inner)
    if isinstance(x, IsNull):
        return _props(x.operand)
    if isinstance(x, Compare):
        return _props(x.left) + _props(x.right)
    if isinstance(x, list):
        return [p for y in x for p in _props(y)]
    return []

"""Queries compiled to DataFrame plans.

A pattern is a chain of joins: scan of the start node, then per step the edges
of the wanted types on the current node and the nodes at the other end.
Filters of labels and property maps stand at the scans; properties that no
expression names are never selected, so they are pruned from the reads.  Hops
of variable length unroll to one join per level, each level deduplicated.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.lang import ast
from weftgraph.lang.errors import QueryError
from weftgraph.plans.values import AGGREGATES, Binder, Val, entity, is_list, is_map, type_name
from weftgraph.session import Scratch
from weftgraph.sources.graph import Graph


def walk(e):
    """All expression nodes below and at ``e``."""
    yield e
    if isinstance(e, (ast.Prop, ast.Index)):
        yield from walk(e.base)
        if isinstance(e, ast.Index):
            yield from walk(e.index)
    elif isinstance(e, ast.ListLit):
        for x in e.items:
            yield from walk(x)
    elif isinstance(e, ast.MapLit):
        for _, x in e.items:
            yield from walk(x)
    elif isinstance(e, (ast.Unary, ast.IsNull)):
        yield from walk(e.x)
    elif isinstance(e, ast.Binary):
        yield from walk(e.a)
        yield from walk(e.b)
    elif isinstance(e, ast.Call):
        for x in e.args:
            yield from walk(x)


def _pattern_exprs(p: ast.Pattern | None):
    if p is None:
        return
    for x in (p.start, *[y for step in p.steps for y in step]):
        for _, v in x.props:
            yield v


def expressions(q: ast.Query):
    for p in (q.match, q.merge, q.create):
        yield from _pattern_exprs(p)
    for w in q.withs:
        yield from (i.expr for i in w.items)
        if w.where is not None:
            yield w.where
        yield from (s.expr for s in w.order)
    if q.where is not None:
        yield q.where
    for s in q.sets:
        yield s[4]
        if s[3] is not None:
            yield s[3]
    yield from (i.expr for i in q.returns)
    yield from (s.expr for s in q.order)


def wanted_props(q: ast.Query, params: dict) -> list[str]:
    """Names of all properties that a query may read."""
    names = {}
    for e in expressions(q):
        for x in walk(e):
            if isinstance(x, ast.Prop):
                names[x.name] = 1
            elif isinstance(x, ast.Call) and x.name == "has_prop" and len(x.args) == 2:
                arg = x.args[1]
                if isinstance(arg, ast.Lit):
                    names[arg.value] = 1
                elif isinstance(arg, ast.Param):
                    names[str(params.get(arg.name))] = 1
    for p in (q.match, q.merge, q.create):
        if p is not None:
            for x in (p.start, *[y for step in p.steps for y in step]):
                names.update((k, 1) for k, _ in x.props)
    for s in q.sets:
        if s[2]:
            names[s[2]] = 1
        if s[0] == "merge" and isinstance(s[4], ast.MapLit):
            names.update((k, 1) for k, _ in s[4].items)
    return list(names)


def uses_path(q: ast.Query) -> bool:
    return any(p is not None and p.path for p in (q.match, q.merge))


@dataclass
class Rows:
    """A binding table: the plan, the scope, and the columns of its natural order."""

    df: DataFrame
    scope: dict[str, Val]
    order: list[Column]
    keys: list[str]  # columns that tell the rows apart, empty if none are known


class Compiler:
    """``max_rows``: optional bound on the rows of a MATCH; beyond it the query fails."""

    def __init__(self, graph: Graph, params: dict | None = None, max_rows: int | None = None):
        self.graph, self.params, self.max_rows = graph, params or {}, max_rows
        self.binder = Binder(self.params)
        self._n = 0

    def fresh(self, what: str) -> str:
        self._n += 1
        return f"_{what}{self._n}"

    # ---- reading part of a query

    def rows(self, q: ast.Query) -> Rows:
        """MATCH, WHERE and WITH of a query."""
        self.props = wanted_props(q, self.params)
        self.ordered = q.limit is not None or any(w.limit is not None for w in q.withs) or self._collects(q)
        if q.match is not None:
            r = self.match(q.match)
            if self.max_rows is not None and r.df.limit(self.max_rows + 1).count() > self.max_rows:
                raise QueryError("row_limit_exceeded", f"MATCH gives more than {self.max_rows} rows")
        else:
            r = Rows(self.graph.spark.range(1).select(F.lit(0).alias("_unit")), {}, [], ["_unit"])
        if q.where is not None:
            r = self.where(r, q.where)
        for w in q.withs:
            r = self.with_(r, w)
        return r

    def _collects(self, q: ast.Query) -> bool:
        return any(isinstance(x, ast.Call) and x.name == "collect" for e in expressions(q) for x in walk(e))

    def where(self, r: Rows, e) -> Rows:
        v = self.binder.bind(e, r.scope)
        if v.kind not in ("bool", "null"):
            raise QueryError("where_type_error", f"WHERE needs a boolean, not {type_name(v.kind)}")
        return replace(r, df=r.df.where(v.col.cast("boolean")))

    # ---- patterns

    def _matches(self, props: tuple, own: Val, scope: dict[str, Val]) -> Column | None:
        """The property map as a condition; a stored null equals null."""
        cond = None
        for name, e in props:
            want, have = self.binder.bind(e, scope), self.binder.property(own, name)
            if want.kind != "null" and have.kind != "null" and want.kind != have.kind:
                c = F.lit(False)
            elif want.kind == "null" or have.kind == "null":
                c = F.lit(False)  # a property that is absent matches nothing
            else:
                c = have.col == want.col
            cond = c if cond is None else cond & c
        return cond

    def node(self, pat: ast.NodePat, name: str) -> tuple[DataFrame, Val]:
        df, kinds = self.graph.scan_nodes(pat.labels, self.props, name)
        return df, Val(F.col(f"`{name}`"), "node", name, kinds)

    def match(self, p: ast.Pattern) -> Rows:
        start = p.start.var or self.fresh("n")
        df, val = self.node(p.start, start)
        cond = self._matches(p.start.props, val, {})
        if cond is not None:
            df = df.where(cond)
        scope = {start: val}
        self.path_nodes, self.path_edges = [F.array(F.col(f"`{start}`"))], []
        r = Rows(df, scope, [F.col(f"`{start}`")], [start])
        here = start
        traced = p.path is not None
        for edge, node in p.steps:
            r, here = self.hops(r, here, edge, node, traced) if edge.hops else self.step(r, here, edge, node)
        if traced:
            nodes = F.concat(*self.path_nodes)
            edges = F.concat(*self.path_edges) if self.path_edges else F.expr("cast(array() as array<bigint>)")
            kind = ("map", (("nodes", ("list", "int")), ("edges", ("list", "int"))))
            col = F.struct(nodes.alias("nodes"), edges.alias("edges"))
            r.df = r.df.withColumn(p.path, col)
            r.scope[p.path] = Val(F.col(f"`{p.path}`"), kind)
        r.scope = {k: v for k, v in r.scope.items() if not k.startswith("_")}
        return r

    def _edges(self, edge: ast.EdgePat, name: str, props: list[str]) -> tuple[DataFrame, Val]:
        """Edges by the end they are entered at (``·at``) and left at (``·to``)."""
        df, kinds = self.graph.scan_edges(edge.types, props, name)
        src, dst = F.col(f"`{name}·src`"), F.col(f"`{name}·dst`")
        out = df.withColumn(f"{name}·at", src).withColumn(f"{name}·to", dst)
        back = df.withColumn(f"{name}·at", dst).withColumn(f"{name}·to", src)
        if edge.direction == "in":
            out = back
        elif edge.direction == "both":
            out = out.unionByName(back.where(src != dst))  # a loop appears once
        return out, Val(F.col(f"`{name}`"), "edge", name, kinds)

    def step(self, r: Rows, here: str, edge: ast.EdgePat, node: ast.NodePat) -> tuple[Rows, str]:
        name = edge.var or self.fresh("e")
        again = edge.var in r.scope if edge.var else False
        inner = self.fresh("e") if again else name
        df, val = self._edges(edge, inner, self.props)
        joined = r.df.join(df, F.col(f"`{here}`") == F.col(f"`{inner}·at`"))
        if again:
            joined = joined.where(F.col(f"`{inner}`") == F.col(f"`{name}`"))
        scope = r.scope | ({} if again else {name: val})
        cond = self._matches(edge.props, val, scope)
        if cond is not None:
            joined = joined.where(cond)
        r = Rows(joined, scope, [*r.order, F.col(f"`{inner}`")], [*r.keys, inner] if r.keys else [])
        self.path_edges.append(F.array(F.col(f"`{inner}`")))
        return self.arrive(r, f"{inner}·to", node)

    def arrive(self, r: Rows, to: str, node: ast.NodePat) -> tuple[Rows, str]:
        """Bind the node whose id is in column ``to``."""
        if node.var and node.var in r.scope:
            if r.scope[node.var].kind != "node":
                raise QueryError("variable_type_error", f"{node.var} is not a node")
            df = r.df.where(F.col(f"`{to}`") == F.col(f"`{node.var}`"))
            for label in node.labels:
                df = df.where(F.array_contains(F.col(f"`{node.var}·labels`"), label))
            cond = self._matches(node.props, r.scope[node.var], r.scope)
            self.path_nodes.append(F.array(F.col(f"`{node.var}`")))
            return replace(r, df=df if cond is None else df.where(cond)), node.var
        name = node.var or self.fresh("n")
        nodes, val = self.node(node, name)
        scope = r.scope | {name: val}
        cond = self._matches(node.props, val, scope)
        df = r.df.join(nodes, F.col(f"`{to}`") == F.col(f"`{name}`"))
        self.path_nodes.append(F.array(F.col(f"`{name}`")))
        return replace(r, df=df if cond is None else df.where(cond), scope=scope), name

    def hops(self, r: Rows, here: str, edge: ast.EdgePat, node: ast.NodePat, traced: bool) -> tuple[Rows, str]:
        """Bounded breadth-first walk.

        A node is expanded once per depth and row; every edge out of an expanded
        node gives a result at its depth, also to nodes seen before.  Depth 0
        never gives a result.  With several levels the rows, the edges and each
        level are written once, so no level plans those before it again.
        """
        if edge.var:
            raise QueryError("variable_hop_edge_binding", "an edge of variable length cannot be bound")
        low, high = edge.hops
        to, at, trace, seen, depth = self.fresh("to"), self.fresh("at"), self.fresh("trace"), self.fresh("seen"), self.fresh("depth")
        traced = traced or self.ordered
        if r.keys:
            rid, base = r.keys, r.df
        else:
            row = self.fresh("row")
            rid, base = [row], r.df.withColumn(row, F.monotonically_increasing_id())
        scratch = Scratch(self.graph.spark, "hops") if high > 1 else None
        if scratch:
            base = scratch.cut(base, "rows")
        none = F.expr("cast(array() as array<bigint>)")
        frontier = base.withColumn(at, F.col(f"`{here}`"))
        if traced:
            frontier = frontier.withColumn(trace, none).withColumn(seen, none)
        parts = []
        rows_cols = base.columns
        name = self.fresh("e")
        df, val = self._edges(edge, name, [p for p, _ in edge.props])
        cond = self._matches(edge.props, val, r.scope)
        if scratch and high > 0:
            df = scratch.cut(df, "edges")
        for k in range(1, high + 1):
            joined = frontier.join(df, F.col(at) == F.col(f"`{name}·at`"))
            if cond is not None:
                joined = joined.where(cond)
            cols = [*[F.col(f"`{c}`") for c in rows_cols], F.col(f"`{name}·to`").alias(to)]
            if traced:
                cols += [F.array_append(trace, F.col(f"`{name}`")).alias(trace), F.array_append(seen, F.col(f"`{name}·to`")).alias(seen)]
            level = joined.select(*cols)
            if scratch:
                level = scratch.cut(level, f"level{k}")
            if k >= low:
                parts.append(level.withColumn(depth, F.lit(k)))
            if k < high:
                if traced:
                    first = F.min(F.struct(trace, seen)).alias("first")
                    rest = [F.first(f"`{c}`").alias(c) for c in rows_cols if c not in rid]
                    frontier = level.groupBy(*[f"`{c}`" for c in rid], F.col(to).alias(at)).agg(first, *rest)
                    frontier = frontier.select(*[F.col(f"`{c}`") for c in rows_cols], at, F.col(f"first.{trace}").alias(trace), F.col(f"first.{seen}").alias(seen))
                else:
                    frontier = level.dropDuplicates([*rid, to]).withColumnRenamed(to, at)
        if not parts:
            parts = [base.limit(0).withColumn(to, F.col(f"`{here}`")).withColumn(depth, F.lit(0))]
            if traced:
                parts = [parts[0].withColumn(trace, none).withColumn(seen, none)]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        order = [*r.order, F.col(depth), *([F.col(trace)] if traced else [])]
        if traced:
            self.path_edges.append(F.col(trace))
            self.path_nodes.append(F.slice(F.col(seen), F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        out = Rows(df, r.scope, order, [])
        return self.arrive(out, to, node)

    # ---- WITH, RETURN, aggregates

    def aggregate_call(self, e) -> bool:
        return isinstance(e, ast.Call) and e.name in AGGREGATES

    def _check_aggregates(self, items: list[ast.Item]) -> bool:
        found = False
        for i in items:
            if self.aggregate_call(i.expr):
                found = True
                inner = [x for a in i.expr.args for x in walk(a)]
            else:
                inner = list(walk(i.expr))
            if any(self.aggregate_call(x) for x in inner):
                raise QueryError("function_error", "an aggregate must be a whole item")
        return found

    def aggregate(self, call: ast.Call, r: Rows) -> tuple[Column, object]:
        if call.star:
            if call.name != "count":
                raise QueryError("function_error", f"{call.name}(*) is not defined")
            return F.count(F.lit(1)), "int"
        if len(call.args) != 1:
            raise QueryError("function_error", f"{call.name}() takes one argument")
        v = self.binder.bind(call.args[0], r.scope)
        if call.name == "count":
            return F.count(v.col), "int"
        if call.name in ("sum", "avg"):
            if v.kind not in ("int", "float", "null"):
                raise QueryError("aggregate_type_error", f"{call.name}() needs numbers")
            c = v.col if v.kind != "null" else v.col.cast("bigint")
            return (F.sum(c), v.kind) if call.name == "sum" else (F.avg(c), "float")
        if call.name in ("min", "max"):
            if is_list(v.kind):
                return (F.min_by if call.name == "min" else F.max_by)(v.col, F.size(v.col)), v.kind
            if is_map(v.kind):
                size = F.size(v.col) if v.kind[0] == "dict" else F.when(v.col.isNotNull(), F.lit(len(v.kind[1])))
                return (F.min_by if call.name == "min" else F.max_by)(v.col, size), v.kind
            return (F.min if call.name == "min" else F.max)(v.col), v.kind
        # collect keeps nulls and the order of the rows
        pack = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(r.order)], v.col.alias("x"))
        return F.transform(F.array_sort(F.collect_list(pack)), lambda s: s.getField("x")), ("list", v.kind)

    def entity_columns(self, v: Val) -> list[str]:
        extra = ["labels"] if v.kind == "node" else ["src", "dst", "type"]
        return [v.name, *[f"{v.name}·{x}" for x in (*extra, *(v.props or {}))]]

    def project(self, r: Rows, items: list[tuple[str, ast.Item]]) -> Rows:
        """The items under their names; entities keep their columns."""
        if len({n for n, _ in items}) < len(items):
            raise QueryError("duplicate_column", "two items have the same name")
        grouped = self._check_aggregates([i for _, i in items])
        keys, keep, scope, aggs, key_cols = [], [], {}, [], []
        for name, item in items:
            if self.aggregate_call(item.expr):
                col, kind = self.aggregate(item.expr, r)
                aggs.append(col.alias(name))
                scope[name] = Val(F.col(f"`{name}`"), kind)
                continue
            v = self.binder.bind(item.expr, r.scope)
            if entity(v.kind) and v.name is not None:
                for c in self.entity_columns(v):
                    new = name + c[len(v.name) :]
                    keys.append(F.col(f"`{c}`").alias(new))
                    keep.append(new)
                scope[name] = Val(F.col(f"`{name}`"), v.kind, name, v.props)
                key_cols.append(name)
            else:
                keys.append(v.col.alias(name))
                keep.append(name)
                scope[name] = Val(F.col(f"`{name}`"), v.kind, None, v.props)
                key_cols.append(name)
        if grouped:
            df = r.df.groupBy(*keys).agg(*aggs) if keys else r.df.agg(*aggs)
            return Rows(df, scope, [F.col(f"`{c}`").asc_nulls_last() for c in key_cols], key_cols)
        hidden = []
        order = []
        if self.ordered:
            for k, o in enumerate(r.order):
                h = self.fresh(f"ord{k}_")
                hidden.append(o.alias(h))
                order.append(F.col(h))
        return Rows(r.df.select(*keys, *hidden), scope, order, [])

    def with_(self, r: Rows, w: ast.With) -> Rows:
        if not w.star:
            named = []
            for i, item in enumerate(w.items):
                name = item.alias or (item.expr.name if isinstance(item.expr, ast.Var) else f"col_{i + 1}")
                named.append((name, item))
            r = self.project(r, named)
        if w.where is not None:
            r = self.where(r, w.where)
        return self.sorted(r, w.order, w.limit)

    def sorted(self, r: Rows, order: list[ast.Sort], limit: int | None) -> Rows:
        if not order and limit is None:
            return r
        by = []
        for s in order:
            if isinstance(s.expr, ast.Var) and s.expr.name not in r.scope:
                continue  # a name that is not bound here orders nothing
            v = self.binder.bind(s.expr, r.scope)
            c = F.size(v.col) if is_list(v.kind) else v.col
            if is_map(v.kind):
                continue
            by.append(c.desc_nulls_first() if s.descending else c.asc_nulls_last())
        df = r.df
        full = [*by, *r.order]
        if full:
            df = df.orderBy(*full)
        if limit is not None:
            df = df.limit(limit)
        if by and self.ordered:
            # after a global sort, ids that grow within and over partitions are places
            place = self.fresh("ord")
            return replace(r, df=df.withColumn(place, F.monotonically_increasing_id()), order=[F.col(place)])
        return replace(r, df=df)

    def finish(self, q: ast.Query, r: Rows) -> DataFrame:
        """ORDER BY and LIMIT, then RETURN: they work on the rows before it."""
        r = self.sorted(r, q.order, q.limit)
        if q.return_all:
            names = sorted(n for n in r.scope if not n.startswith("_"))
            return r.df.select(*[self.shown(r.scope[n]).alias(n) for n in names])
        if not q.returns:
            return r.df.limit(0).select()
        items = [(i.alias or f"col_{k + 1}", i) for k, i in enumerate(q.returns)]
        was, self.ordered = self.ordered, False
        out = self.project(r, items)
        self.ordered = was
        return out.df.select(*[self.shown(out.scope[n]).alias(n) for n, _ in items])

    def shown(self, v: Val) -> Column:
        """Results have no untyped columns."""
        return v.col.cast("string") if v.kind == "null" else v.col

    def run(self, q: ast.Query) -> DataFrame:
        return self.finish(q, self.rows(q))


# ---- EXPLAIN

def _constraints(q: ast.Query, params: dict) -> list[tuple[str, str, object]]:
    """(operator, property, value) tests of the start node that stand in AND trees."""
    start = q.match.start
    binder_free = lambda e: isinstance(e, (ast.Lit, ast.Param))
    value = lambda e: e.value if isinstance(e, ast.Lit) else params.get(e.name)
    out = [("=", k, value(v)) for k, v in start.props if binder_free(v)]

    def visit(e) -> None:
        if not isinstance(e, ast.Binary):
            return
        if e.op == "AND":
            visit(e.a)
            visit(e.b)
            return
        own = lambda x: isinstance(x, ast.Prop) and isinstance(x.base, ast.Var) and x.base.name == start.var
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
        if own(e.a) and binder_free(e.b) and e.op in ("=", "<", "<=", ">", ">=", "CONTAINS"):
            out.append((e.op, e.a.name, value(e.b)))
        elif own(e.b) and binder_free(e.a) and e.op in flip:
            out.append((flip[e.op], e.b.name, value(e.a)))
        elif own(e.b) and binder_free(e.a) and e.op == "IN":
            out.append(("IN", e.b.name, value(e.a)))

    if q.where is not None:
        visit(q.where)
    return out


def fold_bounds(tests: list[tuple[str, str, object]]) -> dict[str, tuple]:
    """Per property the tightest lower and upper bound, each (value, inclusive)."""
    out: dict[str, list] = {}
    for op, prop, v in tests:
        low, high = out.setdefault(prop, [None, None])
        if op in ("=", ">", ">="):
            cand = (v, op != ">")
            if low is None or (v, not cand[1]) > (low[0], not low[1]):
                out[prop][0] = cand
        if op in ("=", "<", "<="):
            cand = (v, op != "<")
            if high is None or (v, cand[1]) < (high[0], high[1]):
                out[prop][1] = cand
    return {k: tuple(v) for k, v in out.items() if v[0] or v[1]}


def access_path(q: ast.Query, graph: Graph, params: dict) -> tuple[str, str]:
    """The operator that stands for the start of a match, and its detail."""
    start = q.match.start
    tests = _constraints(q, params)
    for label in start.labels:
        for op, prop, v in tests:
            if op == "=" and graph.catalog.index_for(label, prop, "EQ"):
                return "NodeIndexSeek", f":{label}({prop} = {v})"
        for prop, (low, high) in fold_bounds(tests).items():
            if graph.catalog.index_for(label, prop, "RANGE"):
                parts = [f"{'>=' if low[1] else '>'} {low[0]}"] if low else []
                parts += [f"{'<=' if high[1] else '<'} {high[0]}"] if high else []
                return "NodeIndexRangeScan", f":{label}({prop} {' AND '.join(parts)})"
        for op, prop, v in tests:
            if op in ("IN", "CONTAINS") and graph.catalog.index_for(label, prop, "LIST"):
                return "NodeListIndexScan", f":{label}({prop} contains {v})"
            if op == "CONTAINS" and graph.catalog.index_for(label, prop, "FULLTEXT"):
                return "NodeFullTextIndexScan", f":{label}({prop} contains {v})"
    return "NodeScan", f":{start.labels[0]}" if start.labels else "all nodes"


def explain(statement, graph: Graph, params: dict) -> list[tuple]:
    """(id, parent_id, operator, detail) rows of a statement; nothing is run."""
    if isinstance(statement, ast.Explain):
        return [(1, None, "Explain", "")]
    if isinstance(statement, ast.Command):
        a = statement.args
        name = "".join(w.capitalize() for w in statement.verb.split())
        detail = a.get("name") or (a["target"].name if "target" in a else a.get("what", ""))
        if statement.verb == "CREATE INDEX":
            detail = a["property"]
        elif statement.verb == "CREATE CONSTRAINT":
            s = a["spec"]
            detail = {"TYPE": lambda: f"{s[1]} TYPE {s[2]}", "ENDPOINTS": lambda: f"ENDPOINTS :{s[1]} -> :{s[2]}", "MAX OUTGOING": lambda: f"MAX OUTGOING {s[1]}"}.get(s[0], lambda: f"{s[1]} {s[0]}")()
        elif statement.verb in ("CREATE OBJECT", "DROP OBJECT"):
            name = statement.verb.split()[0].capitalize() + ("Label" if a["target"].kind == "label" else "EdgeType")
        elif statement.verb == "ALTER INDEX":
            detail = f"{a['name']} {a['status']}"
        elif statement.verb == "ALTER CONSTRAINT":
            detail = f"{a['name']} -> {a['to']}"
        elif statement.verb == "ROLLBACK TO":
            name = "RollbackToSavepoint"
        elif statement.verb == "RELEASE":
            name = "ReleaseSavepoint"
        return [(1, None, name, detail or "")]
    q = statement
    steps = []
    if q.match is not None:
        steps.append(access_path(q, graph, params))
    for present, row in (
        (q.where is not None, ("Filter", "WHERE")), (bool(q.withs), ("With", "WITH")), (q.merge is not None, ("Merge", "pattern")),
        (q.create is not None, ("Create", "pattern")), (bool(q.sets), ("Set", "properties")), (bool(q.removes), ("Remove", "properties")),
        (bool(q.deletes), ("Delete", "variables")), (bool(q.return_all or q.returns), ("Project", "RETURN")), (bool(q.order), ("Order", "ORDER BY")), (q.limit is not None, ("Limit", "LIMIT")),
    ):
        if present:
            steps.append(row)
    return [(1, None, "Query", ""), *[(k + 2, 1, op, detail) for k, (op, detail) in enumerate(steps)]]

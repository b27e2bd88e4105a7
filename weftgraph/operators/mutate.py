"""CREATE, MERGE, SET, REMOVE and DELETE as rewrites of node and edge tables.

The binding table is written once; every clause is a set-based change of the
parts it touches.  RETURN then reads the entities anew, by their ids.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.lang import ast
from weftgraph.lang.errors import QueryError
from weftgraph.plans.compiler import Compiler, Rows, walk
from weftgraph.plans.values import Val, entity
from weftgraph.session import Scratch
from weftgraph.sources.graph import Graph, Part, kind_of


#: Deletions that may stay as plans on one part before it is written out.
STACKED = 3


def number(scratch: Scratch, df: DataFrame, name: str, base: int) -> tuple[DataFrame, int]:
    """Rows with dense ids from ``base``, without a global sort.

    The table is written; each of its read splits gets an offset (one number
    per split goes through the driver) and counts on from it.
    """
    table = scratch.cut(df, "numbered").withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["__p"]: r["n"] for r in table.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, at = {}, base
    for p in sorted(sizes):
        offset[p] = at
        at += sizes[p]
    if not offset:
        return df.limit(0).withColumn(name, F.lit(0).cast("bigint")), 0
    starts = df.sparkSession.createDataFrame(list(offset.items()), "__p int, __o bigint")
    out = table.join(F.broadcast(starts), "__p").withColumn(name, F.col("__o") + F.col("__m")).drop("__p", "__m", "__o")
    return scratch.cut(out, "ids"), at - base


class Mutation:
    def __init__(self, graph: Graph, params: dict | None = None):
        self.graph, self.params = graph, params or {}
        self.scratch = Scratch(graph.spark, "mutation")

    def run(self, q: ast.Query) -> tuple[Graph, DataFrame]:
        """The changed graph and the result of RETURN."""
        self.compiler = Compiler(self.graph, self.params)
        self._bound = bound_names(q)
        r = self.compiler.rows(q)
        r = self._settle(r)
        if q.merge is not None:
            r = self._merge(r, q.merge)
        if q.create is not None:
            r = self._create(r, q.create)
        for change in q.sets:
            r = self._set(r, change)
        for kind, var, name in q.removes:
            if kind == "label":
                self._bound.pop(var, None)
            r = self._remove(r, kind, var, name)
        if q.deletes:
            self._delete(r, q.deletes)
            r = self._refresh(r)
        self.compiler.graph = self.graph
        return self.graph, self.compiler.finish(q, r)

    def _settle(self, r: Rows) -> Rows:
        """Write the binding table, so that changes do not move under it."""
        order = [o.alias(f"_o{k}") for k, o in enumerate(r.order)]
        df = self.scratch.cut(r.df.select("*", *order), "rows")
        return Rows(df, r.scope, [F.col(f"_o{k}") for k in range(len(order))], r.keys)

    def _near(self, name: str, kind: str) -> Graph:
        """The graph without the parts that cannot hold a variable, by its labels or types."""
        own = [p for p in (self.graph.nodes if kind == "node" else self.graph.edges) if self._may_hold(p, name)]
        return self.graph.but(nodes=own) if kind == "node" else self.graph.but(edges=own)

    def _may_hold(self, part: Part, name: str) -> bool:
        known = self._bound.get(name)
        if not known:
            return True
        return part.type in known if part.type is not None else part.labels is None or set(known) <= set(part.labels)

    def _refresh(self, r: Rows) -> Rows:
        """Entities as they are in the changed graph; deleted ones read as null."""
        keep, scope, df = [], {}, r.df
        for name, v in r.scope.items():
            if not entity(v.kind) or v.name is None:
                keep.append(F.col(f"`{name}`"))
                scope[name] = v
        hidden = [c for c in df.columns if c.startswith(("_o", "_k", "_v", "_rid"))]
        entities = [(n, v) for n, v in r.scope.items() if entity(v.kind) and v.name is not None]
        df = df.select(*keep, *[F.col(f"`{c}`") for c in hidden], *[F.col(f"`{v.name}`").alias(n) for n, v in entities])
        for name, v in entities:
            here = self._near(name, v.kind)
            if v.kind == "node":
                fresh, kinds = here.scan_nodes((), self.compiler.props, "·x")
            else:
                fresh, kinds = here.scan_edges((), self.compiler.props, "·x")
            fresh = fresh.select(*[F.col(f"`{c}`").alias(name + c[2:] if c != "·x" else "·key") for c in fresh.columns])
            df = df.join(fresh, F.col(f"`{name}`") == F.col("`·key`"), "left").drop("·key")
            if v.kind == "node":
                none = F.expr("cast(array() as array<string>)")
                df = df.withColumn(f"{name}·labels", F.coalesce(F.col(f"`{name}·labels`"), none))
            scope[name] = Val(F.col(f"`{name}`"), v.kind, name, kinds)
        return Rows(df, scope, r.order, [])

    # ---- CREATE and MERGE

    def _bind_props(self, props: tuple, scope: dict) -> list[tuple[str, Val]]:
        return [(k, self.compiler.binder.bind(e, scope)) for k, e in props]

    @staticmethod
    def _typed(v: Val) -> Column:
        return v.col if v.kind != "null" else F.lit(None).cast("string")

    def _new_nodes(self, r: Rows, pat: ast.NodePat, name: str) -> Rows:
        df, n = number(self.scratch, r.df, name, self.graph.next_node)
        props = [self._typed(v).alias(k) for k, v in self._bind_props(pat.props, r.scope)]
        part = Part(self.scratch.cut(df.select(F.col(f"`{name}`").alias("id"), *props), "nodes"), tuple(sorted(set(pat.labels))))
        self.graph = self.graph.but(nodes=[*self.graph.nodes, part], next_node=self.graph.next_node + n)
        return Rows(df, r.scope | {name: Val(F.col(f"`{name}`"), "node", name, {})}, r.order, r.keys)

    def _create(self, r: Rows, p: ast.Pattern) -> Rows:
        def place(r: Rows, pat: ast.NodePat) -> tuple[Rows, str]:
            if pat.var and pat.var in r.scope:
                if r.scope[pat.var].kind != "node":
                    raise QueryError("variable_type_error", f"{pat.var} is not a node")
                return r, r.scope[pat.var].name or pat.var
            name = pat.var or self.compiler.fresh("n")
            return self._new_nodes(r, pat, name), name

        r, here = place(r, p.start)
        nodes, edges = [here], []
        for edge, pat in p.steps:
            if len(edge.types) != 1:
                raise QueryError("create_edge_type", "a created edge needs exactly one type")
            if edge.hops:
                raise QueryError("create_variable_hop", "edges of variable length cannot be created")
            r, there = place(r, pat)
            name = edge.var or self.compiler.fresh("e")
            df, n = number(self.scratch, r.df, name, self.graph.next_edge)
            a, b = (there, here) if edge.direction == "in" else (here, there)
            props = [self._typed(v).alias(k) for k, v in self._bind_props(edge.props, r.scope)]
            made = self.scratch.cut(df.select(F.col(f"`{name}`").alias("id"), F.col(f"`{a}`").alias("src"), F.col(f"`{b}`").alias("dst"), *props), "edges")
            self._unique(made, edge.types[0])
            self.graph = self.graph.but(edges=[*self.graph.edges, Part(made, type=edge.types[0])], next_edge=self.graph.next_edge + n)
            r = Rows(df, r.scope | {name: Val(F.col(f"`{name}`"), "edge", name, {})}, r.order, r.keys)
            edges.append(name)
            nodes.append(there)
            here = there
        if p.path:
            kind = ("map", (("nodes", ("list", "int")), ("edges", ("list", "int"))))
            none = F.expr("cast(array() as array<bigint>)")
            col = F.struct(F.array(*[F.col(f"`{n}`") for n in nodes]).alias("nodes"), (F.array(*[F.col(f"`{e}`") for e in edges]) if edges else none).alias("edges"))
            r = Rows(r.df.withColumn(p.path, col), r.scope | {p.path: Val(F.col(f"`{p.path}`"), kind)}, r.order, r.keys)
        r.scope = {k: v for k, v in r.scope.items() if not k.startswith("_")}
        return self._refresh(r)

    def _unique(self, made: DataFrame, kind: str) -> None:
        old, _ = self.graph.scan_edges((kind,), [], "e")
        pairs = made.select("src", "dst")
        twice = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src", "dst")
        clash = pairs.join(old.select(F.col("e·src").alias("src"), F.col("e·dst").alias("dst")), ["src", "dst"], "left_semi")
        if not twice.union(clash).isEmpty():
            raise QueryError("duplicate_edge", f"an edge of type {kind} between these nodes exists")

    def _merge(self, r: Rows, p: ast.Pattern) -> Rows:
        """Rows that match the whole pattern keep their matches; the others share
        one creation per distinct set of pattern values."""
        r, _ = self._row_ids(r)
        c = self.compiler
        bound = [x.var for x in (p.start, *[y for s in p.steps for y in s]) if x.var and x.var in r.scope]
        probe = Compiler(self.graph, self.params)
        probe.props, probe.ordered, probe._n = c.props, False, c._n + 1000
        found = self._match_from(probe, r, p)
        c._n = probe._n
        found_df = self.scratch.cut(found.df, "matched")
        missing = r.df.join(found_df.select("_rid").distinct(), "_rid", "left_anti")
        values = []
        for x in (p.start, *[y for s in p.steps for y in s]):
            if not (isinstance(x, ast.NodePat) and x.var in r.scope):
                values += [self._typed(v) for _, v in self._bind_props(x.props, r.scope)]
        group = [F.lit(0).alias("_kall")] + [F.col(f"`{b}`").alias(f"_k{k}") for k, b in enumerate(bound)] + [v.alias(f"_v{k}") for k, v in enumerate(values)]
        keys = ["_kall"] + [f"_k{k}" for k in range(len(bound))] + [f"_v{k}" for k in range(len(values))]
        keyed = self.scratch.cut(missing.select("*", *group), "missing")
        firsts = keyed.groupBy(*keys).agg(F.min("_rid").alias("_rid"))
        lead = keyed.join(firsts.select("_rid"), "_rid", "left_semi")
        made = self._create(Rows(lead, r.scope, r.order, []), p)
        new = [n for n in made.scope if n not in r.scope]
        back = made.df.select(*[F.col(k) for k in keys], *[F.col(f"`{n}`") for n in new])
        on = None
        rest = keyed
        renamed = back.select(*[F.col(k).alias(f"·{k}") for k in keys], *[F.col(f"`{n}`") for n in new])
        for k in keys:
            cond = F.col(k).eqNullSafe(F.col(f"`·{k}`"))
            on = cond if on is None else on & cond
        rest = rest.join(renamed, on)
        old_cols = [F.col(f"`{v.name or n}`").alias(n) for n, v in r.scope.items()]
        hidden = [F.col(f"_o{k}") for k in range(len(r.order))]
        a = found_df.select(*old_cols, *hidden, *[F.col(f"`{n}`") for n in new])
        b = rest.select(*old_cols, *hidden, *[F.col(f"`{n}`") for n in new])
        scope = {n: made.scope.get(n) or v for n, v in r.scope.items()} | {n: made.scope[n] for n in new}
        both = Rows(self.scratch.cut(a.unionByName(b), "merged"), scope, r.order, [])
        return self._refresh(both)

    def _row_ids(self, r: Rows) -> tuple[Rows, int]:
        df, n = number(self.scratch, r.df, "_rid", 0)
        return Rows(df, r.scope, r.order, ["_rid"]), n

    def _match_from(self, c: Compiler, r: Rows, p: ast.Pattern) -> Rows:
        c.path_nodes, c.path_edges = [], []
        if p.start.var and p.start.var in r.scope:
            here = r.scope[p.start.var].name or p.start.var
        else:
            here = p.start.var or c.fresh("n")
            nodes, val = c.node(p.start, here)
            cond = c._matches(p.start.props, val, r.scope | {here: val})
            df = r.df.crossJoin(nodes) if cond is None else r.df.join(nodes, cond)
            r = Rows(df, r.scope | {here: val}, r.order, r.keys)
        c.path_nodes.append(F.array(F.col(f"`{here}`")))
        for edge, node in p.steps:
            if edge.hops:
                raise QueryError("merge_variable_hop", "edges of variable length cannot be merged")
            r, here = c.step(r, here, edge, node)
        if p.path:
            none = F.expr("cast(array() as array<bigint>)")
            col = F.struct(F.concat(*c.path_nodes).alias("nodes"), (F.concat(*c.path_edges) if c.path_edges else none).alias("edges"))
            r = Rows(r.df.withColumn(p.path, col), r.scope | {p.path: Val(F.col(f"`{p.path}`"), ("map", (("nodes", ("list", "int")), ("edges", ("list", "int")))))}, r.order, r.keys)
        return r

    # ---- SET and REMOVE

    def _entity(self, r: Rows, var: str) -> Val:
        if var not in r.scope:
            raise QueryError("unknown_variable", f"unknown variable {var}")
        v = r.scope[var]
        if not entity(v.kind):
            raise QueryError("set_type_error", f"{var} is not a node or an edge")
        return v

    def _set(self, r: Rows, change: tuple) -> Rows:
        kind, var, prop, index, e = change
        v = self._entity(r, var)
        bind = self.compiler.binder.bind
        if kind == "merge":
            new = bind(e, r.scope)
            if new.kind == "null" or not isinstance(new.kind, tuple) or new.kind[0] not in ("map", "dict"):
                raise QueryError("set_type_error", "+= needs a map")
            if new.kind[0] == "dict":
                return r
            pairs = [(k, self.compiler.binder.key(new, k)) for k, _ in new.kind[1]]
        elif index is not None:
            have, i, x = self.compiler.binder.property(v, prop), bind(index, r.scope), bind(e, r.scope)
            if not (isinstance(have.kind, tuple) and have.kind[0] == "list") or i.kind != "int":
                raise QueryError("index_type_error", f"{prop} is not a list indexed by an integer")
            fits = (i.col >= 0) & (i.col < F.size(have.col))
            put = F.transform(have.col, lambda y, j: F.when(j == i.col, x.col).otherwise(y))
            pairs = [(prop, Val(F.when(fits, put).otherwise(F.raise_error(F.lit("index_type_error")).cast(r.df.select(have.col).schema[0].dataType)), have.kind))]
        else:
            pairs = [(prop, bind(e, r.scope))]
        own = any(isinstance(x, ast.Prop) and isinstance(x.base, ast.Var) and x.base.name == var for x in walk(e))
        rank = F.struct(*r.order) if r.order else F.lit(0)
        cols = [self._typed(x).alias(f"new{k}") for k, (_, x) in enumerate(pairs)]
        rows = r.df.select(v.col.alias("id"), rank.alias("rank"), *cols).where("id IS NOT NULL")
        if own and not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise QueryError("set_fold_error", "an entity that occurs in several rows cannot be updated from its own properties")
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*[f"new{k}" for k in range(len(pairs))]), "rank").alias("new"))
        latest = self.scratch.cut(latest, "updates")
        names = {p: (F.col(f"new.new{k}"), x.kind) for k, (p, x) in enumerate(pairs)}
        self._patch(v.kind, var, latest, names)
        for p, _ in pairs:
            if p not in self.compiler.props:
                self.compiler.props.append(p)
        return self._refresh(r)

    def _patch(self, kind: str, var: str, updates: DataFrame, names: dict) -> None:
        def patched(part: Part) -> Part:
            df = part.df.join(updates, "id", "left")
            hit = F.col("new").isNotNull()
            cols = [F.col(f"`{c}`") for c in part.df.columns if c not in names]
            for p, (col, k) in names.items():
                if part.has(p):
                    t = part.df.schema[p].dataType
                    if k not in ("null", kind_of(t)) and kind_of(t) != "null":
                        raise QueryError("property_type_conflict", f"{p} holds values of another type")
                    old = F.col(f"`{p}`") if not isinstance(t, T.NullType) else F.lit(None)
                    cols.append(F.when(hit, col.cast(t) if kind_of(t) != "null" else col).otherwise(old).alias(p))
                else:
                    cols.append(F.when(hit, col).alias(p))
            return replace(part, df=self.scratch.cut(df.select(*cols), "patched"))

        parts = self.graph.nodes if kind == "node" else self.graph.edges
        single = sum(self._may_hold(p, var) for p in parts) == 1
        touched = lambda p: self._may_hold(p, var) and (single or not p.df.join(updates, "id", "left_semi").isEmpty())
        if kind == "node":
            self.graph = self.graph.but(nodes=[patched(p) if touched(p) else p for p in self.graph.nodes])
        else:
            self.graph = self.graph.but(edges=[patched(p) if touched(p) else p for p in self.graph.edges])

    def _remove(self, r: Rows, kind: str, var: str, name: str) -> Rows:
        v = self._entity(r, var)
        ids = self.scratch.cut(r.df.select(v.col.alias("id")).where("id IS NOT NULL").distinct(), "ids").withColumn("hit", F.lit(True))
        if kind == "label":
            def strip(part: Part) -> Part:
                own = F.col("labels") if part.labels is None else F.array(*[F.lit(x) for x in part.labels]).cast("array<string>")
                df = part.df.withColumn("labels", own).join(ids, "id", "left")
                new = F.when(F.col("hit"), F.array_remove("labels", name)).otherwise(F.col("labels"))
                return Part(self.scratch.cut(df.withColumn("labels", new).drop("hit"), "stripped"))

            self.graph = self.graph.but(nodes=[strip(p) if p.labels is None or name in p.labels else p for p in self.graph.nodes])
        else:
            def drop(part: Part) -> Part:
                df = part.df.join(ids, "id", "left")
                return replace(part, df=self.scratch.cut(df.withColumn(name, F.when(F.col("hit").isNull(), F.col(f"`{name}`"))).drop("hit"), "dropped"))

            if v.kind == "node":
                self.graph = self.graph.but(nodes=[drop(p) if p.has(name) else p for p in self.graph.nodes])
            else:
                self.graph = self.graph.but(edges=[drop(p) if p.has(name) else p for p in self.graph.edges])
        return self._refresh(r)

    def _delete(self, r: Rows, names: list[str]) -> None:
        """Edges first, then nodes; a node takes its edges with it."""
        edges = nodes = None
        for n in names:
            v = self._entity(r, n)
            ids = r.df.select(v.col.alias("id")).where("id IS NOT NULL")
            if v.kind == "edge":
                edges = ids if edges is None else edges.union(ids)
            else:
                nodes = ids if nodes is None else nodes.union(ids)
        parts = self.graph.edges
        if edges is not None:
            gone = self.scratch.cut(edges.distinct(), "gone-edges")
            held = [any(self._may_hold(p, n) for n in names if r.scope[n].kind == "edge") for p in parts]
            parts = [self._without(p, p.df.join(gone, "id", "left_anti")) if h else p for p, h in zip(parts, held)]
        if nodes is not None:
            gone = self.scratch.cut(nodes.distinct(), "gone-nodes")
            src, dst = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
            parts = [self._without(p, p.df.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*p.df.columns)) for p in parts]
            held = [any(self._may_hold(p, n) for n in names if r.scope[n].kind == "node") for p in self.graph.nodes]
            self.graph = self.graph.but(nodes=[self._without(p, p.df.join(gone, "id", "left_anti")) if h else p for p, h in zip(self.graph.nodes, held)])
        self.graph = self.graph.but(edges=parts)

    def _without(self, part: Part, df: DataFrame) -> Part:
        """A part less what was deleted; after a few deletions it is written out."""
        if part.stacked >= STACKED:
            return replace(part, df=self.scratch.cut(df, "left"), stacked=0)
        return replace(part, df=df, stacked=part.stacked + 1)


def bound_names(q: ast.Query) -> dict[str, tuple]:
    """The labels or types that patterns ask of each variable; names that a WITH
    gives anew are left out."""
    out: dict[str, tuple] = {}
    for p in (q.match, q.merge, q.create):
        for x in (p.start, *[y for step in p.steps for y in step]) if p is not None else ():
            if x.var:
                out.setdefault(x.var, tuple(x.labels if isinstance(x, ast.NodePat) else x.types))
    again = {i.alias for w in q.withs for i in w.items if i.alias}
    return {k: v for k, v in out.items() if k not in again}

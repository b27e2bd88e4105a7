"""Typed column expressions: the binder of scalar expressions.

Every expression becomes a column and its type.  Types are checked here, so a
query that mixes types fails when it is bound, not on some row; what depends on
data (division by zero, list positions) fails through Spark's ANSI mode or
``raise_error``.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.lang import ast
from weftgraph.lang.errors import QueryError

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")


@dataclass(frozen=True)
class Val:
    """A bound expression.  Entities have ``name``, the prefix of their columns."""

    col: Column
    kind: object
    name: str | None = None
    props: dict | None = None  # property -> type, for entities


def is_list(k) -> bool:
    return isinstance(k, tuple) and k[0] == "list"


def is_map(k) -> bool:
    return isinstance(k, tuple) and k[0] in ("map", "dict")


def entity(k) -> bool:
    return k in ("node", "edge")


def type_name(k) -> str:
    return "list" if is_list(k) else "map" if is_map(k) else str(k)


def literal(value) -> Val:
    """A Python value (from a parameter) as a typed column."""
    if value is None:
        return Val(F.lit(None), "null")
    if isinstance(value, bool):
        return Val(F.lit(value), "bool")
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint"), "int")
    if isinstance(value, float):
        return Val(F.lit(value), "float")
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), "bytes")
    if isinstance(value, datetime.datetime):
        return Val(F.lit(value).cast("timestamp"), "datetime")
    if isinstance(value, (list, tuple)):
        return list_of([literal(v) for v in value])
    if isinstance(value, dict):
        return map_of([(k, literal(v)) for k, v in value.items()])
    return Val(F.lit(str(value)), "string")


def list_of(items: list[Val]) -> Val:
    kinds = {i.kind for i in items if i.kind != "null"}
    if len(kinds) > 1:
        raise QueryError("list_type_error", "the elements of a list must have one type")
    elem = next(iter(kinds), "null")
    if not items:
        return Val(F.expr("array()"), ("list", "null"))
    return Val(F.array(*[i.col for i in items]), ("list", elem))


def map_of(items: list[tuple[str, Val]]) -> Val:
    last = dict(items)
    if not last:
        return Val(F.create_map().cast("map<string,string>"), ("dict", "null"))
    return Val(F.struct(*[v.col.alias(k) for k, v in last.items()]), ("map", tuple((k, v.kind) for k, v in last.items())))


def null_if(cond: Column, c: Column) -> Column:
    return F.when(~cond, c)


# ---- the small pattern language of =~

def simple_regex(pattern: str) -> str:
    """The Java pattern of literals, ``^``, ``$`` and at most one group of choices."""
    out, i, groups, depth = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
            if i >= len(pattern):
                raise QueryError("regex_compile_error", "a pattern must not end in a backslash")
            out.append(re.escape(pattern[i]))
        elif ch == "^" and i == 0:
            out.append("^")
        elif ch == "$" and i == len(pattern) - 1:
            out.append("$")
        elif ch == "(":
            groups += 1
            depth += 1
            if groups > 1 or depth > 1:
                raise QueryError("regex_compile_error", "only one group is supported")
            out.append("(?:")
        elif ch == ")":
            depth -= 1
            if depth < 0:
                raise QueryError("regex_compile_error", "unbalanced group")
            out.append(")")
        elif ch == "|" and depth == 1:
            out.append("|")
        elif ch in "^$|*+?{}[].":
            raise QueryError("regex_compile_error", f"unsupported sign {ch!r}")
        else:
            out.append(re.escape(ch))
        i += 1
    if depth:
        raise QueryError("regex_compile_error", "unbalanced group")
    return "".join(out)


_SIGN = r"(?:\\.|[^\\^$|*+?{}\[\].()])"
_SIMPLE = rf"^\^?{_SIGN}*(?:\((?:{_SIGN}|\|)*\))?{_SIGN}*\$?$"


def computed_regex(pattern: Column) -> Column:
    """The Java pattern of patterns that only the rows know; a wrong one fails its row."""
    wrong = F.raise_error(F.concat(F.lit("regex_compile_error: "), pattern)).cast("string")
    literal = F.regexp_replace(pattern, r"\\([A-Za-z0-9])", "$1")
    return F.when(F.rlike(pattern, F.lit(_SIMPLE)), literal).when(pattern.isNotNull(), wrong)


class Binder:
    """Binds expressions against a scope of named values."""

    def __init__(self, params: dict | None = None):
        self.params = params or {}

    def bind(self, e, scope: dict[str, Val]) -> Val:
        return getattr(self, "_" + type(e).__name__.lower())(e, scope)

    def _lit(self, e: ast.Lit, scope) -> Val:
        return literal(e.value)

    def _param(self, e: ast.Param, scope) -> Val:
        return literal(self.params.get(e.name))

    def _var(self, e: ast.Var, scope) -> Val:
        if e.name not in scope:
            raise QueryError("unknown_variable", f"unknown variable {e.name}")
        return scope[e.name]

    def _prop(self, e: ast.Prop, scope) -> Val:
        base = self.bind(e.base, scope)
        return self.property(base, e.name)

    def property(self, base: Val, name: str) -> Val:
        if entity(base.kind):
            if base.name is not None and name in (base.props or {}):
                return Val(F.col(f"`{base.name}·{name}`"), base.props[name])
            return Val(F.lit(None), "null")
        if base.kind == "null":
            return Val(F.lit(None), "null")
        if is_map(base.kind):
            return self.key(base, name)
        raise QueryError("property_access_type_error", f"{type_name(base.kind)} has no properties")

    def key(self, base: Val, name: str) -> Val:
        if base.kind[0] == "dict":
            return Val(F.try_element_at(base.col, F.lit(name)), base.kind[1])
        kinds = dict(base.kind[1])
        return Val(base.col.getField(name), kinds[name]) if name in kinds else Val(F.lit(None), "null")

    def _index(self, e: ast.Index, scope) -> Val:
        base, i = self.bind(e.base, scope), self.bind(e.index, scope)
        if "null" in (base.kind, i.kind):
            return Val(F.lit(None), "null")
        if is_list(base.kind) and i.kind == "int":
            return Val(F.get(base.col, i.col.cast("int")), base.kind[1])
        if is_map(base.kind) and i.kind == "string":
            if base.kind[0] == "dict":
                return Val(F.try_element_at(base.col, i.col), base.kind[1])
            if isinstance(e.index, ast.Lit):
                return self.key(base, e.index.value)
            out, kinds = F.lit(None), {k for _, k in base.kind[1]}
            if len(kinds) != 1:
                raise QueryError("index_type_error", "a computed key needs values of one type")
            for k, _ in base.kind[1]:
                out = F.when(i.col == k, base.col.getField(k)).otherwise(out)
            return Val(out, kinds.pop())
        raise QueryError("index_type_error", f"cannot index {type_name(base.kind)} by {type_name(i.kind)}")

    def _listlit(self, e: ast.ListLit, scope) -> Val:
        return list_of([self.bind(x, scope) for x in e.items])

    def _maplit(self, e: ast.MapLit, scope) -> Val:
        return map_of([(k, self.bind(x, scope)) for k, x in e.items])

    def _unary(self, e: ast.Unary, scope) -> Val:
        x = self.bind(e.x, scope)
        if e.op == "NOT":
            if x.kind not in ("bool", "null"):
                raise QueryError("boolean_type_error", f"NOT needs a boolean, not {type_name(x.kind)}")
            return Val(~x.col.cast("boolean"), "bool")
        if x.kind not in ("int", "float", "null"):
            raise QueryError("unary_type_error", f"- needs a number, not {type_name(x.kind)}")
        return Val(-x.col if x.kind != "null" else x.col, x.kind)

    def _isnull(self, e: ast.IsNull, scope) -> Val:
        x = self.bind(e.x, scope)
        return Val(x.col.isNotNull() if e.negated else x.col.isNull(), "bool")

    def _binary(self, e: ast.Binary, scope) -> Val:
        a, b = self.bind(e.a, scope), self.bind(e.b, scope)
        op = e.op
        if op in ("AND", "OR"):
            for x in (a, b):
                if x.kind not in ("bool", "null"):
                    raise QueryError("boolean_type_error", f"{op} needs booleans, not {type_name(x.kind)}")
            l, r = a.col.cast("boolean"), b.col.cast("boolean")
            return Val(l & r if op == "AND" else l | r, "bool")
        if "null" in (a.kind, b.kind):
            return Val(F.lit(None).cast("boolean" if op not in "+-*/" else "bigint"), "bool" if op not in "+-*/" else "null")
        if op in ("=", "!="):
            return Val(self.equal(a, b, op == "!="), "bool")
        if op in ("<", "<=", ">", ">="):
            l, r = self.comparable(a, b)
            return Val({"<": l < r, "<=": l <= r, ">": l > r, ">=": l >= r}[op], "bool")
        if op in ("+", "-", "*", "/"):
            if a.kind != b.kind or a.kind not in ("int", "float"):
                raise QueryError("arithmetic_type_error", f"cannot compute {type_name(a.kind)} {op} {type_name(b.kind)}")
            if op == "/":
                return Val(F.call_function("div", a.col, b.col) if a.kind == "int" else a.col / b.col, a.kind)
            return Val({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], a.kind)
        if op == "IN":
            return Val(self.contains(b, a), "bool")
        if op == "CONTAINS":
            return Val(self.contains(a, b), "bool")
        if a.kind != "string" or b.kind != "string":
            raise QueryError("string_type_error", f"{op} needs strings")
        if op == "STARTS WITH":
            return Val(a.col.startswith(b.col), "bool")
        if op == "ENDS WITH":
            return Val(a.col.endswith(b.col), "bool")
        pattern = e.b.value if isinstance(e.b, ast.Lit) else self.params.get(e.b.name) if isinstance(e.b, ast.Param) else None
        if pattern is None:
            return Val(F.rlike(a.col, computed_regex(b.col)), "bool")
        return Val(a.col.rlike(simple_regex(pattern)), "bool")

    def equal(self, a: Val, b: Val, negated: bool) -> Column:
        both = a.col.isNotNull() & b.col.isNotNull()
        if a.kind != b.kind and not (is_list(a.kind) and is_list(b.kind) and "null" in (a.kind[1], b.kind[1])):
            return F.when(both, F.lit(negated))
        if entity(a.kind) or not is_list(a.kind) and not is_map(a.kind):
            return a.col != b.col if negated else a.col == b.col
        same = a.col.eqNullSafe(b.col)
        return F.when(both, ~same if negated else same)

    def comparable(self, a: Val, b: Val) -> tuple[Column, Column]:
        if is_list(a.kind) and is_list(b.kind):
            return F.size(a.col), F.size(b.col)
        if a.kind != b.kind or is_map(a.kind):
            raise QueryError("comparison_type_error", f"cannot compare {type_name(a.kind)} with {type_name(b.kind)}")
        return a.col, b.col

    def contains(self, whole: Val, part: Val) -> Column:
        """Membership in a list, a string or the keys of a map; null if either is null."""
        known = whole.col.isNotNull() & part.col.isNotNull()
        if is_list(whole.kind):
            if whole.kind[1] == "null" or whole.kind[1] != part.kind:
                return F.when(known, F.lit(False))
            return F.when(known, F.coalesce(F.array_contains(whole.col, part.col), F.lit(False)))
        if whole.kind == "string" and part.kind == "string":
            return whole.col.contains(part.col)
        if is_map(whole.kind) and part.kind == "string":
            keys = F.map_keys(whole.col) if whole.kind[0] == "dict" else F.array(*[F.lit(k) for k, _ in whole.kind[1]])
            return F.when(known, F.array_contains(keys, part.col))
        raise QueryError("in_type_error", f"{type_name(part.kind)} cannot be in {type_name(whole.kind)}")

    # ---- functions

    def _call(self, e: ast.Call, scope) -> Val:
        if e.name in AGGREGATES:
            raise QueryError("function_error", f"{e.name}() is an aggregate and must be a whole item")
        fn = getattr(self, "fn_" + e.name, None)
        if fn is None or e.star:
            raise QueryError("function_error", f"unknown function {e.name}")
        args = [self.bind(x, scope) for x in e.args]
        try:
            return fn(*args, **({"texts": e.args} if e.name in ("has_prop",) else {}))
        except TypeError as err:
            raise QueryError("function_error", f"wrong arguments for {e.name}()") from err

    @staticmethod
    def _list_arg(name: str, x: Val) -> None:
        if x.kind != "null" and not is_list(x.kind):
            raise QueryError("function_error", f"{name}() needs a list, not {type_name(x.kind)}")

    @staticmethod
    def _spark_type(kind) -> str:
        names = {"int": "bigint", "float": "double", "bool": "boolean", "bytes": "binary", "datetime": "timestamp", "null": "void"}
        return f"array<{Binder._spark_type(kind[1])}>" if is_list(kind) else names.get(kind, "string")

    def fn_append(self, l: Val, v: Val) -> Val:
        self._list_arg("append", l)
        kind = v.kind if l.kind == "null" or l.kind[1] == "null" else l.kind[1]
        t = self._spark_type(("list", kind))
        base = F.coalesce(l.col.cast(t), F.expr(f"cast(array() as {t})"))
        return Val(F.array_append(base, v.col.cast(self._spark_type(kind))), ("list", kind))

    def fn_insert(self, l: Val, i: Val, v: Val) -> Val:
        self._list_arg("insert", l)
        kind = v.kind if l.kind == "null" or l.kind[1] == "null" else l.kind[1]
        t = self._spark_type(("list", kind))
        base = F.coalesce(l.col.cast(t), F.expr(f"cast(array() as {t})"))
        fits = (i.col >= 0) & (i.col <= F.size(base))
        put = F.concat(F.slice(base, F.lit(1), i.col.cast("int")), F.array(v.col.cast(self._spark_type(kind))), F.slice(base, i.col.cast("int") + 1, F.greatest(F.size(base) - i.col.cast("int"), F.lit(0))))
        return Val(F.when(fits, put).otherwise(F.raise_error(F.lit("index_type_error")).cast(t)), ("list", kind))

    def fn_remove(self, l: Val, v: Val) -> Val:
        self._list_arg("remove", l)
        if l.kind == "null":
            return Val(F.lit(None), "null")
        return Val(F.filter(l.col, lambda x: ~x.eqNullSafe(v.col)), l.kind)

    def fn_merge(self, a: Val, b: Val) -> Val:
        if a.kind == "null":
            return b
        if b.kind == "null":
            return a
        if not (is_map(a.kind) and is_map(b.kind) and a.kind[0] == b.kind[0] == "map"):
            raise QueryError("function_error", "merge() needs two maps")
        ka, kb = dict(a.kind[1]), dict(b.kind[1])
        return map_of([(k, self.key(b if k in kb else a, k)) for k in [*ka, *[k for k in kb if k not in ka]]])

    def fn_size(self, x: Val) -> Val:
        if x.kind in ("string", "bytes"):
            return Val(F.octet_length(x.col).cast("bigint"), "int")
        if is_list(x.kind) or is_map(x.kind) and x.kind[0] == "dict":
            return Val(F.when(x.col.isNotNull(), F.size(x.col)).cast("bigint"), "int")
        if is_map(x.kind):
            return Val(F.when(x.col.isNotNull(), F.lit(len(x.kind[1]))).cast("bigint"), "int")
        if x.kind == "null":
            return Val(F.lit(None).cast("bigint"), "int")
        raise QueryError("function_error", f"size() does not take {type_name(x.kind)}")

    def fn_type(self, x: Val) -> Val:
        return Val(F.when(x.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(x.kind))), "string")

    def fn_id(self, x: Val) -> Val:
        if not entity(x.kind):
            raise QueryError("function_error", "id() needs a node or an edge")
        return Val(x.col, "int")

    def fn_edge_type(self, x: Val) -> Val:
        if x.kind == "null":
            return Val(F.lit(None), "null")
        if x.kind != "edge":
            raise QueryError("function_error", "edge_type() needs an edge")
        return Val(F.col(f"`{x.name}·type`"), "string")

    def fn_labels(self, x: Val) -> Val:
        if x.kind != "node":
            raise QueryError("function_error", "labels() needs a node")
        return Val(F.array_sort(F.col(f"`{x.name}·labels`")), ("list", "string"))

    def fn_has_prop(self, x: Val, k: Val, texts=()) -> Val:
        if not entity(x.kind):
            return Val(F.lit(False), "bool")
        if not isinstance(texts[1], (ast.Lit, ast.Param)):
            raise QueryError("function_error", "has_prop() needs a literal name")
        name = texts[1].value if isinstance(texts[1], ast.Lit) else self.params.get(texts[1].name)
        v = self.property(x, name)
        # a column that is null holds no property: stored nulls are not told apart
        return Val(v.col.isNotNull(), "bool")

    def fn_has_label(self, x: Val, l: Val) -> Val:
        if x.kind != "node":
            return Val(F.lit(False), "bool")
        return Val(F.coalesce(F.array_contains(F.col(f"`{x.name}·labels`"), l.col), F.lit(False)), "bool")

    def fn_keys(self, m: Val) -> Val:
        if not is_map(m.kind):
            raise QueryError("function_error", "keys() needs a map")
        c = F.map_keys(m.col) if m.kind[0] == "dict" else F.when(m.col.isNotNull(), F.array(*[F.lit(k) for k, _ in m.kind[1]]))
        return Val(c, ("list", "string"))

    def fn_values(self, m: Val) -> Val:
        if not is_map(m.kind):
            raise QueryError("function_error", "values() needs a map")
        if m.kind[0] == "dict":
            return Val(F.map_values(m.col), ("list", m.kind[1]))
        return list_of([self.key(m, k) for k, _ in m.kind[1]])

    def fn_contains(self, l: Val, v: Val) -> Val:
        self._list_arg("contains", l)
        if "null" in (l.kind, v.kind):
            return Val(F.lit(None).cast("boolean"), "bool")
        return Val(self.contains(l, v), "bool")

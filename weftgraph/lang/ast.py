"""Syntax tree of scripts, queries and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any
    kind: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    base: Any
    name: str


@dataclass(frozen=True)
class Index:
    base: Any
    index: Any


@dataclass(frozen=True)
class ListLit:
    items: tuple


@dataclass(frozen=True)
class MapLit:
    items: tuple  # (key, expression)


@dataclass(frozen=True)
class Unary:
    op: str
    x: Any


@dataclass(frozen=True)
class Binary:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class IsNull:
    x: Any
    negated: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: tuple = ()
    props: tuple = ()


@dataclass(frozen=True)
class EdgePat:
    var: str | None
    types: tuple = ()
    props: tuple = ()
    direction: str = "out"  # out, in, both
    hops: tuple | None = None  # (min, max)


@dataclass(frozen=True)
class Pattern:
    path: str | None
    start: NodePat
    steps: tuple  # (EdgePat, NodePat)


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Sort:
    expr: Any
    descending: bool = False


@dataclass
class With:
    star: bool
    items: list
    where: Any = None
    order: list = field(default_factory=list)
    limit: int | None = None


@dataclass
class Query:
    match: Pattern | None = None
    where: Any = None
    withs: list = field(default_factory=list)
    merge: Pattern | None = None
    create: Pattern | None = None
    sets: list = field(default_factory=list)  # (kind, variable, property, index, expression)
    removes: list = field(default_factory=list)  # (kind, variable, name)
    deletes: list = field(default_factory=list)
    returns: list = field(default_factory=list)
    return_all: bool = False
    order: list = field(default_factory=list)
    limit: int | None = None

    @property
    def mutates(self) -> bool:
        return bool(self.merge or self.create or self.sets or self.removes or self.deletes)

    @property
    def empty(self) -> bool:
        return not (self.match or self.withs or self.mutates or self.returns or self.return_all)


@dataclass(frozen=True)
class Target:
    kind: str  # label, edge_type
    name: str

    @property
    def ddl(self) -> str:
        return f":{self.name}" if self.kind == "label" else f"[:{self.name}]"


@dataclass(frozen=True)
class Command:
    """Any statement that is not a query: its verb and arguments."""

    verb: str
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Explain:
    statement: Any

"""A property graph as DataFrames: node parts, edge parts and a schema catalog.

A node part is a table of nodes that carry the same labels, or a table with a
``labels`` column; an edge part is a table of edges of one type.  Scans pick
the parts that a label or type names, so Catalyst prunes the rest, and pushes
filters and columns into what is read.  All of it is immutable: a change gives
a new graph that shares the parts it did not touch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.lang.ast import Target
from weftgraph.lang.errors import QueryError


def kind_of(t: T.DataType):
    """The language's type of a Spark type."""
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.ArrayType):
        return ("list", kind_of(t.elementType))
    if isinstance(t, T.StructType):
        return ("map", tuple((f.name, kind_of(f.dataType)) for f in t.fields))
    if isinstance(t, T.MapType):
        return ("dict", kind_of(t.valueType))
    if isinstance(t, T.NullType):
        return "null"
    return "string"


def normal(c: Column, t: T.DataType) -> Column:
    """Integers as BIGINT, fractions as DOUBLE, times without zone."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("bigint")
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return c.cast("double")
    if isinstance(t, (T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return c


@dataclass(frozen=True)
class Part:
    """``df``: id, then (nodes) optional ``labels`` or (edges) src, dst, then properties."""

    df: DataFrame
    labels: tuple[str, ...] | None = None  # nodes: static labels; None: a labels column
    type: str | None = None  # edges
    stacked: int = 0  # deletions that are not written out yet

    @property
    def props(self) -> list[str]:
        fixed = ("id", "labels") if self.type is None else ("id", "src", "dst")
        return [c for c in self.df.columns if c not in fixed]

    def has(self, name: str) -> bool:
        return name in self.props


@dataclass(frozen=True)
class IndexDef:
    name: str
    target: Target
    prop: str
    kind: str = "EQ"
    unique: bool = False
    status: str = "ready"
    owner: str | None = None

    @property
    def ddl(self) -> str:
        return f"CREATE INDEX {self.name} ON {self.target.ddl}({self.prop}) KIND {self.kind}"


@dataclass(frozen=True)
class ConstraintDef:
    name: str
    target: Target
    spec: tuple

    @property
    def prop(self) -> str:
        return self.spec[1] if self.spec[0] in ("UNIQUE", "REQUIRED", "TYPE") else ""

    @property
    def type(self) -> str:
        return {"MAX OUTGOING": "max_outgoing"}.get(self.spec[0], self.spec[0].lower())

    @property
    def details(self) -> str:
        if self.spec[0] == "TYPE":
            return self.spec[2]
        if self.spec[0] == "ENDPOINTS":
            return f":{self.spec[1]} -> :{self.spec[2]}"
        return str(self.spec[1]) if self.spec[0] == "MAX OUTGOING" else ""

    @property
    def ddl(self) -> str:
        what = {"ENDPOINTS": f"ENDPOINTS {self.details}", "MAX OUTGOING": f"MAX OUTGOING {self.details}", "TYPE": f"{self.prop} TYPE {self.details}"}
        return f"CREATE CONSTRAINT {self.name} ON {self.target.ddl} REQUIRE {what.get(self.spec[0], f'{self.prop} {self.spec[0]}')}"


def made_name(prefix: str, target: Target, prop: str, suffix: str | None = None) -> str:
    parts = [prefix, target.kind, target.name, prop, *([suffix] if suffix else [])]
    return "_".join(re.sub(r"[^A-Za-z0-9]", "_", p) if k > 1 else p for k, p in enumerate(parts))


@dataclass(frozen=True)
class Catalog:
    labels: frozenset = frozenset()
    edge_types: frozenset = frozenset()
    descriptions: dict = field(default_factory=dict)
    indexes: dict = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)

    def index_for(self, label: str, prop: str, kind: str) -> IndexDef | None:
        found = [i for i in self.indexes.values() if i.target == Target("label", label) and i.prop == prop and i.kind == kind and i.status == "ready"]
        return found[0] if found else None

    def add(self, target: Target) -> "Catalog":
        if target.kind == "label":
            return replace(self, labels=self.labels | {target.name})
        return replace(self, edge_types=self.edge_types | {target.name})

    def holds(self, target: Target) -> bool:
        return target.name in (self.labels if target.kind == "label" else self.edge_types)


class Graph:
    """An immutable property graph."""

    def __init__(self, spark: SparkSession, nodes: list[Part] = (), edges: list[Part] = (), catalog: Catalog | None = None, next_node: int = 1, next_edge: int = 1, tx: int = 0):
        self.spark, self.nodes, self.edges = spark, list(nodes), list(edges)
        catalog = catalog or Catalog()
        for p in self.nodes:
            for name in p.labels or ():
                catalog = catalog.add(Target("label", name))
        for p in self.edges:
            catalog = catalog.add(Target("edge_type", p.type))
        self.catalog, self.next_node, self.next_edge, self.tx = catalog, next_node, next_edge, tx

    def but(self, **kw) -> "Graph":
        have = dict(nodes=self.nodes, edges=self.edges, catalog=self.catalog, next_node=self.next_node, next_edge=self.next_edge, tx=self.tx)
        return Graph(self.spark, **(have | kw))

    # ---- building

    def with_nodes(self, label: str | tuple, df: DataFrame, key: str | None = None) -> "Graph":
        labels = (label,) if isinstance(label, str) else tuple(sorted(label))
        id_col = F.col(key or "id").cast("bigint").alias("id")
        props = [normal(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name != "id"]
        return self.but(nodes=[*self.nodes, Part(df.select(id_col, *props), labels)])

    def with_edges(self, kind: str, df: DataFrame) -> "Graph":
        fixed = [F.col(c).cast("bigint").alias(c) for c in ("id", "src", "dst")]
        props = [normal(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in ("id", "src", "dst")]
        return self.but(edges=[*self.edges, Part(df.select(*fixed, *props), type=kind)])

    def overlay(self, other: "Graph") -> "Graph":
        """This graph and another, for one query; neither changes."""
        c = self.catalog
        c = replace(c, labels=c.labels | other.catalog.labels, edge_types=c.edge_types | other.catalog.edge_types)
        return self.but(nodes=[*self.nodes, *other.nodes], edges=[*self.edges, *other.edges], catalog=c)

    # ---- scans

    def node_parts(self, labels: tuple) -> list[Part]:
        """Parts that may hold nodes with all ``labels``, filtered to them."""
        out = []
        for p in self.nodes:
            if p.labels is not None:
                if all(x in p.labels for x in labels):
                    out.append(p)
                continue
            df = p.df
            for x in labels:
                df = df.where(F.array_contains("labels", x))
            out.append(replace(p, df=df))
        return out

    def edge_parts(self, types: tuple) -> list[Part]:
        return [p for p in self.edges if not types or p.type in types]

    def prop_type(self, parts: list[Part], name: str) -> T.DataType | None:
        found = {p.df.schema[name].dataType.simpleString(): p.df.schema[name].dataType for p in parts if p.has(name)}
        real = {k: v for k, v in found.items() if k != "void"}
        if len(real) > 1:
            raise QueryError("property_type_conflict", f"{name} holds values of several types: {', '.join(sorted(real))}")
        return next(iter(real.values()), T.NullType() if found else None)

    def scan_nodes(self, labels: tuple, props: list[str], prefix: str) -> tuple[DataFrame, dict[str, object]]:
        """Nodes as ``prefix``, ``prefix·labels`` and ``prefix·property`` columns."""
        parts = self.node_parts(labels)
        kinds = {p: self.prop_type(parts, p) for p in props}
        kinds = {p: t for p, t in kinds.items() if t is not None}
        frames = []
        for part in parts:
            own = F.col("labels") if part.labels is None else F.array(*[F.lit(x) for x in part.labels]).cast("array<string>")
            cols = [F.col("id").alias(prefix), own.alias(f"{prefix}·labels")]
            cols += [(F.col(f"`{p}`") if part.has(p) else F.lit(None)).cast(t).alias(f"{prefix}·{p}") for p, t in kinds.items()]
            frames.append(part.df.select(*cols))
        empty = T.StructType([T.StructField(prefix, T.LongType()), T.StructField(f"{prefix}·labels", T.ArrayType(T.StringType())), *[T.StructField(f"{prefix}·{p}", t) for p, t in kinds.items()]])
        return _union(self.spark, frames, empty), {p: kind_of(t) for p, t in kinds.items()}

    def scan_edges(self, types: tuple, props: list[str], prefix: str) -> tuple[DataFrame, dict[str, object]]:
        """Edges as ``prefix``, ``prefix·src``, ``prefix·dst``, ``prefix·type`` and properties."""
        parts = self.edge_parts(types)
        kinds = {p: self.prop_type(parts, p) for p in props}
        kinds = {p: t for p, t in kinds.items() if t is not None}
        frames = []
        for part in parts:
            cols = [F.col("id").alias(prefix), F.col("src").alias(f"{prefix}·src"), F.col("dst").alias(f"{prefix}·dst"), F.lit(part.type).alias(f"{prefix}·type")]
            cols += [(F.col(f"`{p}`") if part.has(p) else F.lit(None)).cast(t).alias(f"{prefix}·{p}") for p, t in kinds.items()]
            frames.append(part.df.select(*cols))
        long, text = T.LongType(), T.StringType()
        empty = T.StructType([T.StructField(prefix, long), T.StructField(f"{prefix}·src", long), T.StructField(f"{prefix}·dst", long), T.StructField(f"{prefix}·type", text), *[T.StructField(f"{prefix}·{p}", t) for p, t in kinds.items()]])
        return _union(self.spark, frames, empty), {p: kind_of(t) for p, t in kinds.items()}

    def all_nodes(self) -> DataFrame:
        """``id, labels`` of every node."""
        df, _ = self.scan_nodes((), [], "id")
        return df.withColumnRenamed("id·labels", "labels")

    def all_edges(self) -> DataFrame:
        """``id, src, dst, type`` of every edge."""
        df, _ = self.scan_edges((), [], "id")
        return df.select("id", F.col("id·src").alias("src"), F.col("id·dst").alias("dst"), F.col("id·type").alias("type"))

    def stats(self) -> dict[str, int]:
        c = self.catalog
        return {
            "node_count": self.all_nodes().count(), "edge_count": self.all_edges().count(), "label_count": len(c.labels), "edge_type_count": len(c.edge_types),
            "index_count": len(c.indexes), "constraint_count": len(c.constraints), "last_tx_id": self.tx, "wal_bytes": 0,
        }


def _union(spark: SparkSession, frames: list[DataFrame], schema: T.StructType) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], schema)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out



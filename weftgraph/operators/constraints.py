"""Checks of schema constraints, as queries for violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lang.errors import QueryError
from weftgraph.sources.graph import ConstraintDef, Graph


def violations(g: Graph, c: ConstraintDef) -> DataFrame | None:
    """Rows that break a constraint; None where the types alone decide.

    UNIQUE gives values held more than once (nulls may repeat), REQUIRED ids
    without a value, ENDPOINTS edges with a wrong end, MAX OUTGOING nodes with
    too many edges.
    """
    kind = c.spec[0]
    if kind in ("ENDPOINTS", "MAX OUTGOING"):
        edges, _ = g.scan_edges((c.target.name,), [], "e")
        edges = edges.select(F.col("e").alias("id"), F.col("e·src").alias("src"), F.col("e·dst").alias("dst"))
        if kind == "MAX OUTGOING":
            return edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > c.spec[1])
        good_a, _ = g.scan_nodes((c.spec[1],), [], "src")
        good_b, _ = g.scan_nodes((c.spec[2],), [], "dst")
        bad = edges.join(good_a.select("src"), "src", "left_anti").select("id", "src", "dst")
        return bad.union(edges.join(good_b.select("dst"), "dst", "left_anti").select("id", "src", "dst")).distinct()
    prop = c.prop
    if c.target.kind == "label":
        df, kinds = g.scan_nodes((c.target.name,), [prop], "x")
    else:
        df, kinds = g.scan_edges((c.target.name,), [prop], "x")
    value = F.col(f"`x·{prop}`") if prop in kinds else F.lit(None)
    rows = df.select(F.col("x").alias("id"), value.alias("value"))
    if kind == "REQUIRED":
        return rows.where("value IS NULL")
    if kind == "UNIQUE":
        return rows.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    have = kinds.get(prop)
    have = have[0] if isinstance(have, tuple) else have
    have = {"dict": "map"}.get(have, have)
    return rows.where("value IS NOT NULL") if have is not None and have != "null" and have != c.spec[2] else None


CODES = {"REQUIRED": "constraint_required_violation", "UNIQUE": "constraint_unique_violation", "TYPE": "constraint_type_violation", "ENDPOINTS": "constraint_endpoint_violation", "MAX OUTGOING": "constraint_cardinality_violation"}


def validate(g: Graph, only: list[ConstraintDef] | None = None) -> None:
    """Raise for the first broken constraint, and for repeated edges."""
    for c in only if only is not None else g.catalog.constraints.values():
        bad = violations(g, c)
        if bad is not None and not bad.isEmpty():
            raise QueryError(CODES[c.spec[0]], f"constraint {c.name} is violated")


def duplicate_edges(g: Graph) -> DataFrame:
    """(src, type, dst) with more than one edge."""
    return g.all_edges().groupBy("src", "type", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")



"""Graphs over the parquet tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.lang.ast import Target
from weftgraph.session import Scratch
from weftgraph.sources.graph import Graph, IndexDef, made_name
from weftgraph.sources.tables import current_documents, live_edges, table, tidy

#: Node ids are ordinal x 2^40 + key, edge ids likewise by type.
LABELS = ("Region", "Nation", "Customer", "Supplier", "Order", "Part", "User", "Event", "LineItem")
SHIFT = 1 << 40


def node_id(label: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return (F.lit(LABELS.index(label)) * F.lit(SHIFT) + key.cast("bigint")).cast("bigint")


def star_graph(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, customers, suppliers, orders, parts and events."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "orders", "part", "events")}
    g = Graph(spark)
    for label, name, key in (
        ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"),
        ("Order", "orders", "o_orderkey"), ("Part", "part", "p_partkey"), ("Event", "events", "event_id"),
    ):
        g = g.with_nodes(label, t[name].withColumn("id", node_id(label, key)))
    users = t["events"].select("user_id").distinct().withColumn("id", node_id("User", "user_id"))
    g = g.with_nodes("User", users)

    def edges(df: DataFrame, key: Column | str, kind: int, src: Column, dst: Column, *props: Column) -> DataFrame:
        key = F.col(key) if isinstance(key, str) else key
        return df.select((F.lit(kind) * F.lit(SHIFT) + key.cast("bigint")).alias("id"), src.alias("src"), dst.alias("dst"), *props)

    g = g.with_edges("IN_REGION", edges(t["nation"], "n_nationkey", 1, node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey")))
    lives = edges(t["customer"], "c_custkey", 2, node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey"), F.col("c_acctbal").alias("weight"))
    sits = edges(t["supplier"], "s_suppkey", 3, node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey"), F.col("s_acctbal").alias("weight"))
    g = g.with_edges("IN_NATION", lives.unionByName(sits))
    g = g.with_edges("PLACED", edges(t["orders"], "o_orderkey", 4, node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey"), F.col("o_orderpriority").alias("priority")))
    g = g.with_edges("DID", edges(t["events"], "event_id", 5, node_id("User", "user_id"), node_id("Event", "event_id")))
    indexes = {}
    for label, prop, kind in (("Customer", "c_custkey", "EQ"), ("Customer", "c_acctbal", "RANGE"), ("Part", "p_name", "FULLTEXT")):
        t_ = Target("label", label)
        i = IndexDef(made_name("idx", t_, prop), t_, prop, kind)
        indexes[i.name] = i
    return g.but(catalog=replace(g.catalog, indexes=indexes), next_node=len(LABELS) * SHIFT, next_edge=16 * SHIFT)


#: Types of the edges of a vault.
VAULT_TYPES = ("MD_LINKS_TO", "MD_UP", "MD_RELATED", "MD_NEXT", "MD_PREVIOUS", "MD_IN_DIRECTORY", "MD_PARENT_DIRECTORY")


def vault_graph(spark: SparkSession, d: str, types: tuple = VAULT_TYPES) -> Graph:
    """Documents and directories of the vaults with their live edges of some types.

    Several types are deduplicated in one pass and written by type, so that
    whatever walks them again reads only the files of its types.
    """
    cols = ["root", "path", "ext", "source_hash", "status", "body", "raw", "title", "tags", "aliases", "links", "headings", "has_frontmatter"]
    docs = current_documents(table(spark, d, "md_documents"), cols)
    dirs = table(spark, d, "md_directories").select("id", "root", "path", "status")
    g = Graph(spark).with_nodes("MarkdownDocument", docs).with_nodes("MarkdownDirectory", dirs)
    if types:
        rows = table(spark, d, "graph_edges").where(tidy("edge_type").isin([t.lower() for t in types]))
        edges = live_edges(rows, ["src", "dst", "edge_weight", "link_target"])
        if len(types) > 1:
            edges = Scratch(spark, "vault").write(edges, "edges", by=["etype"]).df
        for kind in types:
            g = g.with_edges(kind, edges.where(F.col("etype") == kind.lower()).drop("etype"))
    catalog = g.catalog
    for kind in VAULT_TYPES:
        catalog = catalog.add(Target("edge_type", kind))
    return g.but(catalog=catalog, next_node=1 << 50, next_edge=1 << 50)

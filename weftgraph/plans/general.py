"""Queries p2, p3 and p6: hierarchies, missing records, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.paths import is_path_target, normal_path, path_key, target_key
from weftgraph.operators.hierarchy import descendants, parent_links, resolve
from weftgraph.operators.orphans import SHARED, OrphanState
from weftgraph.operators.snapshots import changes
from weftgraph.session import Scratch
from weftgraph.sources.tables import live_edges, table, tidy

FORESTS = {"directory": ["md_in_directory", "md_parent_directory"], "up": ["md_up"]}


def _forests(spark: SparkSession, d: str):
    edges = live_edges(table(spark, d, "graph_edges"), ["src", "dst", "valid_from"])
    edges = edges.where(F.col("etype").isin([t for ts in FORESTS.values() for t in ts]))
    edges = Scratch(spark, "forest").cut(edges.where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    for name, types in FORESTS.items():
        own = edges.where(F.col("etype").isin(types))
        links = parent_links(own, [], "src", "dst", ["valid_from", "id"])
        yield name, links, own.select(F.col("src").alias("node")).union(own.select("dst"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, links, ends in _forests(spark, d):
        r = resolve(links, ends)
        parts.append(r.select(F.lit(name).alias("forest"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), "on_cycle"))
    return _union(parts)


def _with_paths(spark: SparkSession, d: str):
    for name, links, ends in _forests(spark, d):
        lost = resolve(links, ends).where("depth < 0").select("node")
        lost = Scratch(spark, "lost").cut(lost, "lost")
        yield name, resolve(links.join(lost, "node", "left_anti"), ends.join(lost, "node", "left_anti"), with_path=True)


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of ids from the root, for every node that has a root."""
    return _union([r.select(F.lit(n).alias("forest"), F.col("node").alias("node_id"), F.concat_ws("/", "path").alias("id_path"), F.col("depth").alias("node_depth")) for n, r in _with_paths(spark, d)])


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its descendants and their distance."""
    return _union([descendants(r).select(F.lit(n).alias("forest"), F.col("ancestor").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance") for n, r in _with_paths(spark, d)])


def _vault_loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parents and references of the vault tables with their load month; keyed once."""
    docs, dirs = table(spark, d, "md_documents"), table(spark, d, "md_directories")
    refs, edges = table(spark, d, "md_link_refs"), table(spark, d, "graph_edges")
    none, zero, period = F.lit(None).cast("timestamp"), F.lit(0).cast("bigint"), F.date_format("loaded_at", "yyyy-MM").alias("period")

    def keys(rows: DataFrame, root: str, target: str, path: str) -> DataFrame:
        key = F.when(is_path_target(F.col(target)), target_key(F.col(target), F.col(path)))
        rows = rows.withColumn("__key", key)
        return rows.withColumn("key", F.concat(F.col(root), F.lit("\n"), "__key")).withColumn("shared", F.concat(F.lit(SHARED), "__key"))

    link_refs = keys(refs, "root", "raw_target", "src_path").select(F.lit("md_link_refs").alias("ref_table"), F.col("ref_id").alias("row_key"), zero.alias("pos"), none.alias("version"), "key", "shared", F.col("seen_at").alias("ref_time"), period)
    own = docs.select("id", "root", "path", "synced_at", "loaded_at", F.posexplode_outer("links").alias("pos", "target"))
    own_refs = keys(own, "root", "target", "path").select(F.lit("md_documents").alias("ref_table"), F.col("id").alias("row_key"), F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), F.coalesce("synced_at", F.lit("0001-01-01").cast("timestamp")).alias("version"), "key", "shared", F.col("synced_at").alias("ref_time"), period)
    live = edges.where((tidy("status") == "current") & F.col("valid_to").isNull())
    edge_refs = live.select(F.lit("graph_edges").alias("ref_table"), F.col("id").alias("row_key"), zero.alias("pos"), none.alias("version"), F.concat(F.lit("#\n"), F.col("dst").cast("string")).alias("key"), F.lit(None).cast("string").alias("shared"), F.col("valid_from").alias("ref_time"), period)

    gone = F.coalesce(tidy("status") == "missing", F.lit(False)).alias("deleted")
    by_path = F.concat(F.col("root"), F.lit("\n"), path_key(normal_path(F.col("path"))))
    by_id = F.concat(F.lit("#\n"), F.col("id").cast("string"))
    both = F.explode(F.array(F.struct(F.lit("p").alias("w"), "by_path"), F.struct(F.lit("d").alias("w"), F.col("by_id").alias("by_path"))))
    doc_rows = docs.select("id", by_path.alias("by_path"), by_id.alias("by_id"), gone, "valid_from", F.col("synced_at").alias("version"), period)
    doc_rows = doc_rows.withColumn("k", both).select(F.concat("k.w", F.col("id").cast("string")).alias("parent_id"), F.col("k.by_path").alias("key"), "deleted", "valid_from", "version", "period")
    no_period = F.lit(None).cast("string").alias("period")
    dir_rows = dirs.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("parent_id"), by_id.alias("key"), gone, "valid_from", none.alias("version"), no_period)
    # a page stands at the same path in every vault and always did
    pages = table(spark, d, "canon_pages").select(F.concat(F.lit("c"), F.col("canon_id").cast("string")).alias("parent_id"), F.concat(F.lit(SHARED), path_key(normal_path(F.col("path")))).alias("key"), F.lit(False).alias("deleted"), none.alias("valid_from"), none.alias("version"), no_period)
    return doc_rows.unionByName(dir_rows).unionByName(pages), link_refs.unionByName(own_refs).unionByName(edge_refs)


def orphan_state(spark: SparkSession, d: str) -> OrphanState:
    """The state after all load months of the vault tables."""
    return OrphanState(spark).apply(*_vault_loads(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_state(spark, d).orphans()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_state(spark, d).counts()


def p3_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The counts at the end of each load month, so also of orphans resolved later."""
    return orphan_state(spark, d).snapshots()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "context_nodes").select("snapshot_no", "loaded_at", "root", normal_path(F.col("path")).alias("path"), tidy("source_hash").alias("source_hash"), tidy("src_status").alias("src_status"))
    out = changes(rows, "root", "path", "snapshot_no", ["loaded_at"], ["source_hash", "src_status"])
    return out.select("snapshot_no", "root", "path", "change_kind")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_counts, p3_snapshots, p6_found)}

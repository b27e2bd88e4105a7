"""Integrity and freshness checks of document graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import Scratch
from weftgraph.sources.graph import Catalog, Graph
from weftgraph.sources.tables import tidy

#: Fields that tell where a document comes from; every document must have them (fixed values).
REQUIRED = ("root", "path", "source_hash", "status")
DIRECTORY_TYPES = ("md_in_directory", "md_parent_directory")


def current(docs: DataFrame) -> DataFrame:
    return docs.where(tidy("status") == "current")


def orphan_documents(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Current documents that no link or other edge touches; directory edges do not count."""
    links = edges.where(~F.lower("etype").isin(*DIRECTORY_TYPES))
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    return current(docs).join(ends, "id", "left_anti")


def ambiguous_aliases(docs: DataFrame) -> DataFrame:
    """Aliases that several current paths of a root hold."""
    pairs = current(docs).select("root", "path", F.explode("aliases").alias("alias")).where("trim(alias) <> ''").distinct()
    return pairs.groupBy("root", "alias").agg(F.count(F.lit(1)).alias("n_paths")).where("n_paths > 1")


def missing_metadata(docs: DataFrame) -> DataFrame:
    """Documents that lack a required field, with the names of what fails."""
    fails = F.array_compact(F.array(*[F.when(_blank(c), F.lit(c)) for c in REQUIRED]))
    return docs.withColumn("missing", fails).where(F.size("missing") > 0)


def duplicate_paths(docs: DataFrame) -> DataFrame:
    return current(docs).groupBy("root", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_links(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "etype", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def stale_documents(docs: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """``id, path, kind`` of documents that no longer agree with the files.

    ``files``: root, path, hash as they are now.  Kinds: metadata_incomplete
    (nothing else is looked at then), root_mismatch, tombstoned_document,
    missing_file, hash_mismatch.
    """
    return _with_kinds(docs, files, root).select("id", "path", F.explode("kinds").alias("kind"))


def _with_kinds(docs: DataFrame, files: DataFrame, root: str | None) -> DataFrame:
    f = files.select("root", "path", F.col("hash").alias("__hash"), F.lit(True).alias("__there"))
    j = docs.join(f, ["root", "path"], "left")
    gone, there = F.coalesce(tidy("status") == "missing", F.lit(False)), F.col("__there").isNotNull()
    seen = F.array_compact(F.array(
        F.when(F.lit(root).isNotNull() & (F.col("root") != F.lit(root)), F.lit("root_mismatch")),
        F.when(gone, F.lit("tombstoned_document")),
        F.when((tidy("status") == "current") & ~there, F.lit("missing_file")),
        F.when(~gone & there & ~F.col("source_hash").eqNullSafe(F.col("__hash")), F.lit("hash_mismatch")),
    ))
    incomplete = _blank("root") | _blank("path") | _blank("source_hash") | _blank("status")
    return j.withColumn("kinds", F.when(incomplete, F.array(F.lit("metadata_incomplete"))).otherwise(seen)).drop("__hash", "__there")


REPORT = "check string, status string, value string"


def report(docs: DataFrame, edges: DataFrame, files: DataFrame, catalog: Catalog | None = None, store: dict | None = None, strict: bool = False) -> DataFrame:
    """Thirteen checks of a document graph as ``check, status, value``.

    One aggregate per table: documents (with the files and the ends of links
    beside them), paths, aliases and links; the catalog and the state of the
    store (from its integrity check) come from the driver.  With ``strict``
    what would warn fails.
    """
    links = edges.where(~F.lower("etype").isin(*DIRECTORY_TYPES))
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().withColumn("__linked", F.lit(1))
    has = lambda *kinds: F.size(F.filter("kinds", lambda k: k.isin(*kinds)))
    lacks = _blank(REQUIRED[0])
    for c in REQUIRED[1:]:
        lacks = lacks | _blank(c)
    current_row = tidy("status") == "current"
    number = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    narrow = docs.select("id", "root", "path", "source_hash", "status")
    one = _with_kinds(narrow, files, None).join(ends, "id", "left").agg(
        F.coalesce(F.sum(has("missing_file", "tombstoned_document")), F.lit(0)).alias("missing_tombstoned_markdown_documents"),
        F.coalesce(F.sum(has("hash_mismatch")), F.lit(0)).alias("stale_current_markdown_documents"),
        number(lacks).alias("markdown_documents_missing_source_metadata"),
        F.coalesce(F.sum(F.size("kinds")), F.lit(0)).alias("stale_items"),
        number(current_row & F.col("__linked").isNull()).alias("orphan_items"),
    )
    paths = duplicate_paths(docs).agg(F.count(F.lit(1)).alias("duplicate_current_markdown_document_paths"))
    twice = edges.where("etype = 'md_links_to'").groupBy("src", "dst").agg((F.count(F.lit(1)) - 1).alias("n"))
    twice = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_connector_owned_md_links_to_edges"))
    aliases = ambiguous_aliases(docs).agg(F.count(F.lit(1)).alias("ambiguous_markdown_aliases"))
    bad = "fail" if strict else "warn"
    rows = None
    for df in (one, paths, twice, aliases):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in df.columns]))
        part = df.select(pairs.alias("p")).select("p.check", F.when(F.col("p.n") > 0, bad).otherwise("pass").alias("status"), F.col("p.n").cast("string").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    indexes = list((catalog or Catalog()).indexes.values())
    store = store or {}
    known = [
        ("last_tx_id", "pass", str(store.get("tx", 0))), ("wal_records", "pass", str(store.get("versions", 0))),
        ("recovered_tail", bad if store.get("recovered") else "pass", str(bool(store.get("recovered"))).lower()),
        ("schema_indexes", bad if any(i.status != "ready" for i in indexes) else "pass", str(len(indexes))),
    ]
    rows = rows.unionByName(docs.sparkSession.createDataFrame(known, REPORT))
    rows = Scratch(docs.sparkSession, "health").cut(rows, "checks")  # the first line sums up the others
    level = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    worst = F.when(level == 2, "fail").when(level == 1, "warn").otherwise("pass")
    return rows.agg(worst.alias("status")).select(F.lit("status").alias("check"), "status", F.col("status").alias("value")).unionByName(rows)


def strict_exit(checks: DataFrame) -> int:
    """Exit code of a report: 2 if a check fails, else 0."""
    return 2 if not checks.where("status = 'fail'").isEmpty() else 0


def citation_audit(rows: DataFrame, required: tuple = ("path", "status", "source_hash")) -> DataFrame:
    """``rows`` with ``failures``: citation fields that are absent or blank; [] is good.

    ``rows`` may be the documents of a graph or the result of a query; a
    required column it does not have fails on every row.
    """
    absent = [F.lit(c) if c not in rows.columns else F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]
    return rows.withColumn("failures", F.array_compact(F.array(*absent)))


def citation_audit_context(spark: SparkSession, envelope: dict, required: tuple = ("path", "status", "source_hash")) -> DataFrame:
    """The audit of the nodes of a context envelope (asked for with these properties)."""
    rows = [(n["node_id"], *[n["properties"].get(c) for c in required]) for n in envelope["nodes"]]
    return citation_audit(spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} string" for c in required)), required)


def reindex_report(g: Graph) -> DataFrame:
    """The indexes of a graph and their state; scans need none, so none is built."""
    rows = [(i.name, i.target.name, i.prop, i.kind.lower(), i.status, False) for _, i in sorted(g.catalog.indexes.items())]
    return g.spark.createDataFrame(rows, "name string, target string, property string, kind string, status string, created boolean")


def normal_snapshot(docs: DataFrame, dirs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by path (``dir:`` before directories) and edges by ``from|type|to``."""
    nodes = docs.select("id", F.concat_ws("\n", "root", "path").alias("key"), tidy("status").alias("status"), "title")
    nodes = nodes.unionByName(dirs.select("id", F.concat(F.lit("dir:"), F.concat_ws("\n", "root", "path")).alias("key"), tidy("status").alias("status"), F.lit(None).cast("string").alias("title")))
    a, b = nodes.select(F.col("id").alias("src"), F.col("key").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("key").alias("b"))
    keyed = edges.join(a, "src").join(b, "dst").select(F.concat_ws("|", "a", "etype", "b").alias("key")).distinct()
    return nodes.drop("id"), keyed


def snapshot_diff(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """``key, change`` (added, removed, changed) between two keyed tables."""
    a = old.select("key", F.struct(F.lit(1), *values).alias("was"))
    b = new.select("key", F.struct(F.lit(1), *values).alias("now"))
    j = a.join(b, "key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return j.select("key", change.alias("change")).where("change IS NOT NULL")

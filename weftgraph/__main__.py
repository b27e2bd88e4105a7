"""Command line: query a graph store, look after it, sync notes into it, serve tools."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.lang.errors import QueryError
from weftgraph.operators import health
from weftgraph.operators.context import TABLE, context, context_ndjson, context_table
from weftgraph.plans.server import ToolServer, serve
from weftgraph.plans.session import GraphSession
from weftgraph.sources import formats
from weftgraph.sources.markdown import Vault, read_directory


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftgraph")
    p.add_argument("--config", default="weftgraph.toml", help="settings file: db_path, markdown_root, include_fs_graph")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *places: str, within=sub):
        v = within.add_parser(name)
        for x in places:
            v.add_argument(x)
        v.add_argument("--format", choices=("table", "json", "ndjson"), default="table")
        return v

    q = verb("query", "store", "text")
    q.add_argument("--params-json")
    q.add_argument("--params-file")
    q.add_argument("--max-rows", type=int, default=formats.DEFAULT_ROWS)
    q.add_argument("--with-md", metavar="ROOT", help="lay a folder of notes over the graph for this query")
    c = verb("context", "store")
    c.add_argument("--node", type=int, action="append", default=[])
    c.add_argument("--path", action="append", default=[])
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--direction", choices=("in", "out", "both"), default="both")
    c.add_argument("--edge-type", action="append", default=[])
    c.add_argument("--label", action="append", default=[])
    c.add_argument("--max-nodes", type=int, default=20)
    c.add_argument("--max-edges", type=int, default=100)
    for name in ("schema", "check", "compact", "upgrade", "repl"):
        verb(name, "store")
    m = sub.add_parser("memory").add_subparsers(dest="what", required=True)
    for name in ("check", "find-stale", "find-orphans", "reindex"):
        v = verb(name, "store", within=m)
        v.add_argument("--root")
        v.add_argument("--strict", action="store_true")
    verb("set-root", "store", "root", within=sub.add_parser("source").add_subparsers(dest="what", required=True))
    for name in ("sync", "serve"):
        v = sub.add_parser(name)
        v.add_argument("root", nargs="?")
        v.add_argument("--store")
        v.add_argument("--directories", action="store_true")
    return p


def _show(df: DataFrame, how: str, command: str, cap: int | None = formats.DEFAULT_ROWS) -> None:
    print(formats.as_table(df, cap) if how == "table" else (formats.as_json if how == "json" else formats.as_ndjson)([df], command, cap))


def _documents(s: GraphSession) -> tuple[DataFrame, DataFrame]:
    """The documents of a graph and its edges, as the checks take them."""
    wanted = ["root", "path", "source_hash", "status", "title", "aliases"]
    df, kinds = s.graph.scan_nodes(("MarkdownDocument",), wanted, "n")
    kind = {"aliases": "array<string>"}
    cols = [(F.col(f"`n·{c}`") if c in kinds else F.lit(None)).cast(kind.get(c, "string")).alias(c) for c in wanted]
    edges = s.graph.all_edges().select("src", "dst", F.lower("type").alias("etype"))
    return df.select(F.col("n").alias("id"), *cols), edges


def _memory(s: GraphSession, a: argparse.Namespace, settings: dict) -> int:
    if a.what == "reindex":
        _show(health.reindex_report(s.graph), a.format, "memory.reindex")
        return 0
    docs, edges = _documents(s)
    if a.what == "find-orphans":
        _show(health.orphan_documents(docs, edges).select("path", "title", "status").orderBy("path"), a.format, "memory.find-orphans")
        return 0
    root = s.resolve_root(a.root, settings)
    if root is None:
        raise QueryError("memory_root", "no folder of notes is known: give --root or set one")
    files = read_directory(s.spark, root).select("root", "path", "source_hash").withColumnRenamed("source_hash", "hash")
    if a.what == "find-stale":
        _show(health.stale_documents(docs, files, root).orderBy("path", "kind"), a.format, "memory.find-stale")
        return 0
    report = health.report(docs, edges, files, s.graph.catalog, s.check(), a.strict)
    _show(report, a.format, "memory.check")
    return health.strict_exit(report) if a.strict else 0


def _repl(s: GraphSession, lines=sys.stdin) -> int:
    """One statement per line; ``.quit`` ends."""
    for line in lines:
        line = line.strip()
        if line in (".quit", ".exit"):
            break
        if line:
            try:
                for r in s.execute(line):
                    if r.columns:
                        print(formats.as_table(r))
            except QueryError as e:
                print(f"{e.code}: {e}")
    return 0


def _sync(spark: SparkSession, a: argparse.Namespace, settings: dict) -> int:
    s = GraphSession.open(spark, a.store) if a.store else None
    root = a.root or settings.get("markdown_root") or (s.configured_root() if s else None)
    if root is None:
        raise QueryError("memory_root", "no folder of notes is known")
    v = Vault(spark)
    report = v.sync(root, a.directories or bool(settings.get("include_fs_graph")))
    if a.verb == "serve":
        serve(ToolServer(v, root))
        return 0
    if s is not None:
        s.graph = v.graph().but(catalog=s.graph.catalog, tx=s.graph.tx + 1)
        s.set_root(root)
    print(json.dumps(report))
    return 0


def main(argv: list[str]) -> int:
    a = _arguments().parse_args(argv)
    settings = formats.config(a.config)
    spark = SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return _run(spark, a, settings)
    except QueryError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1


def _run(spark: SparkSession, a: argparse.Namespace, settings: dict) -> int:
    if a.verb in ("sync", "serve"):
        return _sync(spark, a, settings)
    s = GraphSession.open(spark, a.store)
    if a.verb == "query":
        p = formats.params(a.params_json, a.params_file)
        results = [s.query_with_notes(a.text, a.with_md, p)] if a.with_md else s.execute(a.text, p)
        if a.format == "table":
            print("\n\n".join(formats.as_table(r, a.max_rows) for r in results))
        else:
            print((formats.as_json if a.format == "json" else formats.as_ndjson)(results, cap=a.max_rows))
    elif a.verb == "context":
        e = context(s.graph, a.node, a.path, a.depth, a.direction, tuple(a.edge_type), tuple(a.label), a.max_nodes, a.max_edges)
        if a.format == "table":
            print(formats.as_table(spark.createDataFrame(context_table(e), TABLE), None))
        else:
            print(json.dumps(e, ensure_ascii=False, default=str) if a.format == "json" else "\n".join(context_ndjson(e)))
    elif a.verb == "schema":
        _show(s.query("SHOW SCHEMA"), a.format, "schema", None)
    elif a.verb == "check":
        report = s.check()
        print(json.dumps(report))
        return 0 if report["ok"] else 2
    elif a.verb == "upgrade":
        report = s.store.backup(f"{s.store.path}.backup.{time.time_ns()}")
        s.save()  # the current format
        print(json.dumps(report | {"version": s.store.version(), "stored": s.check()}))
    elif a.verb == "memory":
        return _memory(s, a, settings)
    elif a.verb == "source":
        s.set_root(a.root)
    elif a.verb == "repl":
        return _repl(s)
    else:
        s.compact()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

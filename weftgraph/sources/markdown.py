"""Directory of Markdown notes to documents, directories and link edges.

Files are read with the binary source and parsed in Arrow batches.  Links are
resolved by joins: every document offers keys in several tiers, every link asks
for candidates in a fixed order, and the first tier with exactly one document
wins.  A sync keeps ids by (root, path), leaves the edges of other writers
alone, and marks what vanished.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.paths import normal_path
from weftgraph.operators.mutate import number
from weftgraph.session import Scratch, ship
from weftgraph.sources import frontmatter
from weftgraph.sources.graph import Graph
from weftgraph.sources.tables import tidy

RELATIONS = {"up": "up", "parent": "up", "related": "related", "next": "next", "previous": "previous", "link": "link", "links": "link"}
EDGE_TYPES = {"up": "MD_UP", "related": "MD_RELATED", "next": "MD_NEXT", "previous": "MD_PREVIOUS"}
DIRECTORY_WEIGHT = 0.25
PARSED = "root string, path string, ext string, source_hash string, status string, raw string, body string, title string, has_frontmatter boolean, tags array<string>, aliases array<string>, links array<string>, headings array<string>, frontmatter string, refs array<struct<target:string,source:string,relation:string,asks:array<struct<tier:int,key:string>>>>, keys array<struct<tier:int,key:string>>"


def content_hash(c: Column) -> Column:
    """16 hexadecimal digits that tell contents apart."""
    return F.substring(F.sha2(c, 256), 1, 16)


def _lines(text: str) -> list[str]:
    return [x.removesuffix("\r") for x in text.split("\n")]


def _unique(items) -> list:
    return list(dict.fromkeys(items))


def headings(body: str) -> list[str]:
    found = (line.lstrip().lstrip("#").strip().rstrip("#").strip() for line in _lines(body) if line.lstrip().startswith("#"))
    return _unique(h for h in found if h)


_TAG = re.compile(r"(?<![^\s(\[{])#([A-Za-z0-9_/-]+)")


def inline_tags(body: str) -> list[str]:
    return _unique(t for line in _lines(body) if not line.lstrip().startswith("# ") for t in _TAG.findall(line))


def body_links(body: str) -> list[str]:
    wiki = [x.strip() for x in re.findall(r"\[\[(.*?)\]\]", body, re.S)]
    plain = [x.strip() for x in re.findall(r"\[(?:(?!\]\().)*\]\(([^)]*)\)", body, re.S)]
    return _unique([x for x in wiki if x] + [x for x in plain if x and not x.startswith("#")])


def _texts(value) -> list[str]:
    """Strings of a scalar or list; a nested one-element list is a parsed ``[[x]]``."""
    values = value if isinstance(value, list) else [value]
    out = []
    for v in values:
        if isinstance(v, list) and len(v) == 1:
            v = v[0]
        if isinstance(v, str):
            v = v.strip()
            v = v[2:-2].strip() if v.startswith("[[") and v.endswith("]]") else v
            if v:
                out.append(v)
    return _unique(out)


def _listed(front: dict, *names: str) -> list[str]:
    for n in names:
        v = front.get(n)
        if isinstance(v, str):
            return [x.strip() for x in v.split(",") if x.strip()]
        if isinstance(v, list):
            return [str(x) for x in v if x is not None and not isinstance(x, (list, dict))]
    return []


# ---- resolution keys: tiers in the order in which they are tried
DIRECT, DERIVED, SLUG, ALIAS, FOLDED, STYLE = range(6)


def _stem(path: str) -> str:
    return re.sub(r"(?i)\.mdx?$", "", path)


def style_key(path: str) -> str | None:
    """Lower-case path without ending, outer slashes, index and site prefix."""
    p = _stem(path.strip().replace("\\", "/")).strip("/")
    p = p.removesuffix("/index")
    parts = p.split("/")
    if parts[0].lower() == "docs" and len(parts) > 1:
        parts = parts[1:]
    elif len(parts) > 2 and parts[1].lower() == "docs" and re.fullmatch(r"[A-Za-z0-9]{2}|(?=[^-]*-)[A-Za-z0-9-]{3,12}", parts[0]):
        parts = parts[2:]
    return "/".join(x for x in parts if x).lower() or None


def _slugs(slug: str) -> list[str]:
    bare = slug.strip().lstrip("/")
    return _unique([slug.strip(), bare, *[f"{s}{p}{bare}" for p in ("", "docs/", "en-US/docs/") for s in ("", "/")]]) if slug.strip() else []


def document_keys(path: str, aliases: list[str], slug: str | None) -> list[tuple[int, str]]:
    stem, name = _stem(path), PurePosixPath(path).name
    keys = [(DIRECT, path), (DIRECT, stem), (DIRECT, _stem(name))]
    folded, styled = [path, stem, _stem(name)], [path, stem]
    parent = str(PurePosixPath(path).parent)
    if re.fullmatch(r"(?i)index\.mdx?", name) and parent != ".":
        keys.append((DERIVED, parent))
        folded.append(parent)
        styled.append(parent)
    keys += [(ALIAS, a) for a in aliases] + [(SLUG, s) for s in _slugs(slug or "")]
    keys += [(FOLDED, x.lower()) for x in folded] + [(STYLE, k) for k in map(style_key, styled) if k]
    return _unique(keys)


def _inside(path: str) -> str | None:
    """The path with dots resolved; None if it leaves the root."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out) or None


def link_candidates(home: str, raw: str) -> list[tuple[int, str]]:
    """(tier, key) in the order in which a link of document ``home`` is tried."""
    target = raw.split("|")[0].strip()
    if "://" in target:
        rest = target.split("://", 1)[1]
        target = rest[rest.index("/") :] if "/" in rest else ""
    target = re.split(r"[?#]", target)[0].strip()
    if not target or target == "/":
        return []
    out, paths = [], []
    if target.startswith("/"):
        near = _inside(target)
    else:
        base = str(PurePosixPath(home).parent / target)
        near = _inside(base if PurePosixPath(target).suffix else base + ".md")
    if near:
        paths += [near, _stem(near)]
        out += [(DIRECT, near), (DIRECT, _stem(near)), (DERIVED, near), (DERIVED, _stem(near))]
    bare = _stem(target)
    paths = _unique([*paths, target, bare])
    out += [(DIRECT, target), (DIRECT, bare), (DERIVED, target), (DERIVED, bare)]
    out += [(SLUG, s) for s in _slugs(target)] + [(ALIAS, target), (ALIAS, bare)]
    out += [(FOLDED, p.lower()) for p in paths] + [(STYLE, k) for k in map(style_key, paths) if k]
    return _unique(out)


def parse_document(root: str, path: str, data: bytes | str, source_hash: str | None = None) -> dict:
    """A note as the columns ``PARSED``, with what each of its links asks for."""
    raw = data if isinstance(data, str) else data.decode("utf-8", "replace")
    head, body = frontmatter.split(raw)
    front: dict = {}
    if head is not None:
        try:
            front = frontmatter.parse(head)
        except frontmatter.FrontMatterError:
            head, body, front = None, raw, {}
    refs = [(t, "frontmatter", RELATIONS[k]) for k, v in front.items() if k in RELATIONS for t in _texts(v)]
    refs = _unique(refs + [(t, "body", None) for t in body_links(body)])
    heads = headings(body)
    title = front.get("title") if isinstance(front.get("title"), str) else heads[0] if heads else _stem(PurePosixPath(path).name)
    aliases, slug = _listed(front, "aliases", "alias"), front.get("slug")
    return {
        "root": root, "path": path, "ext": PurePosixPath(path).suffix[1:].lower(), "source_hash": source_hash, "status": "current", "raw": raw, "body": body,
        "title": title, "has_frontmatter": head is not None, "tags": _unique([*_listed(front, "tags", "tag"), *inline_tags(body)]), "aliases": aliases,
        "links": _unique(r[0] for r in refs), "headings": heads, "frontmatter": json.dumps(front, default=str, ensure_ascii=False) if head is not None else None,
        "refs": [(*r, link_candidates(path, r[0])) for r in refs],
        "keys": document_keys(path, aliases, slug if isinstance(slug, str) else None),
    }


_NAMES = [c.split()[0] for c in re.split(r", (?=\w+ \w)", PARSED)]


def parse_notes(notes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``root, path, content`` (text or bytes) as ``keep`` and ``PARSED``, in Arrow batches.

    A null path or content gives no row.  The hash is made in the JVM.
    """
    rows = notes.where("path IS NOT NULL AND content IS NOT NULL").select(*keep, "root", "path", "content", content_hash(F.col("content").cast("binary")).alias("hash"))
    kept = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [parse_document(r, p, d if isinstance(d, str) else bytes(d), h) for r, p, d, h in zip(b["root"], b["path"], b["content"], b["hash"])]
            yield pd.concat([b[list(keep)].reset_index(drop=True), pd.DataFrame(made, columns=_NAMES)], axis=1)

    return rows.mapInPandas(run, kept + PARSED)


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """All ``.md`` and ``.mdx`` files below ``root``, parsed; columns ``PARSED``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],[mM][dD][xX]}").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    where = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    return parse_notes(files.select(F.lit(base).alias("root"), F.ltrim(F.substring(where, len(base) + 1, 1 << 30), F.lit("/")).alias("path"), "content"))


def resolve_links(docs: DataFrame) -> DataFrame:
    """``src, dst, target, source, relation`` of every reference; dst is null
    where none or several documents fit.  ``docs``: id, root, path, refs, keys."""
    keys = docs.select("root", "path", "id", F.explode("keys").alias("k")).select("root", "path", "id", "k.tier", "k.key")
    offers = keys.groupBy("root", "tier", "key").agg(F.countDistinct("id").alias("n"), F.min(F.struct("path", "id")).alias("first"))
    # a key that several documents offer resolves nothing, but a direct one means the first path
    offers = offers.where((F.col("n") == 1) | (F.col("tier") == DIRECT)).select("root", "tier", "key", F.col("first.id").alias("dst"))
    refs = docs.select(F.col("id").alias("src"), "root", F.posexplode("refs").alias("no", "r")).select("src", "root", "no", "r.target", "r.source", "r.relation", "r.asks")
    asked = refs.select("src", "root", "no", F.posexplode("asks").alias("order", "k")).select("src", "root", "no", "order", "k.tier", "k.key").join(offers, ["root", "tier", "key"])
    best = asked.groupBy("src", "no").agg(F.min(F.struct("order", "dst")).alias("hit"))
    return refs.join(best, ["src", "no"], "left").select("src", F.col("hit.dst").alias("dst"), "target", "source", "relation")


def link_edges(resolved: DataFrame) -> DataFrame:
    """Edges per (src, dst, type) with the targets, sources and relations behind them."""
    mapping = F.create_map(*[F.lit(x) for kv in EDGE_TYPES.items() for x in kv])
    typed = resolved.where("dst IS NOT NULL").withColumn("type", F.coalesce(F.try_element_at(mapping, F.col("relation")), F.lit("MD_LINKS_TO")))
    # a typed relation is a link as well
    also = typed.where("type <> 'MD_LINKS_TO'").withColumn("type", F.lit("MD_LINKS_TO"))
    lists = lambda c: F.array_sort(F.collect_set(c))
    out = typed.unionByName(also).groupBy("src", "dst", "type").agg(F.min("target").alias("link_target"), lists("target").alias("link_targets"), lists("source").alias("link_sources"), lists("relation").alias("link_rels"))
    return out.withColumn("status", F.lit("current"))


def directory_paths(docs: DataFrame) -> DataFrame:
    """Every directory above a document, the root as ``.``: root, path, parent."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = docs.select("root", F.explode(F.array_distinct(ups)).alias("path")).distinct()
    parent = F.when(F.col("path") == "", F.lit(None)).otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
    dot = lambda c: F.when(c == "", F.lit(".")).otherwise(c)
    return dirs.select("root", dot(F.col("path")).alias("path"), dot(parent).alias("parent"))


def merge_documents(state: DataFrame, scan: DataFrame, roots: list[str]) -> DataFrame:
    """The state after a scan of ``roots``, by (root, path), with ``change``.

    Scanned documents take the columns of the scan; they keep their id (null for
    new ones) and every column the scan does not have.  Documents of the roots
    that were not found are marked missing, those of other roots stay.
    ``change``: created, updated, revived, unchanged, tombstoned or kept.
    """
    own = [c for c in scan.columns if c not in ("root", "path", "id")]
    user = [c for c in state.columns if c not in scan.columns and c != "id"]
    shared = [c for c in own if c in state.columns]
    was = state.select("root", "path", "id", *[F.col(c).alias(f"__{c}") for c in shared], *user, F.lit(True).alias("__was"))
    j = scan.drop("id").withColumn("__now", F.lit(True)).join(was, ["root", "path"], "full")
    now, lost = F.col("__now").isNotNull(), F.col("root").isin(roots)
    missing = tidy("__status") == "missing"
    change = (
        F.when(now & F.col("__was").isNull(), "created").when(now & missing, "revived").when(now & ~F.col("source_hash").eqNullSafe(F.col("__source_hash")), "updated")
        .when(now, "unchanged").when(lost & ~F.coalesce(missing, F.lit(False)), "tombstoned").otherwise("kept")
    )
    values = [F.when(now, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in shared else F.col(c) for c in own if c != "status"]
    status = F.when(now, F.col("status")).when(lost, F.lit("missing")).otherwise(F.col("__status")).alias("status")
    return j.select("id", "root", "path", *values, status, *user, change.alias("change"))


def sync_report(merged: DataFrame, resolved: DataFrame) -> dict:
    """Counts of a sync: documents by change, links by outcome."""
    n = {r["change"]: r["n"] for r in merged.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    links = resolved.agg(F.count(F.lit(1)), F.count("dst")).first()
    seen = {c: n.get(c, 0) for c in ("created", "updated", "revived")}
    return {"scanned": sum(seen.values()) + n.get("unchanged", 0), **seen, "links": links[0], "resolved": links[1], "unresolved": links[0] - links[1], "tombstoned": n.get("tombstoned", 0)}


class Vault:
    """The state of one synced directory: documents, directories and edges."""

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None, dirs: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark, self.docs, self.dirs, self.edges = spark, docs, dirs, edges
        self.next_id = 1

    def graph(self, shift: int = 0) -> Graph:
        """Documents, directories and edges as a graph; ``shift`` moves the ids
        away from those of a graph it is laid over."""
        own = [c for c in self.docs.columns if c not in ("refs", "keys", "id")]
        g = Graph(self.spark).with_nodes("MarkdownDocument", self.docs.select((F.col("id") + shift).alias("id"), *own))
        if self.dirs is not None:
            g = g.with_nodes("MarkdownDirectory", self.dirs.select((F.col("id") + shift).alias("id"), "root", "path", "status"))
        ends = [F.xxhash64("src", "dst", "type").alias("id"), (F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst")]
        rest = [c for c in self.edges.columns if c not in ("src", "dst", "type", "id")]
        for kind in ["MD_LINKS_TO", *EDGE_TYPES.values(), "MD_IN_DIRECTORY", "MD_PARENT_DIRECTORY"]:
            g = g.with_edges(kind, self.edges.where(F.col("type") == kind).select(*ends, *rest))
        return g

    def sync(self, root: str, directory_graph: bool = False) -> dict:
        """Bring the state up to date with the files below ``root``; returns counts.

        Documents keep their id and any column the connector does not own; those
        that vanished are marked missing and lose their connector edges.  Edges
        without a connector status stay as they are.
        """
        scratch = Scratch(self.spark, "vault")
        new = scratch.cut(read_directory(self.spark, root), "scan")
        base = re.sub(r"^file:/*", "/", root.rstrip("/"))
        old = self.docs if self.docs is not None else new.limit(0).withColumn("id", F.lit(None).cast("bigint"))
        merged = scratch.cut(merge_documents(old, new, [base]), "merged")
        fresh, n = number(scratch, merged.where("id IS NULL").drop("id"), "id", self.next_id)
        self.next_id += n
        state = scratch.cut(merged.where("id IS NOT NULL").unionByName(fresh), "state")
        docs = state.where("change IN ('created', 'updated', 'revived', 'unchanged')").drop("change")
        resolved = scratch.cut(resolve_links(docs), "links")
        report = sync_report(merged, resolved)
        links = link_edges(resolved)
        self.docs = state.drop("change")
        edges = links
        if directory_graph:
            edges = edges.unionByName(self._directories(scratch, docs, base), allowMissingColumns=True)
        if self.edges is not None:
            mine = self.docs.where(F.col("root") == base).select(F.col("id").alias("src"))
            kept = self.edges.where("status IS NULL").unionByName(self.edges.where("status IS NOT NULL").join(mine, "src", "left_anti"))
            edges = edges.unionByName(kept, allowMissingColumns=True)
        self.edges = scratch.cut(edges, "edges")
        return report

    def _directories(self, scratch: Scratch, docs: DataFrame, base: str) -> DataFrame:
        paths = scratch.cut(directory_paths(docs), "directories")
        old = self.dirs.select("id", "root", "path") if self.dirs is not None else self.spark.createDataFrame([], "id bigint, root string, path string")
        j = paths.join(old, ["root", "path"], "left")
        fresh, n = number(scratch, j.where("id IS NULL").drop("id"), "id", self.next_id)
        self.next_id += n
        dirs = scratch.cut(j.where("id IS NOT NULL").unionByName(fresh).withColumn("status", F.lit("current")), "dirs")
        gone = old.join(paths.select("root", "path"), ["root", "path"], "left_anti").withColumn("status", F.when(F.col("root") == base, "missing").otherwise("current"))
        at = dirs.select("root", F.col("path").alias("parent"), F.col("id").alias("dst"))
        up = dirs.where("parent IS NOT NULL").join(at, ["root", "parent"]).select(F.col("id").alias("src"), "dst", F.lit("MD_PARENT_DIRECTORY").alias("type"))
        home = F.regexp_replace("path", "/?[^/]*$", "")
        into = docs.select(F.col("id").alias("src"), "root", F.when(home == "", ".").otherwise(home).alias("parent")).join(at, ["root", "parent"])
        into = into.select("src", "dst", F.lit("MD_IN_DIRECTORY").alias("type"))
        self.dirs = scratch.cut(dirs.drop("parent").unionByName(gone.select("root", "path", "id", "status")), "dir-state")
        return up.unionByName(into).withColumn("status", F.lit("current")).withColumn("edge_weight", F.lit(DIRECTORY_WEIGHT))


def vault_files(docs: DataFrame) -> DataFrame:
    """Documents as the file listing that freshness checks take."""
    return docs.select("root", normal_path(F.col("path")).alias("path"), F.col("source_hash").alias("hash"))

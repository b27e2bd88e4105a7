"""Seeded neighbourhoods of a graph, with and without a budget."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lang.errors import QueryError
from weftgraph.session import Scratch
from weftgraph.sources.graph import Graph

MAX_DEPTH, MAX_BYTES = 10, 65_536


def _incident(g: Graph, direction: str, types: tuple) -> DataFrame:
    """``at, next, edge, dir, type, src, dst`` for every way along an edge."""
    df, _ = g.scan_edges(types, [], "e")
    e = df.select(F.col("e").alias("edge"), F.col("e·src").alias("src"), F.col("e·dst").alias("dst"), F.col("e·type").alias("type"))
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("next"), "edge", F.lit(0).alias("dir"), "type", "src", "dst")
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("next"), "edge", F.lit(1).alias("dir"), "type", "src", "dst")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def _allowed(g: Graph, labels: tuple) -> DataFrame:
    nodes = g.all_nodes()
    return (nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))) if labels else nodes).select(F.col("id").alias("next"))


def expand(g: Graph, seeds: DataFrame, depth: int, direction: str = "both", types: tuple = (), labels: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Everything within ``depth`` steps of the seeds, in parallel.

    ``seeds`` has a column ``id``.  Returns nodes (id, depth) and edges (id,
    depth); the first discovery fixes the depth.  Nodes other than seeds need
    one of ``labels``, if any are given.  Nulls, repeats and ids that are no
    node are left out of the seeds.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise QueryError("context_depth", f"depth must be 0 to {MAX_DEPTH}")
    scratch = Scratch(g.spark, "context")
    ways = _incident(g, direction, types)
    seeds = scratch.cut(seeds.select("id").distinct().join(g.all_nodes().select("id"), "id", "left_semi"), "seeds")
    allowed = _allowed(g, labels).union(seeds.select("id")).distinct() if labels else _allowed(g, ())
    nodes = seeds.withColumn("depth", F.lit(0))
    frontier, edges = seeds, None
    for k in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("at")).join(ways, "at").join(allowed, "next", "left_semi")
        step = scratch.cut(step.select("next", F.col("edge").alias("id")), f"level{k}")
        found = step.select("id").distinct().withColumn("depth", F.lit(k))
        edges = found if edges is None else edges.unionByName(found)
        frontier = scratch.cut(step.select(F.col("next").alias("id")).distinct().join(nodes, "id", "left_anti"), f"frontier{k}")
        nodes = nodes.unionByName(frontier.withColumn("depth", F.lit(k)))
    if edges is None:
        edges = g.spark.createDataFrame([], "id bigint, depth int")
    return nodes, edges.groupBy("id").agg(F.min("depth").alias("depth"))


def resolve_seeds(g: Graph, ids: list[int] = (), paths: list[str] = ()) -> tuple[list[int], list[str]]:
    """Seed ids and warnings; a path that several nodes have means the current one."""
    df, kinds = g.scan_nodes((), ["path", "status"], "n")
    path = F.col("`n·path`") if "path" in kinds else F.lit(None).cast("string")
    status = F.col("`n·status`") if "status" in kinds else F.lit("current")
    rows = df.select("n", path.alias("path"), F.lower(F.trim(status)).alias("status"))
    current = F.when(F.col("status") == "current", F.col("n"))
    counted = [F.count("n").alias("nodes"), F.min("n").alias("n"), F.min("status").alias("status"), F.count(current).alias("currents"), F.min(current).alias("current")]
    # one row per seed asked for, however many nodes have its path
    states = {r["n"]: r["status"] for r in rows.where(F.col("n").isin(list(ids))).groupBy("n").agg(F.min("status").alias("status")).collect()} if ids else {}
    at = {r["path"]: r for r in rows.where(F.col("path").isin(list(paths))).groupBy("path").agg(*counted).collect()} if paths else {}
    out, warn = [], []
    for i in ids:
        if i not in states:
            raise QueryError("context_seed_not_found", f"no node {i}")
        out.append(i)
    for p in paths:
        hit = at.get(p)
        if hit is None:
            raise QueryError("context_seed_path_not_found", f"no node with path {p}")
        if hit["nodes"] > 1 and hit["currents"] != 1:
            raise QueryError("context_seed_path_ambiguous", f"several nodes have path {p}")
        out.append(hit["n"] if hit["nodes"] == 1 else hit["current"])
        states[out[-1]] = hit["status"] if hit["nodes"] == 1 else "current"
    if len(set(out)) < len(out):
        warn.append("context_seed_duplicate")
    seeds = list(dict.fromkeys(out))
    if any(states[s] not in (None, "current") for s in seeds):
        warn.append("context_seed_stale")
    return seeds, warn


#: Properties that count as evidence of where a node comes from.
EVIDENCE = ("name", "title", "path", "status")


def context(g: Graph, ids: list[int] = (), paths: list[str] = (), depth: int = 2, direction: str = "both", types: tuple = (), labels: tuple = (), max_nodes: int = 20, max_edges: int = 100, props: list[str] = EVIDENCE, max_bytes: int = MAX_BYTES) -> dict:
    """The envelope of a budgeted expansion, at most ``max_bytes`` as JSON.

    Per level only the incident edges of the frontier travel to the driver, at
    most twice the edge budget, since an edge shows from at most two ends.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise QueryError("context_depth", f"depth must be 0 to {MAX_DEPTH}")
    seeds, warnings = resolve_seeds(g, ids, paths)
    ways, allowed = _incident(g, direction, types), _allowed(g, labels)
    depths, origin = {s: 0 for s in seeds}, {s: s for s in seeds}
    edges: dict[int, dict] = {}
    frontier, others, truncated = list(seeds), 0, False
    for level in range(1, depth + 1):
        if not frontier:
            break
        at = g.spark.createDataFrame(list(enumerate(frontier)), "pos bigint, at bigint")
        step = ways.join(F.broadcast(at), "at")  # as many rows as the node budget at most
        if labels:
            ok = allowed.union(g.spark.createDataFrame([(s,) for s in seeds], "next bigint")).distinct()
            step = step.join(ok, "next", "left_semi")
        order = ["pos", "dir", "edge"]
        rows = step.orderBy(*order).limit(2 * max_edges + 2).collect()
        new: list[int] = []
        for r in rows:
            if len(edges) >= max_edges:
                truncated = True
                break
            nxt, way, start = r["next"], "in" if r["dir"] else "out", origin[r["at"]]
            said = f"seed {start} reached node {nxt} via {way} edge at depth {level}"
            proof = [{"field": "edge_id", "value": str(r["edge"]), "source": f"edge:e{r['edge']}"}, {"field": "traversal", "value": said, "source": "context.traversal"}]
            edges.setdefault(r["edge"], {"edge_id": r["edge"], "type": r["type"], "source_node_id": r["src"], "target_node_id": r["dst"], "direction_from_seed": way, "depth": level, "evidence": proof})
            if nxt not in depths:
                if others >= max_nodes:
                    truncated = True
                    continue
                depths[nxt], origin[nxt] = level, start
                others += 1
                new.append(nxt)
        frontier = new
    ordered = sorted(depths, key=lambda n: (depths[n], n))
    cap = max(max_nodes, len(seeds))
    if len(ordered) > cap:
        ordered, truncated = ordered[:cap], True
    keep = set(ordered)
    chosen = [e for e in sorted(edges.values(), key=lambda e: (e["depth"], e["edge_id"])) if e["source_node_id"] in keep and e["target_node_id"] in keep]
    if truncated:
        warnings.append("context_budget_truncated")
    df, kinds = g.scan_nodes((), list(props), "n")
    cols = [F.col(f"`n·{p}`").alias(p) for p in props if p in kinds]
    info = {r["id"]: r.asDict(True) for r in df.where(F.col("n").isin(ordered)).select(F.col("n").alias("id"), F.array_sort("n·labels").alias("labels"), *cols).collect()}
    nodes = [_node(n, depths[n], info.get(n, {})) for n in ordered]
    budget = {"nodes": max_nodes, "edges": max_edges, "snippet_bytes": 0, "total_payload_bytes": max_bytes}
    envelope = {
        "ok": True, "command": "context", "policy": {"execution_mode": "automation_read_only", "retrieval_budget": budget},
        "retrieval_usage": {"nodes": 0, "edges": 0, "snippet_bytes": 0, "total_payload_bytes": 0, "truncated": truncated},
        "seeds": [{"kind": "node", "value": str(i), "node_ids": [i]} for i in ids] + [{"kind": "path", "value": p, "node_ids": [s]} for p, s in zip(paths, _by_path(paths, ids, seeds))],
        "nodes": nodes, "edges": chosen, "warnings": warnings,
    }
    return _fit(envelope, set(seeds))


def _by_path(paths: list[str], ids: list[int], seeds: list[int]) -> list[int | None]:
    """The seed of each path; the seeds hold those of the ids first, repeats once."""
    rest = seeds[len(dict.fromkeys(ids)) :]
    return [rest[k] if k < len(rest) else None for k in range(len(paths))]


def _node(n: int, depth: int, info: dict) -> dict:
    own = {k: v for k, v in info.items() if k not in ("id", "labels") and v is not None}
    labels = info.get("labels", [])
    proof = [{"field": k, "value": str(own[k]), "source": f"property:{k}"} for k in EVIDENCE if k in own]
    if labels:
        proof.append({"field": "labels", "value": ",".join(labels), "source": "labels(n)"})
    display = next((str(own[k]) for k in EVIDENCE[:3] if k in own), None)
    return {"node_id": n, "depth": depth, "labels": labels, "properties": own, "display": display, "evidence": proof}


def _measured(envelope: dict) -> int:
    """Bytes of the envelope as JSON, its own size entry included."""
    usage = envelope["retrieval_usage"]
    usage["nodes"], usage["edges"] = len(envelope["nodes"]), len(envelope["edges"])
    while True:
        size = len(json.dumps(envelope, default=str).encode())
        if usage["total_payload_bytes"] == size:
            return size
        usage["total_payload_bytes"] = size


def _fit(envelope: dict, seeds: set[int]) -> dict:
    """Drop edges, then other nodes with theirs, from the end until the JSON fits."""
    most = envelope["policy"]["retrieval_budget"]["total_payload_bytes"]
    while _measured(envelope) > most:
        envelope["retrieval_usage"]["truncated"] = True
        if "context_payload_truncated" not in envelope["warnings"]:
            envelope["warnings"].append("context_payload_truncated")
        if envelope["edges"]:
            envelope["edges"].pop()
        elif envelope["nodes"] and envelope["nodes"][-1]["node_id"] not in seeds:
            envelope["nodes"].pop()
        else:
            raise QueryError("context_payload_too_large", "the seeds alone exceed the payload limit")
    return envelope


def context_ndjson(envelope: dict) -> list[str]:
    """One line for the head, and one for each seed, node and edge."""
    head = {"kind": "context_meta"} | {k: v for k, v in envelope.items() if k not in ("seeds", "nodes", "edges")}
    lines = [head, *[{"kind": "context_seed", "seed": s} for s in envelope["seeds"]]]
    lines += [{"kind": "context_node", "node_index": k, "node": n} for k, n in enumerate(envelope["nodes"])]
    lines += [{"kind": "context_edge", "edge_index": k, "edge": e} for k, e in enumerate(envelope["edges"])]
    return [json.dumps(x, ensure_ascii=False, default=str) for x in lines]


TABLE = "row string, depth bigint, id string, label_or_type string, display string, source string, target string"


def context_table(envelope: dict) -> list[tuple]:
    """The envelope as rows of ``TABLE``."""
    rows = [(f"seed:{s['kind']}", 0, ",".join(map(str, s["node_ids"])), s["kind"], s["value"], "", "") for s in envelope["seeds"]]
    rows += [("node", n["depth"], str(n["node_id"]), ",".join(n["labels"]), n["display"] or "", "", "") for n in envelope["nodes"]]
    return rows + [("edge", e["depth"], str(e["edge_id"]), e["type"], e["direction_from_seed"], str(e["source_node_id"]), str(e["target_node_id"])) for e in envelope["edges"]]


def induced_edges(g: Graph, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    e = g.all_edges()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("id", "src", "dst", "type")


def viewer_seed(g: Graph, nodes: DataFrame, edges: DataFrame | None = None, radius: int = 0, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """What a viewer shows for a result: nodes (id) and edges (id, src, dst, type).

    Returned edges bring their ends.  If none was returned, all edges between
    the nodes are shown.  ``radius`` steps around the nodes are added by
    distance and id; no more than ``cap`` nodes are shown.
    """
    chosen = nodes.select("id")
    all_edges = g.all_edges()
    if edges is not None:
        own = all_edges.join(edges.select("id").distinct(), "id", "left_semi")
        chosen = chosen.union(own.select("src")).union(own.select("dst"))
    ring, _ = expand(g, chosen, radius)
    shown = Scratch(g.spark, "viewer").cut(ring.groupBy("id").agg(F.min("depth").alias("depth")).orderBy("depth", "id").limit(cap), "shown")
    inside = induced_edges(g, shown)
    if edges is not None and radius == 0:
        inside = inside.join(edges.select("id").distinct(), "id", "left_semi")
    return shown.select("id"), inside

"""Retrieval tools over JSON-RPC lines: one request per line, one answer."""

from __future__ import annotations

import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from weftgraph import __version__
from weftgraph.lang.errors import QueryError
from weftgraph.operators import search as S
from weftgraph.operators.context import context
from weftgraph.sources.formats import plain
from weftgraph.sources.markdown import Vault

BODY_CHARS = 4_000
TOOLS = {
    "search": ("Lexical search", {"query": "string", "tags": "array", "limit": "integer", "mode": "string"}),
    "get": ("One document by id, path or title", {"key": "string", "max_chars": "integer"}),
    "list": ("Documents by path", {"limit": "integer"}),
    "context": ("Seeded neighbourhood", {"ids": "array", "paths": "array", "depth": "integer", "direction": "string", "edge_types": "array", "labels": "array", "max_nodes": "integer", "max_edges": "integer"}),
    "add_note": ("Write a note and sync", {"path": "string", "title": "string", "body": "string", "tags": "array"}),
}


class ToolServer:
    """Answers tool calls over a vault; ``root`` allows notes to be added."""

    def __init__(self, vault: Vault, root: str | None = None):
        self.vault, self.root = vault, root

    @property
    def docs(self) -> DataFrame:
        return self.vault.docs.select("id", "path", "title", "aliases", "tags", "headings", "body", "raw", "status")

    def handle(self, line: str) -> str | None:
        try:
            req = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        if "id" not in req:
            return None
        try:
            out = {"result": self.request(req.get("method"), req.get("params") or {})}
        except KeyError as e:
            out = {"error": {"code": -32601, "message": f"unknown {e.args[0]}"}}
        except (QueryError, ValueError, TypeError) as e:
            out = {"error": {"code": -32602, "message": str(e)}}
        return json.dumps({"jsonrpc": "2.0", "id": req["id"], **out}, ensure_ascii=False)

    def request(self, method: str, p: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "serverInfo": {"name": "weftgraph", "version": __version__}, "capabilities": {"tools": {}, "resources": {}}}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in args.items()}}} for n, (d, args) in TOOLS.items()]}
        if method == "resources/list":
            rows = S.list_documents(self.docs, S.MAX_LIMIT).collect()
            return {"resources": [{"uri": f"note:///{r['path']}", "name": r["title"], "mimeType": "text/markdown"} for r in rows]}
        if method == "resources/read":
            hit = self.docs.where(self.docs.path == p["uri"].removeprefix("note:///")).limit(1).collect()
            if not hit:
                raise ValueError("not_found")
            return {"contents": [{"uri": p["uri"], "mimeType": "text/markdown", "text": hit[0]["raw"]}]}
        if method == "tools/call":
            name = p.get("name")
            if name not in TOOLS:
                raise KeyError(f"tool {name}")
            value = getattr(self, "tool_" + name)(**(p.get("arguments") or {}))
            return {"content": [{"type": "text", "text": json.dumps(plain(value), ensure_ascii=False, default=str)}], "isError": not value.get("ok", True)}
        raise KeyError(f"method {method}")

    def tool_search(self, query: str, tags: list | None = None, limit: int = S.DEFAULT_LIMIT, mode: str = "lexical") -> dict:
        if mode != "lexical":
            return S.semantic_search()
        current = self.docs.where("status = 'current'")
        e = self.vault.edges
        tree = None
        if self.vault.dirs is not None:
            inside = e.where("type = 'MD_IN_DIRECTORY'").selectExpr("src AS doc", "dst AS dir", "edge_weight AS weight")
            tree = (inside, e.where("type = 'MD_PARENT_DIRECTORY'").selectExpr("src AS child", "dst AS parent"))
        rows = S.search(current, query, tags, limit, tree).orderBy("rank").collect()
        return {"ok": True, "query": query, "truncated": bool(rows and rows[0]["truncated"]), "items": [{k: v for k, v in r.asDict().items() if k != "truncated"} for r in rows]}

    def tool_get(self, key: str, max_chars: int = BODY_CHARS) -> dict:
        rows = S.get_document(self.docs, key).limit(1).collect()
        if not rows:
            return {"ok": False, "error": {"code": "not_found"}}
        d = rows[0].asDict()
        return {"ok": True, "document": {k: d[k] for k in ("id", "path", "title", "tags", "status")} | {"body": d["body"][:max_chars], "truncated": len(d["body"]) > max_chars}}

    def tool_list(self, limit: int = S.DEFAULT_LIMIT) -> dict:
        return {"ok": True, "items": [{"id": r["id"], "path": r["path"], "title": r["title"]} for r in S.list_documents(self.docs, limit).collect()]}

    def tool_context(self, ids: list = (), paths: list = (), depth: int = 2, direction: str = "both", edge_types: list = (), labels: list = (), max_nodes: int = 25, max_edges: int = 100) -> dict:
        return {"ok": True} | context(self.vault.graph(), ids, paths, depth, direction, tuple(edge_types), tuple(labels), min(max_nodes, 250), min(max_edges, 1_000))

    def tool_add_note(self, path: str, body: str, title: str | None = None, tags: list = ()) -> dict:
        if self.root is None:
            return {"ok": False, "error": {"code": "read_only"}}
        if path.startswith("/") or "\\" in path or ".." in path.split("/") or not re.search(r"(?i)\.mdx?$", path):
            return {"ok": False, "error": {"code": "invalid_path"}}
        target = Path(self.root) / path
        if target.exists():
            return {"ok": False, "error": {"code": "exists"}}
        head = ["---", *([f"title: {json.dumps(title)}"] if title else []), *([f"tags: {json.dumps(list(tags))}"] if tags else []), "---", ""]
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n".join(head) + body, encoding="utf-8")
        return {"ok": True, "path": path, "report": self.vault.sync(self.root, self.vault.dirs is not None)}


def serve(server: ToolServer, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            answer = server.handle(line)
            if answer is not None:
                print(answer, file=out, flush=True)

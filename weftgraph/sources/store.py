"""Versioned graph store: Parquet parts and a manifest per version.

Each commit writes the parts that changed into a new version folder, and last a
manifest, which gets its name by one rename: a version is there with its
manifest or not at all, and the largest is the current one.  Parts that did not
change are referred to where they are, with the row count and digest they had.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from weftgraph.lang.ast import Target
from weftgraph.lang.errors import QueryError
from weftgraph.sources.graph import Catalog, ConstraintDef, Graph, IndexDef, Part

FORMAT = 1
#: Parts written or checked at the same time.
WRITERS = 8


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._kept: dict[int, dict] = {}

    # ---- small files through the Hadoop file system

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, name: str, text: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}.{uuid.uuid4().hex[:8]}.tmp")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = self._fs(f"{self.path}/{name}")
        if fs.exists(final) or not fs.rename(p, final):
            fs.delete(p, False)
            raise QueryError("storage_write_failed", f"cannot write {name}: another session may have written it")

    def _get(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    # ---- versions

    def versions(self) -> list[int]:
        """The versions that are complete, in order."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m)

    def version(self) -> int:
        return max(self.versions(), default=0)

    @staticmethod
    def _sums(df: DataFrame) -> list[Column]:
        """Row count and an order-free digest of all values, in two halves."""
        cols = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
        h = F.xxhash64(*cols)
        return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(F.xxhash64(h, F.lit(1))), F.lit(0)).alias("b")]

    @staticmethod
    def _entry(sums: dict) -> dict:
        return {"rows": sums["rows"], "digest": f"{sums['a'] & (1 << 64) - 1:016x}{sums['b'] & (1 << 64) - 1:016x}"}

    def save(self, g: Graph) -> int:
        """Write a version; returns its number."""
        v = self.version() + 1
        folder = f"v{v}-{uuid.uuid4().hex[:8]}"
        own = [("nodes", k, p) for k, p in enumerate(g.nodes)] + [("edges", k, p) for k, p in enumerate(g.edges)]

        def write(kind: str, k: int, p: Part) -> None:
            place, seen = f"{folder}/{kind}-{k}", Observation()  # counted while it is written
            p.df.observe(seen, *self._sums(p.df)).write.mode("overwrite").parquet(f"{self.path}/{place}")
            self._kept[id(p.df)] = {"path": place, **self._entry(seen.get)}

        with ThreadPoolExecutor(WRITERS) as pool:  # small parts side by side
            list(pool.map(lambda x: write(*x), [x for x in own if id(x[2].df) not in self._kept]))
        parts = {"nodes": [], "edges": []}
        for kind, _, p in own:
            parts[kind].append({"labels": p.labels, "type": p.type, "schema": p.df.schema.json(), **self._kept[id(p.df)]})
        c = g.catalog
        manifest = {
            "format": FORMAT, "version": v, "tx": g.tx, "next_node": g.next_node, "next_edge": g.next_edge, **parts,
            "labels": sorted(c.labels), "edge_types": sorted(c.edge_types),
            "descriptions": [[t.kind, t.name, d] for t, d in c.descriptions.items()],
            "indexes": [asdict(i) for i in c.indexes.values()], "constraints": [asdict(k) for k in c.constraints.values()],
        }
        self._keep = [p.df for p in (*g.nodes, *g.edges)]  # ids above stay taken
        self._put(f"manifest-{v}.json", json.dumps(manifest))
        return v

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        text = self._get(f"manifest-{v}.json")
        if text is None:
            raise QueryError("storage_not_found", f"no graph at {self.path}")
        m = json.loads(text)
        if m["format"] > FORMAT:
            raise QueryError("storage_format_unsupported", f"format {m['format']} is newer than {FORMAT}")
        return m

    def _read(self, part: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(part["schema"]))).parquet(f"{self.path}/{part['path']}")

    def load(self, version: int | None = None) -> Graph:
        m = self._manifest(version)

        def part(p: dict) -> Part:
            df = self._read(p)
            self._kept[id(df)] = {k: p[k] for k in ("path", "rows", "digest")}
            return Part(df, tuple(p["labels"]) if p["labels"] is not None else None, p["type"])

        target = lambda t: Target(t["kind"], t["name"])
        c = Catalog(
            frozenset(m["labels"]), frozenset(m["edge_types"]), {Target(k, n): d for k, n, d in m["descriptions"]},
            {i["name"]: IndexDef(**(i | {"target": target(i["target"])})) for i in m["indexes"]},
            {k["name"]: ConstraintDef(k["name"], target(k["target"]), tuple(k["spec"])) for k in m["constraints"]},
        )
        g = Graph(self.spark, [part(p) for p in m["nodes"]], [part(p) for p in m["edges"]], c, m["next_node"], m["next_edge"], m["tx"])
        self._keep = [p.df for p in (*g.nodes, *g.edges)]
        return g

    def check(self) -> dict:
        """Counts and digests of the manifest against the files.

        ``recovered``: files of a write that never became a version are left
        over; they do no harm, and compacting removes them.
        """
        m = self._manifest()
        parts = [*m["nodes"], *m["edges"]]
        with ThreadPoolExecutor(WRITERS) as pool:
            bad = [p["path"] for p, b in zip(parts, pool.map(self._damaged, parts)) if b]
        every = [self._manifest(v) for v in self.versions()]
        named = {p["path"].split("/")[0] for w in every for p in (*w["nodes"], *w["edges"])}
        fs, root = self._fs(self.path)
        stray = [n for s in fs.listStatus(root) if not re.fullmatch(r"manifest-\d+\.json", n := s.getPath().getName()) and n not in named]
        return {"ok": not bad, "version": m["version"], "format": m["format"], "parts": len(parts), "damaged": bad, "tx": m["tx"], "versions": len(self.versions()), "recovered": bool(stray)}

    def _damaged(self, part: dict) -> bool:
        try:
            df = self._read(part)
            return self._entry(df.agg(*self._sums(df)).first().asDict()) != {"rows": part["rows"], "digest": part["digest"]}
        except Exception:  # files that are gone or cannot be read
            return True

    def backup(self, to: str) -> dict:
        """A copy of the current version under another path, checked."""
        copy = GraphStore(self.spark, to)
        copy.save(self.load())
        return {"backup": to, "check": copy.check()}

    def compact(self) -> None:
        """Delete manifests and version folders that the current version does not use."""
        m = self._manifest()
        used = {p["path"].split("/")[0] for p in (*m["nodes"], *m["edges"])} | {f"manifest-{m['version']}.json"}
        fs, root = self._fs(self.path)
        for s in fs.listStatus(root):
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

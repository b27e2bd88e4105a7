import io
import json

import pytest

from weftgraph.lang.errors import QueryError
from weftgraph.operators import health
from weftgraph.operators import search as S
from weftgraph.operators.context import context, context_ndjson, context_table, expand, induced_edges, resolve_seeds
from weftgraph.plans.server import ToolServer, serve
from weftgraph.sources import formats
from weftgraph.sources.graph import Graph
from weftgraph.sources.markdown import Vault

DOC = "id bigint, path string, title string, aliases array<string>, tags array<string>, headings array<string>, body string, raw string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "atlas.md", "Project Atlas", ["Atlas Memory"], ["keep"], ["Retrieval notes"], "plain text", "x"),
        (2, "drop.md", "Drop the Project Atlas", [], ["drop"], [], "nothing", "x"),
        (3, "body.md", "Body", None, [], [], "first line\nthe calibrated signal line\nend", "x"),
        (4, "ties/b-second.md", "Stable second", [], [], [], "", "raw only"),
        (5, "ties/a-first.md", "Stable first", [], [], [], None, None),
        (6, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOC)


def hits(df):
    return [(r["path"], r["score"], r["category"]) for r in df.orderBy("rank").collect()]


def test_search_tiers(docs):
    assert hits(S.search(docs, "Project Atlas")) == [("atlas.md", 0, "exact_title_or_path"), ("drop.md", 100, "partial_title_or_path")]
    assert hits(S.search(docs, "Atlas Memory")) == [("atlas.md", 101, "partial_title_or_path"), ("drop.md", 101, "partial_title_or_path")]
    assert hits(S.search(docs, "atlas", ["keep"])) == [("atlas.md", 100, "partial_title_or_path")]
    assert hits(S.search(docs, "calibrated signal")) == [("body.md", 300, "body")]
    assert hits(S.search(docs, "stable tie")) == [("ties/a-first.md", 101, "partial_title_or_path"), ("ties/b-second.md", 101, "partial_title_or_path")]
    assert hits(S.search(docs, "unfindable")) == []
    assert S.search(docs, "calibrated signal").first()["snippet"] == "the calibrated signal line"
    assert S.search(docs, "retrieval").first()["snippet_source"] == "headings"
    top = S.search(docs, "atlas", limit=1).collect()
    assert len(top) == 1 and top[0]["truncated"]
    assert S.semantic_search()["error"]["code"] == "unconfigured"
    assert S.get_document(docs, "project ATLAS").first()["id"] == 1 and S.get_document(docs, "3").first()["id"] == 3
    assert S.get_document(docs, "none").count() == 0


def test_structural_signal(spark, docs):
    inside = spark.createDataFrame([(4, 10, 0.25), (5, 11, 0.25), (1, 10, 0.25)], "doc bigint, dir bigint, weight double")
    parents = spark.createDataFrame([(11, 10)], "child bigint, parent bigint")
    got = {r["id"]: r["signal"] for r in S.structural(S.score(docs, "stable"), inside, parents).collect()}
    assert got == {4: 25, 5: 25}


@pytest.fixture(scope="module")
def ring(spark):
    n = spark.createDataFrame([(i, f"n{i}") for i in range(1, 7)], "id bigint, name string")
    e = spark.createDataFrame([(i, i, i % 5 + 1) for i in range(1, 6)] + [(9, 1, 1), (10, 2, 6)], "id bigint, src bigint, dst bigint")
    return Graph(spark).with_nodes("P", n).with_edges("NEXT", e)


def test_expand(spark, ring):
    seeds = spark.createDataFrame([(1,), (1,), (None,), (77,)], "id bigint")
    nodes, edges = expand(ring, seeds, 2, "out")
    assert {(r["id"], r["depth"]) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 2), (6, 2)}
    assert {(r["id"], r["depth"]) for r in edges.collect()} == {(1, 1), (9, 1), (2, 2), (10, 2)}
    assert expand(ring, seeds, 0)[1].count() == 0
    assert {r["id"] for r in induced_edges(ring, nodes).collect()} == {1, 2, 9, 10}


def test_context_budget(ring):
    out = context(ring, [1], depth=2, max_nodes=2, props=["name"])
    assert [n["node_id"] for n in out["nodes"]] == [1, 2] and out["warnings"] == ["context_budget_truncated"]
    assert [e["edge_id"] for e in out["edges"]] == [1, 9]
    full = context(ring, [1], depth=10, max_nodes=50, props=["name"])
    assert len(full["nodes"]) == 6 and full["warnings"] == [] and len(full["edges"]) == 7
    assert context(ring, [1], depth=1, max_edges=1)["warnings"] == ["context_budget_truncated"]
    with pytest.raises(QueryError) as e:
        context(ring, [99])
    assert e.value.code == "context_seed_not_found"


def test_context_outputs(ring):
    e = context(ring, [1, 1], depth=1, max_nodes=3)
    assert [s["node_ids"] for s in e["seeds"]] == [[1], [1]] and e["retrieval_usage"]["total_payload_bytes"] == len(json.dumps(e).encode())
    assert e["nodes"][0]["display"] == "n1" and e["nodes"][0]["evidence"] == [{"field": "name", "value": "n1", "source": "property:name"}, {"field": "labels", "value": "P", "source": "labels(n)"}]
    assert e["edges"][0]["evidence"][1]["value"] == "seed 1 reached node 2 via out edge at depth 1"
    assert [json.loads(x)["kind"] for x in context_ndjson(e)] == ["context_meta"] + ["context_seed"] * 2 + ["context_node"] * 3 + ["context_edge"] * 3
    assert context_table(e)[2] == ("node", 0, "1", "P", "n1", "", "")
    with pytest.raises(QueryError) as x:
        context(ring, [1], depth=1, max_bytes=200)
    assert x.value.code == "context_payload_too_large"


def test_seeds_beside_a_path_of_very_many_nodes(spark):
    many = spark.range(1, 12_001).selectExpr("id", "'page.md' AS path", "if(id = 11999, ' Current', 'missing') AS status")
    few = spark.createDataFrame([(20_001, "two.md", "current"), (20_002, "two.md", "current"), (20_003, "one.md", "missing"), (20_004, "null.md", None)], "id bigint, path string, status string")
    g = Graph(spark).with_nodes("P", many.unionByName(few).coalesce(1))
    assert resolve_seeds(g, [20_004], ["page.md", "one.md", "null.md"]) == ([20_004, 11_999, 20_003], ["context_seed_duplicate", "context_seed_stale"])
    for path, code in (("two.md", "context_seed_path_ambiguous"), ("no.md", "context_seed_path_not_found")):
        with pytest.raises(QueryError) as e:
            resolve_seeds(g, [], ["page.md", path])
        assert e.value.code == code


def test_health(spark):
    docs = spark.createDataFrame([(1, "r", "a", "md", "h", "current", "t", ["x"], []), (2, "r", "b", "md", "", " Current", "t", ["x"], ["t"]), (3, "r", "c", "md", "h", "missing", None, None, None)], "id bigint, root string, path string, ext string, source_hash string, status string, title string, aliases array<string>, tags array<string>")
    edges = spark.createDataFrame([(1, 1, 1, "md_links_to"), (2, 2, 9, "md_in_directory"), (3, 1, 8, "md_up"), (4, 1, 8, "md_up")], "id bigint, src bigint, dst bigint, etype string")
    assert [r["id"] for r in health.orphan_documents(docs, edges).collect()] == [2]
    assert health.ambiguous_aliases(docs).first()["n_paths"] == 2
    assert {r["id"]: r["missing"] for r in health.missing_metadata(docs).collect()} == {2: ["source_hash"]}
    assert health.duplicate_links(edges).count() == 1
    files = spark.createDataFrame([("r", "a", "other")], "root string, path string, hash string")
    got = {r["check"]: (r["status"], r["value"]) for r in health.report(docs, edges, files, strict=True).collect()}
    assert len(got) == 13 and got["status"] == ("fail", "fail") and got["stale_items"] == ("fail", "3") and got["orphan_items"] == ("fail", "1") and got["recovered_tail"] == ("pass", "false")
    assert health.strict_exit(health.report(docs, edges, files, strict=True)) == 2 and health.strict_exit(health.report(docs, edges, files)) == 0
    assert {(r["id"], r["kind"]) for r in health.stale_documents(docs, files).collect()} == {(1, "hash_mismatch"), (2, "metadata_incomplete"), (3, "tombstoned_document")}
    a = spark.createDataFrame([("k1", "x"), ("k2", "x")], "key string, v string")
    b = spark.createDataFrame([("k2", "y"), ("k3", None)], "key string, v string")
    assert {tuple(r) for r in health.snapshot_diff(a, b, ["v"]).collect()} == {("k1", "removed"), ("k2", "changed"), ("k3", "added")}
    assert health.report(docs.limit(0), edges.limit(0), files.limit(0)).where("status <> 'pass'").count() == 0
    audit = health.citation_audit_context(spark, {"nodes": [{"node_id": 1, "properties": {"path": "a", "status": "current"}}]})
    assert audit.first()["failures"] == ["source_hash"]


def test_formats(spark):
    df = spark.createDataFrame([(1, "a" * 80, float("nan"), bytearray(b"x"))], "i bigint, s string, f double, b binary")
    table = formats.as_table(df)
    assert table.splitlines()[0].startswith("i | s") and "..." in table
    out = json.loads(formats.as_json([df, spark.range(5)], cap=3))
    assert out["results"][0]["rows"][0][2] == "NaN" and out["results"][1]["truncated"] and out["results"][1]["row_count"] == 3
    assert [json.loads(x)["kind"] for x in formats.as_ndjson([spark.range(2)]).splitlines()] == ["meta", "result", "row", "row"]
    assert formats.params('{"a": 1}') == {"a": 1}


def test_tool_server(spark, tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    (root / "a.md").write_text("# Alpha\n[[b]]")
    (root / "b.md").write_text("# Beta\nneedle here")
    v = Vault(spark)
    v.sync(str(root), True)
    server = ToolServer(v, str(root))
    out = io.StringIO()
    call = lambda i, name, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}})
    lines = [
        json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "method": "notify"}), "oops", json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/list"}),
        call(3, "search", query="needle"), call(4, "get", key="alpha"), call(5, "context", paths=["a.md"], depth=1), call(6, "nope"), call(7, "search", query="x", mode="semantic"),
        call(8, "add_note", path="../x.md", body="y"), call(9, "add_note", path="n/c.md", body="new needle", title="C"), call(10, "search", query="needle"), json.dumps({"jsonrpc": "2.0", "id": 11, "method": "resources/read", "params": {"uri": "note:///b.md"}}),
    ]
    serve(server, lines, out)
    got = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    body = lambda i: json.loads(got[i]["result"]["content"][0]["text"])
    assert len(got[2]["result"]["tools"]) == 5 and got[None]["error"]["code"] == -32700
    assert [x["path"] for x in body(3)["items"]] == ["b.md"] and body(4)["document"]["path"] == "a.md"
    assert {n["properties"]["path"] for n in body(5)["nodes"]} == {"a.md", "b.md", "."} and got[6]["error"]["code"] == -32601
    assert body(7)["error"]["code"] == "unconfigured" and body(8)["error"]["code"] == "invalid_path"
    assert body(9)["ok"] and {x["path"] for x in body(10)["items"]} == {"b.md", "n/c.md"} and "needle" in got[11]["result"]["contents"][0]["text"]

"""The command line over a small store and a folder of notes."""

import io
import json

import pytest

from weftgraph import __main__ as cli
from weftgraph.plans.session import GraphSession


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("cli")
    notes = home / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("---\naliases: [Start]\n---\n# Alpha\n[[b]]")
    (notes / "b.md").write_text("# Beta\n")
    (notes / "c.md").write_text("# Alone\n")
    (home / "weftgraph.toml").write_text('db_path = "g"\n[markdown]\nmarkdown_root = "notes"\n')
    s = GraphSession(spark)
    s.query("CREATE (p:Person {name: 'Mara', born: 1990})-[k:KNOWS {since: 2011}]->(q:Person {name: 'Ion'})")
    s.save_as(f"file://{home}/g")
    return home


def run(capsys, *argv, code=0):
    assert cli.main([str(a) for a in argv]) == code
    return capsys.readouterr().out


def test_query_and_context(place, capsys):
    store = f"file://{place}/g"
    out = run(capsys, "query", store, "MATCH (p:Person) WHERE p.born > $y RETURN p.name AS name", "--params-json", '{"y": 1980}')
    assert out.splitlines() == ["name", "----", "Mara"]
    assert json.loads(run(capsys, "query", store, "MATCH (p:Person) RETURN p.name AS name", "--format", "json", "--max-rows", 1))["results"][0]["truncated"]
    both = run(capsys, "query", store, "MATCH (n) WITH labels(n)[0] AS label RETURN label AS label, count(*) AS n", "--with-md", place / "notes")
    assert {" ".join(x.split()) for x in both.splitlines()[2:]} == {"MarkdownDocument | 3", "Person | 2", "MarkdownDirectory | 1"}
    assert [json.loads(x)["kind"] for x in run(capsys, "context", store, "--node", 1, "--format", "ndjson").splitlines()] == ["context_meta", "context_seed", "context_node", "context_node", "context_edge"]
    assert "seed:node" in run(capsys, "context", store, "--node", 1)
    run(capsys, "context", store, "--node", 99, code=1)


def test_sync_and_memory(place, capsys):
    store = f"file://{place}/g"
    config = ("--config", place / "weftgraph.toml")
    report = json.loads(run(capsys, *config, "sync", "--store", store))
    assert report["scanned"] == 3 and report["resolved"] == 1
    assert run(capsys, "memory", "find-orphans", store).splitlines()[2:] == ["c.md | Alone | current"]
    (place / "notes" / "b.md").write_text("# Changed\n")
    (place / "notes" / "c.md").unlink()
    stale = run(capsys, *config, "memory", "find-stale", store)
    assert "b.md | hash_mismatch" in stale and "c.md | missing_file" in stale
    out = run(capsys, "memory", "check", store, "--strict", code=2)
    assert "missing_tombstoned_markdown_documents" in out and "| fail" in out
    assert run(capsys, "memory", "reindex", store).startswith("name")
    run(capsys, "source", "set-root", store, "/elsewhere")
    up = json.loads(run(capsys, "upgrade", store))
    assert up["check"]["ok"] and up["stored"]["ok"]
    assert json.loads(run(capsys, "check", store))["ok"]
    run(capsys, "compact", store)
    assert "MarkdownDocument" in run(capsys, "schema", store)


def test_lines_of_statements(place, spark, capsys):
    s = GraphSession.open(spark, f"file://{place}/g")
    cli._repl(s, io.StringIO("RETURN 1 AS one\nRETURN nope\n\n.quit\nRETURN 2 AS two\n"))
    out = capsys.readouterr().out
    assert "one" in out and "unknown_variable" in out and "two" not in out

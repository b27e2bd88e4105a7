"""Schema statements, errors, store, result formats and tools, with DuckDB counterparts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftgraph.lang.errors import QueryError
from weftgraph.lang.parser import parse
from weftgraph.plans.compiler import Compiler
from weftgraph.plans.retrieval_queries import _docs, _score_sql
from weftgraph.plans.server import ToolServer
from weftgraph.plans.session import GraphSession
from weftgraph.session import Scratch
from weftgraph.sources import formats
from weftgraph.sources.markdown import Vault
from weftgraph.sources.store import GraphStore
from weftgraph.sources.tables import tidy
from weftgraph.sources.views import star_graph, vault_graph

_REGIONS = "MATCH (r:Region) RETURN count(*) AS n"

#: name: (scripts that may fail, query shown afterwards, SQL); the codes of the failures are a column.
FAILURES: dict[str, tuple] = {
    "error_duplicate_column": (["MATCH (r:Region) RETURN r.r_name AS a, r.r_regionkey AS a"], _REGIONS, "duplicate_column"),
    "error_unknown_variable": (["MATCH (r:Region) WHERE nope.x = 1 RETURN r.r_name"], _REGIONS, "unknown_variable"),
    "error_nested_aggregate": (["MATCH (r:Region) RETURN count(*) + 1 AS a", "MATCH (r:Region) RETURN sum(count(*)) AS a"], _REGIONS, "function_error,function_error"),
    "error_script_rule": (["CREATE (a:T {v: 1}); CREATE (b:T {v: 2})"], _REGIONS, "multi_statement_requires_transaction"),
    "error_label_in_use": (["DROP LABEL Region", "DROP EDGE TYPE IN_REGION", "DROP LABEL Missing", "DROP IF EXISTS LABEL Missing"], _REGIONS, "label_in_use,edge_type_in_use,unknown_label,"),
    "error_type_constraint": (["CREATE CONSTRAINT ON :Region REQUIRE r_name TYPE int", "CREATE CONSTRAINT ON :Region REQUIRE r_name TYPE string"], _REGIONS, "constraint_type_violation,"),
    "error_mixed_types": (["CREATE (t:Nation {n_name: 7})", "MATCH (n:Nation) RETURN n.n_name AS name"], _REGIONS, "property_type_conflict,"),
    "error_division": (["MATCH (r:Region) RETURN 1 / r.r_regionkey AS q"], _REGIONS, ""),
    "failed_transaction": (["BEGIN; MATCH (r:Region) DELETE r; RETURN nope", "MATCH (r:Region) RETURN r.r_name", "COMMIT", "ROLLBACK"], _REGIONS, "unknown_variable,transaction_failed,transaction_failed,"),
    "commit_stays_open": (["CREATE CONSTRAINT ON :Region REQUIRE r_name UNIQUE", "BEGIN; CREATE (r:Region {r_name: 'ASIA', r_regionkey: 9}); COMMIT", "ROLLBACK"], _REGIONS, ",constraint_unique_violation,"),
}


def _failure(name: str):
    scripts, show, _ = FAILURES[name]

    def run(spark, d):
        s, codes = GraphSession(spark, star_graph(spark, d)), []
        for script in scripts:
            try:
                s.execute(script)
                codes.append("")
            except QueryError as e:
                codes.append(e.code)
        return s.query(show).withColumn("codes", F.lit(",".join(codes)))

    run.__name__ = name
    return run


def row_guard(spark, d):
    """The optional bound on the rows of a MATCH, just met and just passed."""
    q = parse("MATCH (n:Nation) RETURN n.n_nationkey AS k")[0]
    most = Compiler(star_graph(spark, d), {}).run(q).count()
    try:
        Compiler(star_graph(spark, d), {}, max_rows=most - 1).run(q)
        code = ""
    except QueryError as e:
        code = e.code
    return Compiler(star_graph(spark, d), {}, max_rows=most).run(q).withColumn("code", F.lit(code))


#: name: (statements, SHOW, SQL)
SCHEMA: dict[str, tuple] = {
    "create_index": (["CREATE INDEX by_name ON :Nation(n_name) KIND RANGE", "CREATE IF NOT EXISTS INDEX by_name ON :Nation(n_name) KIND RANGE", "CREATE INDEX ON [:PLACED](priority) KIND EQ"], "SHOW INDEXES",
        """SELECT * FROM (VALUES ('by_name', 'label', 'Nation', 'n_name', false, 'ready', 'range'), ('idx_edge_type_PLACED_priority', 'edge_type', 'PLACED', 'priority', false, 'ready', 'eq'),
        ('idx_label_Customer_c_acctbal', 'label', 'Customer', 'c_acctbal', false, 'ready', 'range'), ('idx_label_Customer_c_custkey', 'label', 'Customer', 'c_custkey', false, 'ready', 'eq'), ('idx_label_Part_p_name', 'label', 'Part', 'p_name', false, 'ready', 'fulltext'))
        t(name, target_kind, target_name, property, "unique", status, kind)"""),
    "alter_drop_index": (["ALTER INDEX idx_label_Part_p_name SET STATUS invalid", "DROP INDEX idx_label_Customer_c_custkey", "DROP IF EXISTS INDEX nothing"], "SHOW INDEXES",
        """SELECT * FROM (VALUES ('idx_label_Customer_c_acctbal', 'label', 'Customer', 'c_acctbal', false, 'ready', 'range'), ('idx_label_Part_p_name', 'label', 'Part', 'p_name', false, 'invalid', 'fulltext')) t(name, target_kind, target_name, property, "unique", status, kind)"""),
    "rename_constraint": (["CREATE CONSTRAINT one ON :Region REQUIRE r_name UNIQUE", "CREATE CONSTRAINT two ON :Region REQUIRE r_name REQUIRED", "ALTER CONSTRAINT one RENAME TO uno", "DROP CONSTRAINT two"], "SHOW CONSTRAINTS",
        "SELECT 'uno' AS name, 'label' AS target_kind, 'Region' AS target_name, 'r_name' AS property, 'unique' AS constraint_type, '' AS details"),
    "drop_objects": (["CREATE LABEL Spare", "CREATE EDGE TYPE SPARE_EDGE", "DROP LABEL Spare", "CREATE OR REPLACE EDGE TYPE SPARE_EDGE DESCRIPTION 'kept'"], "SHOW SCHEMA",
        """SELECT 'label' AS kind, l AS name, NULL AS description, 'CREATE LABEL ' || l AS ddl FROM (SELECT unnest(['Customer', 'Event', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'User']) AS l)
        UNION ALL SELECT 'edge_type', t, CASE WHEN t = 'SPARE_EDGE' THEN 'kept' END, 'CREATE EDGE TYPE ' || t || CASE WHEN t = 'SPARE_EDGE' THEN ' DESCRIPTION ' || chr(39) || 'kept' || chr(39) ELSE '' END FROM (SELECT unnest(['DID', 'IN_NATION', 'IN_REGION', 'PLACED', 'SPARE_EDGE']) AS t)
        UNION ALL SELECT 'index', 'idx_label_' || l || '_' || p, NULL, 'CREATE INDEX idx_label_' || l || '_' || p || ' ON :' || l || '(' || p || ') KIND ' || k
        FROM (VALUES ('Customer', 'c_custkey', 'EQ'), ('Customer', 'c_acctbal', 'RANGE'), ('Part', 'p_name', 'FULLTEXT')) v(l, p, k)"""),
}


def _schema(name: str):
    statements, show, _ = SCHEMA[name]

    def run(spark, d):
        s = GraphSession(spark, star_graph(spark, d))
        for x in statements:
            s.execute(x)
        return s.query(show)

    run.__name__ = name
    return run


def _stored(spark, d) -> GraphSession:
    """A session with a store of three versions: saved, changed, changed again."""
    s = GraphSession(spark, star_graph(spark, d))
    s.save_as(Scratch(spark, "store").folder() + "/graph")
    s.query("MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n.seen = true")
    s.query("MATCH (n:Nation) WHERE n.n_regionkey = 3 DELETE n")
    return s


def store_reopen(spark, d):
    """The last version read back by another session."""
    s = GraphSession.open(spark, _stored(spark, d).store.path)
    return s.query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_nationkey AS k, n.seen AS seen, r.r_name AS region")


def store_versions(spark, d):
    """Every version is still there; a kept part is not written again."""
    store = _stored(spark, d).store
    rows = [(v, store.load(v).tx, len({p["path"].split("/")[0] for p in (*store._manifest(v)["nodes"], *store._manifest(v)["edges"])})) for v in store.versions()]
    return spark.createDataFrame(rows, "version bigint, tx bigint, folders bigint")


def store_check(spark, d):
    """Integrity as it is, after damage, and of a backup."""
    store = _stored(spark, d).store
    good, copy = store.check(), store.backup(Scratch(spark, "store").folder() + "/backup")["check"]
    part = store._manifest()["nodes"][0]["path"]
    spark.range(3).selectExpr("id", "'x' AS r_name").write.mode("append").parquet(f"{store.path}/{part}")
    bad = store.check()
    rows = [(k, c["ok"], c["version"], len(c["damaged"])) for k, c in (("stored", good), ("backup", copy), ("damaged", bad))]
    return spark.createDataFrame(rows, "what string, ok boolean, version bigint, n_damaged bigint")


def store_compact(spark, d):
    """One version is left, and it reads as before."""
    s = _stored(spark, d)
    s.compact()
    return GraphSession.open(spark, s.store.path).query("MATCH (n:Nation) RETURN n.n_nationkey AS k").withColumn("n_versions", F.lit(len(GraphStore(spark, s.store.path).versions())).cast("bigint"))


_TOP = "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 12 RETURN c.c_custkey AS k, c.c_name AS name, c.c_acctbal AS bal"


def _rows(spark, d):
    return GraphSession(spark, star_graph(spark, d)).query(_TOP)


def sink_table(spark, d):
    lines = formats.as_table(_rows(spark, d), None).splitlines()
    cells = [[c.strip() for c in line.split(" | ")] for line in (lines[0], *lines[2:])]
    return spark.createDataFrame([tuple(c) for c in cells[1:]], ", ".join(f"{c} string" for c in cells[0])).select(F.col("k").cast("bigint").alias("k"), "name")


def sink_json(spark, d):
    """The envelope with a cap: as many rows as it, and the mark that there are more."""
    e = json.loads(formats.as_json([_rows(spark, d)], cap=5))
    r = e["results"][0]
    return spark.createDataFrame([(row[0], row[1], row[2], r["row_count"], r["truncated"]) for row in r["rows"]], "k bigint, name string, bal double, row_count bigint, truncated boolean")


def sink_ndjson(spark, d):
    lines = [json.loads(x) for x in formats.as_ndjson([_rows(spark, d)], cap=None).splitlines()]
    return spark.createDataFrame([tuple(x["values"]) for x in lines if x["kind"] == "row"], "k bigint, name string, bal double")


def value_json(spark, d):
    """Values as JSON: whole and broken numbers, bytes, times, lists and maps."""
    row = GraphSession(spark, star_graph(spark, d)).query("RETURN 1 AS i, 2.5 AS f, 'é' AS s, b'ab' AS b, datetime'2024-01-02T03:04:05Z' AS t, [1, 2] AS l, {k: 'v'} AS m, null AS z")
    e = json.loads(formats.as_json([row]))["results"][0]
    return spark.createDataFrame([(c, json.dumps(v, ensure_ascii=False, sort_keys=True)) for c, v in zip(e["columns"], e["rows"][0])], "name string, value string")


def params_json(spark, d):
    """Parameters of every JSON type in a query."""
    p = formats.params('{"least": 100, "names": ["ASIA", "EUROPE"], "on": true, "none": null, "m": {"k": 2}}')
    q = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name IN $names AND $on AND n.n_nationkey < $least RETURN n.n_nationkey * $m.k AS twice, $none IS NULL AS nothing"
    return GraphSession(spark, star_graph(spark, d)).query(q, p)


def config_root(spark, d):
    """The folder of notes: set twice in the graph, and found in order of precedence."""
    s = GraphSession(spark, star_graph(spark, d))
    before = s.resolve_root(default="/default")
    s.set_root("/one")
    s.set_root("/two")
    found = [("default", before), ("graph", s.resolve_root(default="/default")), ("settings", s.resolve_root(None, {"markdown_root": "/file"}, "/default")), ("flag", s.resolve_root("/flag", {"markdown_root": "/file"}))]
    nodes = s.query("MATCH (c:SystemConfig) RETURN count(*) AS n").first()[0]
    return spark.createDataFrame([(k, v, nodes) for k, v in found], "source string, root string, n_nodes bigint")


def tool_search(spark, d):
    """A search over the tool protocol, one request line in and one answer out."""
    docs = _docs(spark, d).where(tidy("status") == "current").withColumn("status", F.lit("current"))
    server = ToolServer(Vault(spark, docs=docs, edges=spark.createDataFrame([], "src bigint, dst bigint, type string, edge_weight double")))
    line = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "budget", "limit": 15}}})
    items = json.loads(json.loads(server.handle(line))["result"]["content"][0]["text"])["items"]
    return spark.createDataFrame([(i["rank"], i["id"], i["score"]) for i in items], "rank bigint, id bigint, score bigint")


def overlay_graphs(spark, d):
    """Two graphs laid over each other for one query; both stay as they are."""
    both = star_graph(spark, d).overlay(vault_graph(spark, d, ()))
    q = parse("MATCH (n) WITH labels(n)[0] AS label WHERE label IN ['MarkdownDocument', 'Region', 'Part'] RETURN label AS label, count(*) AS n")[0]
    return Compiler(both, {}).run(q)


QUERIES = {name: _failure(name) for name in FAILURES} | {name: _schema(name) for name in SCHEMA} | {f.__name__: f for f in (
    row_guard, store_reopen, store_versions, store_check, store_compact, sink_table, sink_json, sink_ndjson, value_json, params_json, config_root, tool_search, overlay_graphs,
)}

_TOP_SQL = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT "
SQL = {name: f"SELECT count(*) AS n, '{codes}' AS codes FROM region" for name, (_, _, codes) in FAILURES.items()} | {name: sql for name, (_, _, sql) in SCHEMA.items()} | {
    "row_guard": "SELECT n_nationkey::BIGINT AS k, 'row_limit_exceeded' AS code FROM nation",
    "store_reopen": "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 2 THEN true END AS seen, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 3",
    "store_versions": "SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 1::BIGINT), (2, 1, 2), (3, 2, 2)) t(version, tx, folders)",
    "store_check": "SELECT * FROM (VALUES ('stored', true, 3::BIGINT, 0::BIGINT), ('backup', true, 1, 0), ('damaged', false, 3, 1)) t(what, ok, version, n_damaged)",
    "store_compact": "SELECT n_nationkey::BIGINT AS k, 1::BIGINT AS n_versions FROM nation WHERE n_regionkey <> 3",
    "sink_table": f"SELECT k, name FROM ({_TOP_SQL} 12)",
    "sink_json": f"SELECT k, name, bal, 5::BIGINT AS row_count, true AS truncated FROM ({_TOP_SQL} 5)",
    "sink_ndjson": f"{_TOP_SQL} 12",
    "value_json": """SELECT unnest(['i', 'f', 's', 'b', 't', 'l', 'm', 'z']) AS name, unnest(['1', '2.5', '"é"', '"b' || chr(39) || 'ab' || chr(39) || '"', '"2024-01-02T03:04:05Z"', '[1, 2]', '{"k": "v"}', 'null']) AS value""",
    "params_json": "SELECT n_nationkey::BIGINT * 2 AS twice, true AS nothing FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey < 100",
    "config_root": "SELECT * FROM (VALUES ('default', '/default', 1::BIGINT), ('graph', '/two', 1), ('settings', '/file', 1), ('flag', '/flag', 1)) t(source, root, n_nodes)",
    "tool_search": _score_sql("budget", "lower(trim(status)) = 'current'") + " SELECT row_number() OVER (ORDER BY score, path) AS rank, id, score FROM sc ORDER BY score, path LIMIT 15",
    "overlay_graphs": """WITH d AS (SELECT DISTINCT id FROM md_documents WHERE id IS NOT NULL) SELECT 'MarkdownDocument' AS label, count(*) AS n FROM d UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Part', count(*) FROM part""",
}

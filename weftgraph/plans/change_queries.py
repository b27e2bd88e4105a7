"""Queries that change a graph or describe its schema, with DuckDB counterparts."""

from __future__ import annotations

from weftgraph.plans.session import GraphSession
from weftgraph.sources.views import star_graph, vault_graph

#: name: (graph, script, query that shows the outcome, SQL)
STEPS: dict[str, tuple] = {
    "merge_shared_nodes": (star_graph, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (h:Hub {name: r.r_name})", "MATCH (h:Hub) RETURN h.name AS name", "SELECT r_name AS name FROM region"),
    "merge_keeps_matches": (star_graph, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (n)-[e:IN_REGION]->(r)", "MATCH (a)-[e:IN_REGION]->(b) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation"),
    "create_pattern": (star_graph, "MATCH (s:Supplier) WHERE s.s_acctbal < 0.0 CREATE (s)-[w:WATCHED {since: 2024}]->(a:Alert {bal: s.s_acctbal, kind: 'debt'})",
        "MATCH (s:Supplier)-[w:WATCHED]->(a:Alert) RETURN s.s_suppkey AS k, w.since AS since, a.bal AS bal", "SELECT s_suppkey AS k, 2024::BIGINT AS since, s_acctbal AS bal FROM supplier WHERE s_acctbal < 0"),
    "set_properties": (star_graph, "MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n.twice = n.n_nationkey * 2, n += {seen: true}",
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.twice IS NULL AS left_out, n.seen = true AND n.twice = n.n_nationkey + n.n_nationkey AS patched", "SELECT n_nationkey::BIGINT AS k, n_regionkey <> 2 AS left_out, CASE WHEN n_regionkey = 2 THEN true END AS patched FROM nation"),
    "set_list_element": (vault_graph, "MATCH (d:MarkdownDocument) WHERE size(d.tags) > 2 SET d.tags[1] = 'patched'", "MATCH (d:MarkdownDocument) WHERE d.tags CONTAINS 'patched' RETURN id(d) AS doc, size(d.tags) AS n",
        """SELECT id AS doc, len(tags)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY synced_at DESC NULLS LAST, loaded_at DESC) AS rn FROM md_documents) t WHERE rn = 1 AND len(tags) > 2"""),
    "remove_property": (star_graph, "MATCH (n:Nation) WHERE n.n_regionkey = 1 REMOVE n.n_name", "MATCH (n:Nation) WHERE n.n_name IS NULL RETURN n.n_nationkey AS k", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey = 1"),
    "remove_label": (star_graph, "MATCH (n:Nation) WHERE n.n_regionkey = 1 REMOVE n:Nation", "MATCH (n:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 1"),
    "delete_cascade": (star_graph, "MATCH (n:Nation) WHERE n.n_regionkey = 3 DELETE n", "MATCH (x)-[e:IN_NATION]->(n) RETURN labels(x)[0] AS label, count(*) AS n",
        """SELECT 'Customer' AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3
        UNION ALL SELECT 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 3"""),
    "delete_edges": (star_graph, "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' DELETE e", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1"),
    "read_after_delete": (star_graph, None, "MATCH (r:Region) WHERE r.r_regionkey < 2 DELETE r RETURN id(r) AS i, r.r_name IS NULL AS gone, size(labels(r)) AS n", "SELECT r_regionkey::BIGINT AS i, true AS gone, 0::BIGINT AS n FROM region WHERE r_regionkey < 2"),
    "transaction_rollback": (star_graph, "BEGIN; MATCH (r:Region) DELETE r; ROLLBACK", "MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region"),
    "savepoints": (star_graph, "BEGIN; CREATE (a:T {v: 1}); SAVEPOINT s; CREATE (b:T {v: 2}); ROLLBACK TO SAVEPOINT s; CREATE (c:T {v: 3}); RELEASE SAVEPOINT s; COMMIT", "MATCH (t:T) RETURN t.v AS v", "SELECT unnest([1, 3])::BIGINT AS v"),
    "show_stats": (star_graph, "CREATE LABEL Extra DESCRIPTION 'none yet'", "SHOW STATS",
        """SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part)
        + (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) AS node_count, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS edge_count,
        9::BIGINT AS label_count, 4::BIGINT AS edge_type_count, 3::BIGINT AS index_count, 0::BIGINT AS constraint_count, 1::BIGINT AS last_tx_id, 0::BIGINT AS wal_bytes"""),
    "show_schema": (star_graph, "CREATE LABEL Extra DESCRIPTION 'none yet'", "SHOW SCHEMA",
        """SELECT 'label' AS kind, l AS name, CASE WHEN l = 'Extra' THEN 'none yet' END AS description, 'CREATE LABEL ' || l || CASE WHEN l = 'Extra' THEN ' DESCRIPTION ' || chr(39) || 'none yet' || chr(39) ELSE '' END AS ddl
        FROM (SELECT unnest(['Customer', 'Event', 'Extra', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'User']) AS l)
        UNION ALL SELECT 'edge_type', t, NULL, 'CREATE EDGE TYPE ' || t FROM (SELECT unnest(['DID', 'IN_NATION', 'IN_REGION', 'PLACED']) AS t)
        UNION ALL SELECT 'index', 'idx_label_' || l || '_' || p, NULL, 'CREATE INDEX idx_label_' || l || '_' || p || ' ON :' || l || '(' || p || ') KIND ' || k
        FROM (VALUES ('Customer', 'c_custkey', 'EQ'), ('Customer', 'c_acctbal', 'RANGE'), ('Part', 'p_name', 'FULLTEXT')) v(l, p, k)"""),
    "show_indexes": (star_graph, "CREATE CONSTRAINT ON :Customer REQUIRE c_custkey UNIQUE", "SHOW INDEXES ON :Customer",
        """SELECT * FROM (VALUES ('idx_label_Customer_c_custkey', 'label', 'Customer', 'c_custkey', false, 'ready', 'eq'), ('idx_label_Customer_c_custkey_unique', 'label', 'Customer', 'c_custkey', true, 'ready', 'eq'),
        ('idx_label_Customer_c_acctbal', 'label', 'Customer', 'c_acctbal', false, 'ready', 'range')) t(name, target_kind, target_name, property, "unique", status, kind)"""),
    "show_constraints": (star_graph, "CREATE CONSTRAINT one ON [:IN_REGION] REQUIRE MAX OUTGOING 1", "SHOW CONSTRAINTS",
        "SELECT 'one' AS name, 'edge_type' AS target_kind, 'IN_REGION' AS target_name, '' AS property, 'max_outgoing' AS constraint_type, '1' AS details"),
    "show_transactions": (star_graph, "BEGIN", "SHOW TRANSACTIONS", "SELECT true AS active, false AS failed, 0::BIGINT AS savepoints, 0::BIGINT AS last_tx_id"),
    "explain_seek": (star_graph, None, "EXPLAIN MATCH (c:Customer {c_custkey: 7}) WHERE c.c_acctbal > 1.0 RETURN c.c_name ORDER BY c.c_name LIMIT 3",
        """SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT, 'Query', ''), (2, 1, 'NodeIndexSeek', ':Customer(c_custkey = 7)'), (3, 1, 'Filter', 'WHERE'), (4, 1, 'Project', 'RETURN'), (5, 1, 'Order', 'ORDER BY'), (6, 1, 'Limit', 'LIMIT'))
        t(id, parent_id, operator, detail)"""),
    "explain_range": (star_graph, None, "EXPLAIN MATCH (c:Customer) WHERE c.c_acctbal > 10.0 AND 500.0 >= c.c_acctbal RETURN count(*)",
        "SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT, 'Query', ''), (2, 1, 'NodeIndexRangeScan', ':Customer(c_acctbal > 10.0 AND <= 500.0)'), (3, 1, 'Filter', 'WHERE'), (4, 1, 'Project', 'RETURN')) t(id, parent_id, operator, detail)"),
}


def _steps(name: str):
    graph, script, show, _ = STEPS[name]

    def run(spark, d):
        s = GraphSession(spark, graph(spark, d))
        if script:
            s.execute(script)
        return s.query(show)

    run.__name__ = name
    return run


QUERIES = {name: _steps(name) for name in STEPS}
SQL = {name: sql for name, (_, _, _, sql) in STEPS.items() if sql}

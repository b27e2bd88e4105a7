"""Queries of the graph language over the tables, with DuckDB counterparts."""

from __future__ import annotations

from weftgraph.lang import ast
from weftgraph.lang.parser import parse
from weftgraph.plans.compiler import Compiler
from weftgraph.sources.views import SHIFT, VAULT_TYPES, star_graph, vault_graph

B = SHIFT


def _nid(k: int, key: str) -> str:
    return f"({k}::BIGINT * {B} + {key}::BIGINT)"


_E = f"""
inn AS (SELECT 2::BIGINT * {B} + c_custkey AS id, {_nid(2, 'c_custkey')} AS src, {_nid(1, 'c_nationkey')} AS dst, c_acctbal AS weight FROM customer
        UNION ALL SELECT 3::BIGINT * {B} + s_suppkey, {_nid(3, 's_suppkey')}, {_nid(1, 's_nationkey')}, s_acctbal FROM supplier),
inr AS (SELECT 1::BIGINT * {B} + n_nationkey AS id, {_nid(1, 'n_nationkey')} AS src, {_nid(0, 'n_regionkey')} AS dst FROM nation)"""

_VAULT = """
doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY synced_at DESC NULLS LAST, loaded_at DESC) AS rn FROM md_documents) t WHERE rn = 1),
edge AS (
  SELECT id, any_value(src) AS src, any_value(dst) AS dst, any_value(lower(trim(edge_type))) AS t, any_value(edge_weight) AS edge_weight FROM graph_edges
  WHERE lower(trim(status)) = 'current' AND valid_to IS NULL GROUP BY id),
node AS (SELECT id FROM doc UNION SELECT id FROM md_directories)"""


def _hops_sql(low: int, high: int, start: str, edges: str, both: bool = False) -> str:
    """Levels with a deduplicated frontier; results count edges from it."""
    e = f"SELECT src AS a, dst AS b FROM ({edges})"
    if both:
        e = f"SELECT src AS a, dst AS b FROM ({edges}) UNION ALL SELECT dst, src FROM ({edges}) WHERE src <> dst"
    parts = [f"e AS ({e})", f"f0 AS ({start})"]
    for k in range(1, high + 1):
        parts.append(f"s{k} AS (SELECT f.rid, e.b AS node FROM f{k - 1} f JOIN e ON e.a = f.node JOIN node n ON n.id = e.b)")
        parts.append(f"f{k} AS (SELECT DISTINCT rid, node FROM s{k})")
    hits = " UNION ALL ".join(f"SELECT rid, node, {k} AS hop FROM s{k}" for k in range(max(low, 1), high + 1))
    return ", ".join(parts) + f", hit AS ({hits})"


_LINKS = "SELECT src, dst FROM edge WHERE t = 'md_links_to'"
_UPS = "SELECT src, dst FROM edge WHERE t IN ('md_up', 'md_next')"
_START = "SELECT id AS rid, id AS node FROM doc WHERE has_frontmatter"

#: name: (graph, query, parameters, SQL)
TEXTS: dict[str, tuple] = {
    "flagship": (star_graph, """MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' AND c.c_acctbal > 0.0
        RETURN c.c_name AS customer, n.n_name AS nation, c.c_acctbal AS acctbal ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20""", {},
        """SELECT c_name AS customer, n_name AS nation, c_acctbal AS acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20"""),
    "scan_label": (star_graph, "MATCH (c:Customer) RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM customer"),
    "scan_all_counts": (star_graph, "MATCH (x) WITH labels(x) AS ls, count(*) AS n RETURN ls[0] AS label, n AS n", {},
        """SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
        UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part
        UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events"""),
    "index_seek_eq": (star_graph, "MATCH (c:Customer {c_custkey: $key}) RETURN c.c_name AS name, c.c_acctbal AS bal", {"key": 42},
        "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42"),
    "index_range": (star_graph, "MATCH (c:Customer) WHERE c.c_acctbal >= 1000.0 AND c.c_acctbal < 2000.0 RETURN c.c_custkey AS k", {},
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000"),
    "bound_fold": (star_graph, "MATCH (c:Customer) WHERE c.c_acctbal > 10.0 AND 500.0 < c.c_acctbal AND c.c_acctbal <= 900.0 AND c.c_acctbal < 9000.0 RETURN count(*) AS n", {},
        "SELECT count(*) AS n FROM customer WHERE c_acctbal > 500 AND c_acctbal <= 900"),
    "list_membership": (vault_graph, "MATCH (d:MarkdownDocument) WHERE 'budget' IN d.tags AND d.tags CONTAINS 'roadmap' RETURN id(d) AS doc, size(d.tags) AS n", {},
        f"WITH {_VAULT} SELECT id AS doc, len(tags)::BIGINT AS n FROM doc WHERE list_contains(tags, 'budget') AND list_contains(tags, 'roadmap')"),
    "fulltext_contains": (star_graph, "MATCH (p:Part) WHERE p.p_name CONTAINS 'a' AND 'e' IN p.p_name RETURN p.p_partkey AS k", {},
        "SELECT p_partkey AS k FROM part WHERE contains(p_name, 'a') AND contains(p_name, 'e')"),
    "expand_out": (star_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' RETURN c.c_name AS customer, o.o_orderkey AS k", {},
        "SELECT c_name AS customer, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"),
    "expand_in": (star_graph, "MATCH (n:Nation)<-[e:IN_NATION]-(c:Customer) RETURN n.n_name AS nation, id(e) AS eid, e.weight AS w", {},
        f"SELECT n_name AS nation, 2::BIGINT * {B} + c_custkey AS eid, c_acctbal AS w FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "expand_both": (vault_graph, "MATCH (a:MarkdownDocument)-[e:MD_LINKS_TO]-(b:MarkdownDocument) RETURN id(a) AS a, id(e) AS e, id(b) AS b", {},
        f"""WITH {_VAULT}, l AS (SELECT * FROM edge WHERE t = 'md_links_to'), b AS (SELECT id, src, dst FROM l UNION ALL SELECT id, dst, src FROM l WHERE src <> dst)
        SELECT b.src AS a, b.id AS e, b.dst AS b FROM b JOIN doc x ON x.id = b.src JOIN doc y ON y.id = b.dst"""),
    "edge_alternation": (vault_graph, "MATCH (a)-[e:MD_RELATED|MD_NEXT|MD_PREVIOUS]->(b) RETURN edge_type(e) AS kind, count(*) AS n", {},
        f"WITH {_VAULT} SELECT upper(t) AS kind, count(*) AS n FROM edge JOIN node a ON a.id = src JOIN node b ON b.id = dst WHERE t IN ('md_related', 'md_next', 'md_previous') GROUP BY t"),
    "node_props_map": (star_graph, "MATCH (o:Order {o_orderstatus: 'O', o_orderpriority: '1-URGENT'}) RETURN count(*) AS n", {},
        "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"),
    "edge_props_map": (star_graph, "MATCH (c:Customer)-[:PLACED {priority: '2-HIGH'}]->(o) RETURN id(c) AS c, count(*) AS n", {},
        f"SELECT {_nid(2, 'o_custkey')} AS c, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '2-HIGH' GROUP BY o_custkey"),
    "cycle_same_nation": (star_graph, "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier)-[:IN_NATION]->(n) RETURN n.n_name AS nation, count(*) AS n", {},
        "SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "reuse_edge_homomorphism": (star_graph, "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Supplier) RETURN id(a) AS a, id(b) AS b", {},
        f"SELECT {_nid(3, 'a.s_suppkey')} AS a, {_nid(3, 'b.s_suppkey')} AS b FROM supplier a JOIN supplier b USING (s_nationkey)"),
    "hops_1_3": (vault_graph, "MATCH (a:MarkdownDocument)-[:MD_UP|MD_NEXT*1..3]->(b) WHERE a.has_frontmatter = true RETURN id(a) AS a, id(b) AS b", {},
        f"WITH {_VAULT}, {_hops_sql(1, 3, _START, _UPS)} SELECT rid AS a, node AS b FROM hit"),
    "hops_2_2": (vault_graph, "MATCH (a:MarkdownDocument)-[:MD_LINKS_TO*2..2]->(b:MarkdownDocument) WHERE a.has_frontmatter = true RETURN id(b) AS b, count(*) AS n", {},
        f"WITH {_VAULT}, {_hops_sql(2, 2, _START, _LINKS)} SELECT node AS b, count(*) AS n FROM hit JOIN doc ON doc.id = node GROUP BY node"),
    "hops_0_2": (vault_graph, "MATCH (a:MarkdownDocument)-[:MD_RELATED*0..2]-(b) RETURN id(a) AS a, id(b) AS b", {},
        f"WITH {_VAULT}, {_hops_sql(1, 2, 'SELECT id AS rid, id AS node FROM doc', 'SELECT src, dst FROM edge WHERE t = ' + chr(39) + 'md_related' + chr(39), True)} SELECT rid AS a, node AS b FROM hit"),
    "path_lengths": (vault_graph, "MATCH p = (a:MarkdownDocument)-[:MD_UP*1..2]->(b) RETURN id(a) AS a, id(b) AS b, size(p.edges) AS n_edges, size(p.nodes) AS n_nodes", {},
        f"WITH {_VAULT}, {_hops_sql(1, 2, 'SELECT id AS rid, id AS node FROM doc', 'SELECT src, dst FROM edge WHERE t = ' + chr(39) + 'md_up' + chr(39))} SELECT rid AS a, node AS b, hop::BIGINT AS n_edges, (hop + 1)::BIGINT AS n_nodes FROM hit"),
    "where_3vl": (vault_graph, "MATCH (d:MarkdownDocument) WHERE NOT (d.aliases IS NULL) AND (d.title = null OR d.ext = 'mdx') RETURN count(*) AS n", {},
        f"WITH {_VAULT} SELECT count(*) AS n FROM doc WHERE aliases IS NOT NULL AND ext = 'mdx'"),
    "not_precedence": (vault_graph, "MATCH (d:MarkdownDocument) WHERE NOT d.has_frontmatter = true RETURN count(*) AS n", {},
        f"WITH {_VAULT} SELECT count(*) AS n FROM doc WHERE (NOT has_frontmatter) = true"),
    "arith_int_div": (star_graph, "MATCH (p:Part) RETURN p.p_partkey AS k, (p.p_partkey - 1000) / 7 AS q, p.p_size * 2 + 1 AS s, -p.p_size AS neg, p.p_retailprice / 2.0 AS half", {},
        "SELECT p_partkey AS k, CAST(trunc((p_partkey - 1000) / 7) AS BIGINT) AS q, (p_size * 2 + 1)::BIGINT AS s, (-p_size)::BIGINT AS neg, p_retailprice / 2 AS half FROM part"),
    "comparisons": (star_graph, "MATCH (p:Part) WHERE p.p_size <= 10 AND p.p_size != 5 AND p.p_brand < 'Brand#3' RETURN p.p_partkey AS k, p.p_size = 7 AS seven, 1 = 1.0 AS mixed", {},
        "SELECT p_partkey AS k, p_size = 7 AS seven, false AS mixed FROM part WHERE p_size <= 10 AND p_size <> 5 AND p_brand < 'Brand#3'"),
    "in_variants": (star_graph, "MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, 5, null] OR 'k' IN {k: 1} AND n.n_name CONTAINS 'IN' RETURN n.n_name AS name", {},
        "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 5) OR contains(n_name, 'IN')"),
    "starts_ends": (star_graph, "MATCH (n:Region) WHERE n.r_name STARTS WITH 'A' OR n.r_name ENDS WITH 'T' RETURN n.r_name AS name", {},
        "SELECT r_name AS name FROM region WHERE starts_with(r_name, 'A') OR ends_with(r_name, 'T')"),
    "regex_alt": (star_graph, "MATCH (n:Region) WHERE n.r_name =~ '^(ASIA|EUR)' OR n.r_name =~ 'DLE E' RETURN n.r_name AS name", {},
        "SELECT r_name AS name FROM region WHERE starts_with(r_name, 'ASIA') OR starts_with(r_name, 'EUR') OR contains(r_name, 'DLE E')"),
    "null_tests": (vault_graph, "MATCH (d:MarkdownDocument) WHERE d.title IS NOT NULL AND d.aliases IS NULL RETURN id(d) AS doc", {},
        f"WITH {_VAULT} SELECT id AS doc FROM doc WHERE title IS NOT NULL AND aliases IS NULL"),
    "list_funcs": (vault_graph, """MATCH (d:MarkdownDocument) WHERE d.tags IS NOT NULL
        RETURN id(d) AS doc, size(append(d.tags, 'x')) AS a, insert(d.tags, 0, 'first')[0] AS i, size(remove(d.tags, 'budget')) AS r, contains(d.tags, 'budget') AS c, d.tags[1] AS second, d.tags[-1] IS NULL AS none""", {},
        f"""WITH {_VAULT} SELECT id AS doc, (len(tags) + 1)::BIGINT AS a, 'first' AS i, len(list_filter(tags, lambda t: t IS DISTINCT FROM 'budget'))::BIGINT AS r,
        coalesce(list_contains(tags, 'budget'), false) AS c, tags[2] AS second, true AS none FROM doc WHERE tags IS NOT NULL"""),
    "map_funcs": (star_graph, """MATCH (r:Region) WITH r.r_name AS name, merge({a: 1, b: 'x'}, {b: 'y', c: r.r_regionkey}) AS m
        RETURN name AS name, m.a AS a, m['b'] AS b, m.c AS c, size(m) AS n, keys(m)[2] AS last""", {},
        "SELECT r_name AS name, 1::BIGINT AS a, 'y' AS b, r_regionkey::BIGINT AS c, 3::BIGINT AS n, 'c' AS last FROM region"),
    "size_bytes": (vault_graph, "MATCH (d:MarkdownDocument) RETURN id(d) AS doc, size(d.body) AS n", {},
        f"WITH {_VAULT} SELECT id AS doc, octet_length(encode(body))::BIGINT AS n FROM doc"),
    "type_id_labels": (star_graph, "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN id(n) AS i, type(n.n_name) AS t, type(n) AS tn, edge_type(e) AS et, labels(r)[0] AS l, type(n.zz) AS tz", {},
        f"SELECT {_nid(1, 'n_nationkey')} AS i, 'string' AS t, 'node' AS tn, 'IN_REGION' AS et, 'Region' AS l, 'null' AS tz FROM nation"),
    "has_prop_label": (vault_graph, "MATCH (d) WHERE has_prop(d, 'source_hash') RETURN has_label(d, 'MarkdownDocument') AS doc, has_label(null, 'X') AS none, count(*) AS n", {},
        f"WITH {_VAULT} SELECT true AS doc, false AS none, count(*) AS n FROM doc WHERE source_hash IS NOT NULL"),
    "agg_group": (star_graph, "MATCH (o:Order) RETURN o.o_orderstatus AS status, count(*) AS n, sum(o.o_orderkey) AS s, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi", {},
        "SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1"),
    "agg_global_empty": (star_graph, "MATCH (o:Order) WHERE o.o_orderkey < 0 RETURN count(*) AS n, sum(o.o_orderkey) AS s, avg(o.o_totalprice) AS a", {},
        "SELECT 0::BIGINT AS n, NULL::BIGINT AS s, NULL::DOUBLE AS a"),
    "agg_count_expr": (vault_graph, "MATCH (d:MarkdownDocument) RETURN d.ext AS ext, count(d.aliases) AS n_aliases, count(*) AS n", {},
        f"WITH {_VAULT} SELECT ext, count(aliases) AS n_aliases, count(*) AS n FROM doc GROUP BY ext"),
    "agg_collect_ordered": (star_graph, "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r.r_name AS region, collect(n.n_name) AS names RETURN region AS region, size(names) AS n, names[0] AS first", {},
        "SELECT r_name AS region, count(*)::BIGINT AS n, arg_min(n_name, n_nationkey) AS first FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "with_having": (star_graph, "MATCH (c:Customer)-[:PLACED]->(o) WITH c.c_custkey AS k, count(*) AS n WHERE n > 15 RETURN k AS k, n AS n", {},
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "with_star": (star_graph, "MATCH (n:Nation)-[:IN_REGION]->(r) WITH * WHERE r.r_name = 'ASIA' RETURN n.n_name AS name", {},
        "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "with_order_limit": (star_graph, "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10 RETURN c.c_custkey AS k", {},
        "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "return_star_sorted": (star_graph, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN *", {},
        f"SELECT {_nid(1, 'n_nationkey')} AS n, {_nid(0, 'n_regionkey')} AS r FROM nation"),
    "default_col_names": (star_graph, "MATCH (r:Region) RETURN r.r_name, r.r_regionkey + 1", {}, "SELECT r_name AS col_1, (r_regionkey + 1)::BIGINT AS col_2 FROM region"),
    "order_nulls": (vault_graph, "MATCH (d:MarkdownDocument) WITH d, d.aliases[0] AS a, id(d) AS i ORDER BY a DESC, i LIMIT 40 RETURN i AS doc", {},
        f"WITH {_VAULT} SELECT id AS doc FROM doc ORDER BY aliases[1] DESC NULLS FIRST, id LIMIT 40"),
    "limit_before_aggregate": (star_graph, "MATCH (c:Customer) RETURN count(*) AS n, sum(c.c_custkey) AS s ORDER BY c.c_custkey LIMIT 100", {},
        "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS s FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100)"),
    "unordered_limit": (star_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o LIMIT 25", {},
        "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_custkey, o_orderkey LIMIT 25"),
    "theta_condition": (star_graph, "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Supplier) WHERE a.s_acctbal < b.s_acctbal RETURN n.n_name AS nation, count(*) AS n", {},
        "SELECT n_name AS nation, count(*) AS n FROM supplier a JOIN supplier b USING (s_nationkey) JOIN nation ON s_nationkey = n_nationkey WHERE a.s_acctbal < b.s_acctbal GROUP BY 1"),
    "agg_avg": (star_graph, "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n.n_name AS nation, avg(c.c_custkey) AS mean, avg(c.c_acctbal / 1000000.0) AS small RETURN nation AS nation, mean AS mean, small < 1.0 AS low", {},
        "SELECT n_name AS nation, avg(c_custkey) AS mean, true AS low FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "agg_collect_values": (star_graph, "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.n_name DESC WITH r.r_name AS region, collect(n.n_name) AS names, collect(n.zz) AS zz RETURN region AS region, names AS names, zz[1] IS NULL AND size(zz) = size(names) AS holes", {},
        "SELECT r_name AS region, list(n_name ORDER BY n_name DESC) AS names, true AS holes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_min_max_lists": (vault_graph, "MATCH (d:MarkdownDocument) WITH d.ext AS ext, min(d.tags) AS lo, max(d.headings) AS hi, min(d.title) AS first RETURN ext AS ext, size(lo) AS lo, size(hi) AS hi, first AS first", {},
        f"WITH {_VAULT} SELECT ext, min(len(tags))::BIGINT AS lo, max(len(headings))::BIGINT AS hi, min(title) AS first FROM doc GROUP BY ext"),
    "map_values": (star_graph, "MATCH (r:Region) WITH r.r_name AS name, values({a: r.r_name, b: 'x'}) AS v RETURN name AS name, v[0] AS a, v[1] AS b, size(v) AS n", {},
        "SELECT r_name AS name, r_name AS a, 'x' AS b, 2::BIGINT AS n FROM region"),
    "regex_computed": (star_graph, "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE b.n_name =~ a.n_name OR b.n_name =~ $start RETURN a.n_name AS a, b.n_name AS b", {"start": "^NATION_(3|4)$"},
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE contains(b.n_name, a.n_name) OR b.n_name IN ('NATION_3', 'NATION_4')"),
    "unit_row": (star_graph, "RETURN 7 / 2 AS q, -7 / 2 AS nq, [1, 2][1] AS e, {k: 'v'}.k AS m, size('héé') AS b, size(b'abc') AS raw, (null + 1) IS NULL AS z, 'a' IN 'cat' AS i", {},
        "SELECT 3::BIGINT AS q, -3::BIGINT AS nq, 2::BIGINT AS e, 'v' AS m, 5::BIGINT AS b, 3::BIGINT AS raw, true AS z, true AS i"),
}


def edge_types(q: ast.Query) -> tuple:
    """The edge types that a query walks; all where a step names none."""
    steps = [edge for p in (q.match, q.merge, q.create) if p is not None for edge, _ in p.steps]
    if any(not e.types for e in steps):
        return VAULT_TYPES
    return tuple(sorted({t for e in steps for t in e.types}))


def _query(name: str):
    graph, text, params, _ = TEXTS[name]

    def run(spark, d):
        q = parse(text)[0]
        g = vault_graph(spark, d, edge_types(q)) if graph is vault_graph else graph(spark, d)
        return Compiler(g, params).run(q)

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in TEXTS}
SQL = {name: sql for name, (_, _, _, sql) in TEXTS.items() if sql}

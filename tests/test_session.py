import random

import pytest

from weftgraph.lang.errors import QueryError
from weftgraph.lang.parser import parse
from weftgraph.plans.session import GraphSession
from weftgraph.sources.graph import Graph


@pytest.fixture(scope="module")
def people(spark):
    p = spark.createDataFrame([(1, "Ada", "ada@example.com", 36), (2, "Grace", "grace@example.com", 37), (3, "Alan", "alan@example.com", 41), (4, "Bob", None, 29)], "id bigint, name string, email string, age bigint")
    k = spark.createDataFrame([(1, 1, 2, 2020), (2, 2, 3, 2021)], "id bigint, src bigint, dst bigint, since bigint")
    return Graph(spark).with_nodes("Person", p).with_edges("KNOWS", k).but(next_node=5, next_edge=3)


@pytest.fixture()
def s(spark, people):
    return GraphSession(spark, people)


def rows(df):
    return [tuple(r) for r in df.collect()]


def code(f, *a):
    with pytest.raises(QueryError) as e:
        f(*a)
    return e.value.code


def test_reading(s):
    assert rows(s.query("MATCH (n:Person) RETURN n.name AS name, n.email AS e ORDER BY n.name")) == [("Ada", "ada@example.com"), ("Alan", "alan@example.com"), ("Bob", None), ("Grace", "grace@example.com")]
    assert sorted(rows(s.query("MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name"))) == [("Ada", "Grace"), ("Grace", "Alan")]
    assert sorted(rows(s.query("MATCH (n) WHERE n.name STARTS WITH 'A' OR n.age >= 37 RETURN n.name"))) == [("Ada",), ("Alan",), ("Grace",)]
    assert sorted(rows(s.query("MATCH (a)-[:KNOWS*1..3]->(b) RETURN a.name, b.name"))) == [("Ada", "Alan"), ("Ada", "Grace"), ("Grace", "Alan")]


def test_aggregates(s):
    got = sorted(rows(s.query("MATCH (n:Person) WITH n.age >= 37 AS senior, count(*) AS c, collect(n.name) AS names RETURN senior AS senior, c AS c, names AS names")))
    assert got == [(False, 2, ["Ada", "Bob"]), (True, 2, ["Grace", "Alan"])]
    assert code(s.query, "MATCH (n) RETURN count(*) + 1") == "function_error"


def test_merge_once(s):
    q = "MATCH (a:Person {name: 'Ada'}) MERGE p = (a)-[:MENTORS]->(m:Person {name: 'Zoe'}) RETURN *"
    assert s.query(q).columns == ["a", "m", "p"]
    s.query(q)
    assert rows(s.query("MATCH (a)-[e:MENTORS]->(b) RETURN count(*)")) == [(1,)]
    assert rows(s.query("MATCH (n:Person) RETURN count(*)")) == [(5,)]


def test_merge_shares_new_nodes(s):
    out = rows(s.query("MATCH (a:Person) MERGE (t:Team {kind: 'all'}) RETURN a.name AS n, id(t) AS t"))
    assert len(out) == 4 and len({t for _, t in out}) == 1


def test_create_set_remove_delete(s):
    s.query("CREATE (a:City {name: 'Rome'})-[:NEAR {km: 5}]->(b:City {name: 'Ostia'})")
    assert rows(s.query("MATCH (a:City)-[e:NEAR]->(b) RETURN a.name, e.km, b.name, id(a)")) == [("Rome", 5, "Ostia", 5)]
    assert rows(s.query("MATCH (n:Person {name: 'Ada'}) SET n.age = n.age + 1, n.role = 'boss' RETURN n.age, n.role")) == [(37, "boss")]
    s.query("MATCH (n:Person {name: 'Ada'}) SET n += {role: 'chief', x: 1}")
    assert rows(s.query("MATCH (n:Person) WHERE n.role IS NOT NULL RETURN n.role, n.x")) == [("chief", 1)]
    assert rows(s.query("MATCH (n:Person {name: 'Ada'}) REMOVE n:Person, n.role RETURN labels(n), n.role, n.name")) == [([], None, "Ada")]
    assert rows(s.query("MATCH (n {name: 'Grace'}) DELETE n RETURN n.name, id(n)")) == [(None, 2)]
    assert rows(s.query("MATCH (a)-[e:KNOWS]-(b) RETURN count(*)")) == [(0,)]


def test_list_patch(s):
    s.query("CREATE (a:T {tags: ['a', 'b', 'c']})")
    assert rows(s.query("MATCH (t:T) SET t.tags[1] = 'z' RETURN t.tags")) == [(["a", "z", "c"],)]


def test_literals_and_functions(s):
    assert rows(s.query("RETURN ['Ada', 'Grace'][1], {k: 'Ada'}.k, 2 IN [1, 2], 'd' IN 'Ada', [1, 2] CONTAINS 2, b'abc', append(null, 1), size('é'), (NOT null) IS NULL")) == [
        ("Grace", "Ada", True, True, True, bytearray(b"abc"), [1], 2, True)
    ]
    assert rows(s.query("RETURN insert([1, 3], 1, 2), remove([1, 2, 1], 1), merge({a: 1}, {a: 2, b: 3}).a, keys({x: 1, y: 2}), 7 / 2, -7 / 2"))[0][:4] == ([1, 2, 3], [2], 2, ["x", "y"])
    assert rows(s.query("RETURN datetime'2024-01-02T03:04:05+01:00' < datetime'2024-01-02T02:04:06Z'")) == [(True,)]


def test_error_codes(s):
    for q, want in [
        ("RETURN 'Ada' =~ '('", "regex_compile_error"), ("RETURN [1]['bad']", "index_type_error"), ("RETURN 1 + 1.0", "arithmetic_type_error"),
        ("RETURN 1 < 'a'", "comparison_type_error"), ("RETURN x", "unknown_variable"), ("MATCH (n) WHERE n.name RETURN n", "where_type_error"),
        ("MATCH (a)-[e:X*1..2]->(b) RETURN b", "variable_hop_edge_binding"), ("RETURN nope(1)", "function_error"), ("MATCH (n RETURN n", "parse_expected_token"),
        ("MATCH (a)-[*3..1]->(b) RETURN a", "parse_hop_range"), ("RETURN 'abc", "parse_string"), ("SHOW ME", "parse_show_kind"), ("RETURN id(null)", "function_error"),
        ("MATCH (n) RETURN n LIMIT 0", "parse_limit_value"),
    ]:
        assert code(s.query, q) == want, q


def test_transactions(s):
    s.execute("BEGIN; CREATE CONSTRAINT ON :Person REQUIRE email UNIQUE; SAVEPOINT a; CREATE (n:Person {email: 'ada@example.com'})")
    assert code(s.execute, "COMMIT") == "constraint_unique_violation"
    s.execute("ROLLBACK TO SAVEPOINT a; CREATE (n:Person {email: 'new@example.com'}); COMMIT")
    assert rows(s.query("MATCH (n:Person) RETURN count(*)")) == [(5,)]
    s.execute("BEGIN")
    assert code(s.query, "RETURN x") == "unknown_variable"
    assert code(s.query, "MATCH (n) RETURN n") == "transaction_failed"
    assert rows(s.query("SHOW TRANSACTIONS"))[0][:2] == (True, True)
    s.execute("ROLLBACK")
    assert code(s.execute, "RETURN 1; RETURN 2") == "multi_statement_requires_transaction"


def test_failed_statement_leaves_the_graph(s):
    s.query("CREATE CONSTRAINT c ON :Person REQUIRE email UNIQUE")
    assert code(s.query, "CREATE (n:Person {email: 'ada@example.com'})") == "constraint_unique_violation"
    assert rows(s.query("MATCH (n:Person) RETURN count(*)")) == [(4,)]


def test_constraints(s):
    for spec, want in (("email REQUIRED", "constraint_required_violation"), ("age TYPE string", "constraint_type_violation")):
        assert code(s.query, f"CREATE CONSTRAINT ON :Person REQUIRE {spec}") == want
    s.query("CREATE CONSTRAINT ON [:KNOWS] REQUIRE ENDPOINTS :Person -> :Person")
    s.query("CREATE CONSTRAINT ON [:KNOWS] REQUIRE MAX OUTGOING 1")
    assert code(s.query, "MATCH (a {name: 'Ada'}) CREATE (a)-[:KNOWS]->(x:Robot)") == "constraint_endpoint_violation"
    assert code(s.query, "MATCH (a {name: 'Ada'}) CREATE (a)-[:KNOWS]->(x:Person)") == "constraint_cardinality_violation"
    assert rows(s.query("SHOW CONSTRAINTS ON [:KNOWS]"))[0][3:] == ("", "endpoints", ":Person -> :Person")


def test_schema(s):
    s.query("CREATE INDEX ON :Person(age) KIND RANGE")
    assert rows(s.query("SHOW INDEXES")) == [("idx_label_Person_age", "label", "Person", "age", False, "ready", "range")]
    assert rows(s.query("EXPLAIN MATCH (n:Person) WHERE n.age > 30 AND 40 >= n.age RETURN n.name LIMIT 2"))[1] == (2, 1, "NodeIndexRangeScan", ":Person(age > 30 AND <= 40)")
    s.query("ALTER INDEX idx_label_Person_age SET STATUS INVALID")
    assert rows(s.query("EXPLAIN MATCH (n:Person) WHERE n.age > 30 RETURN n"))[1][2] == "NodeScan"
    assert code(s.query, "DROP LABEL Person") == "label_in_use"
    s.query("CREATE LABEL Ghost DESCRIPTION 'none yet'")
    assert ("label", "Ghost", "none yet", "CREATE LABEL Ghost DESCRIPTION 'none yet'") in rows(s.query("SHOW SCHEMA"))
    s.query("DROP LABEL Ghost")
    s.query("DROP IF EXISTS LABEL Ghost")
    assert code(s.query, "CREATE INDEX ON :Nope(x)") == "unknown_label"
    assert rows(s.query("SHOW STATS"))[0][:5] == (4, 2, 1, 1, 1)


def test_store(spark, people, tmp_path):
    s = GraphSession(spark, people)
    s.save_as(f"file://{tmp_path}/g")
    s.query("MATCH (n:Person {name: 'Bob'}) SET n.email = 'bob@example.com'")
    again = GraphSession.open(spark, f"file://{tmp_path}/g")
    assert rows(again.query("MATCH (n:Person {name: 'Bob'}) RETURN n.email")) == [("bob@example.com",)]
    assert again.check()["ok"] and again.store.version() == 2
    again.compact()
    assert GraphSession.open(spark, f"file://{tmp_path}/g").graph.stats()["node_count"] == 4
    again.store.backup(f"file://{tmp_path}/b")
    assert GraphSession.open(spark, f"file://{tmp_path}/b").graph.stats()["edge_count"] == 2
    assert code(GraphSession.open, spark, f"file://{tmp_path}/none") == "storage_not_found"


def test_collect_follows_the_order(s):
    assert rows(s.query("MATCH (n:Person) WITH n ORDER BY n.age DESC WITH collect(n.name) AS names RETURN names")) == [(["Alan", "Grace", "Ada", "Bob"],)]
    assert rows(s.query("MATCH (n:Person) WITH n.name AS name ORDER BY name LIMIT 2 WITH collect(name) AS names RETURN names")) == [(["Ada", "Alan"],)]


def walk_levels(edges, starts, low, high, both):
    """Results of bounded hops: a node is expanded once per depth and start."""
    step = [(a, b) for a, b in edges] + ([(b, a) for a, b in edges if a != b] if both else [])
    out = []
    for s in starts:
        level = {s}
        for k in range(1, high + 1):
            hits = [b for n in sorted(level) for a, b in step if a == n]
            out += [(s, b) for b in hits] if k >= low else []
            level = set(hits)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_hops_against_walking(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(6), r.randrange(6)) for _ in range(11)]
    g = Graph(spark).with_nodes("N", spark.range(6)).with_edges("E", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "id bigint, src bigint, dst bigint"))
    low, high, both = r.randrange(3), r.randrange(3, 5), seed % 2 == 1
    arrow = "-" if both else "->"
    for trace in ("", "p = "):
        got = rows(GraphSession(spark, g).query(f"MATCH {trace}(a)-[:E*{low}..{high}]{arrow}(b) RETURN id(a), id(b)"))
        assert sorted(got) == walk_levels(edges, range(6), low, high, both)


def test_notes_over_a_graph(s, tmp_path):
    (tmp_path / "a.md").write_text("# Alpha\n[[b]]")
    (tmp_path / "b.md").write_text("# Beta")
    got = rows(s.query_with_notes("MATCH (a:MarkdownDocument)-[:MD_LINKS_TO]->(b) RETURN a.title AS a, b.title AS b", str(tmp_path)))
    assert got == [("Alpha", "Beta")]
    assert rows(s.query("MATCH (n) RETURN count(*)")) == [(4,)]


def test_parser_rules():
    q = parse("MATCH (a) WHERE NOT a.x = 1 RETURN a -- comment")[0]
    assert q.where.op == "=" and q.where.a.op == "NOT"
    assert parse("RETURN `a b`.`c.d`")[0].returns[0].expr.name == "c.d"
    assert parse("MATCH (a)<-[:X|Y*0..2 {k: 1,}]-(b) RETURN *")[0].match.steps[0][0].hops == (0, 2)

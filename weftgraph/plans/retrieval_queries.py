"""Search, context and health over the vault tables, with DuckDB counterparts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.lang.ast import Target
from weftgraph.lang.parser import parse
from weftgraph.operators import health
from weftgraph.operators import search as S
from weftgraph.operators.constraints import duplicate_edges, violations
from weftgraph.operators.context import TABLE, context, context_ndjson, context_table, expand, induced_edges, resolve_seeds, viewer_seed
from weftgraph.operators.search import fold, score, search, structural
from weftgraph.plans.compiler import Compiler
from weftgraph.plans.graph_queries import _VAULT
from weftgraph.sources.graph import ConstraintDef
from weftgraph.sources.tables import current_documents, current_wide, latest, live_edges, table, tidy
from weftgraph.sources.views import star_graph, vault_graph

_COLS = ["root", "path", "ext", "source_hash", "status", "title", "aliases", "tags", "headings", "body", "raw"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return current_documents(table(spark, d, "md_documents"), _COLS)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents for searches: bodies are scored where they are read."""
    return current_wide(table(spark, d, "md_documents"), _COLS)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return live_edges(table(spark, d, "graph_edges"), ["src", "dst", "edge_weight"])


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _edges(spark, d)
    inside = e.where("etype = 'md_in_directory'").select(F.col("src").alias("doc"), F.col("dst").alias("dir"), F.col("edge_weight").alias("weight"))
    up = e.where("etype = 'md_parent_directory'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return inside.distinct(), up.distinct()


def search_scores(spark, d):
    return score(_texts(spark, d), "Quiet Network").select("id", "score", "category")


def search_rank(spark, d):
    return search(_texts(spark, d), "budget", limit=20).select("rank", "id", "score")


def search_tags(spark, d):
    return score(_texts(spark, d), "garden", ["roadmap"]).select("id", "score")


def search_snippet(spark, d):
    return search(_texts(spark, d), "shared parser", limit=10).select("rank", "id", "snippet_source")


def search_structural(spark, d):
    out = structural(score(_texts(spark, d), "network"), *_tree(spark, d))
    return out.select("id", "score", "signal")


def context_both(spark, d):
    seeds = table(spark, d, "search_items").select(F.col("doc_id").alias("id"))
    nodes, _ = expand(vault_graph(spark, d), seeds, 2)
    return nodes.select("id", F.col("depth").cast("bigint").alias("depth"))


def context_edges_out(spark, d):
    seeds = table(spark, d, "search_items").select(F.col("doc_id").alias("id"))
    _, edges = expand(vault_graph(spark, d, ("MD_UP", "MD_RELATED", "MD_NEXT")), seeds, 2, "out", ("MD_UP", "MD_RELATED", "MD_NEXT"))
    return edges.select("id", F.col("depth").cast("bigint").alias("depth"))


def context_label_filter(spark, d):
    seeds = table(spark, d, "md_directories").select("id")
    nodes, _ = expand(vault_graph(spark, d), seeds, 1, "in", (), ("MarkdownDocument",))
    return nodes.select("id", F.col("depth").cast("bigint").alias("depth"))


def induced_subgraph(spark, d):
    nodes = _docs(spark, d).where("ext = 'mdx'").select("id")
    return induced_edges(vault_graph(spark, d), nodes).select("id", "src", "dst", "type")


def health_orphans(spark, d):
    return health.orphan_documents(_docs(spark, d), _edges(spark, d)).select("id")


def health_aliases(spark, d):
    return health.ambiguous_aliases(_docs(spark, d))


def _newest_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the newest snapshot that each vault delivered, corrections applied."""
    rows = table(spark, d, "context_nodes").select("snapshot_no", "root", "path", "node_id", "source_hash", F.col("src_status").alias("status"), "title", "loaded_at")
    last = rows.groupBy("root").agg(F.max("snapshot_no").alias("snapshot_no"))
    return latest(rows.join(last, ["root", "snapshot_no"]), ["root", "path"], ["loaded_at", "source_hash"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshots as the listing of files."""
    return _newest_nodes(spark, d).select("root", "path", F.col("source_hash").alias("hash"))


def health_metadata(spark, d):
    out = health.missing_metadata(_newest_nodes(spark, d))
    return out.select("root", "path", F.concat_ws(",", "missing").alias("missing"))


def health_duplicate_links(spark, d):
    return health.duplicate_links(_edges(spark, d)).select("src", "etype", "dst", "n")


def health_report(spark, d):
    return health.report(_docs(spark, d), _edges(spark, d), _files(spark, d), star_graph(spark, d).catalog)


def health_stale(spark, d):
    return health.stale_documents(_docs(spark, d), _files(spark, d)).select("id", "kind")


def reindex_report(spark, d):
    return health.reindex_report(star_graph(spark, d))


def citation_graph(spark, d):
    out = health.citation_audit(_newest_nodes(spark, d))
    return out.select("root", "path", F.concat_ws(",", "failures").alias("failures")).where("failures <> ''")


def citation_query(spark, d):
    """The audit of a query's result, which lacks a column that is required."""
    rows = Compiler(vault_graph(spark, d, ()), {}).run(parse("MATCH (d:MarkdownDocument) WHERE d.ext = 'mdx' RETURN d.path AS path, d.status AS status")[0])
    return health.citation_audit(rows).select("path", F.concat_ws(",", "failures").alias("failures"))


def graph_snapshot_nodes(spark, d):
    return health.normal_snapshot(_docs(spark, d), table(spark, d, "md_directories"), _edges(spark, d))[0]


def graph_snapshot_diff(spark, d):
    """Documents as they are against the newest snapshots, by (root, path)."""
    keyed = lambda df: df.select(F.concat_ws("\n", "root", "path").alias("key"), tidy("status").alias("status"), F.col("source_hash").alias("hash"))
    return health.snapshot_diff(keyed(_newest_nodes(spark, d)), keyed(_docs(spark, d)), ["status", "hash"])


def viewer_subgraph(spark, d):
    """The edges shown for all 'mdx' documents: none was returned, so those between them."""
    nodes = _docs(spark, d).where("ext = 'mdx'").select("id")
    return viewer_seed(vault_graph(spark, d), nodes, cap=40)[1]


def viewer_radius(spark, d):
    nodes = _docs(spark, d).where("ext = 'mdx'").agg(F.min("id").alias("id"))
    return viewer_seed(vault_graph(spark, d), nodes, radius=2, cap=60)[0]


#: The document with the smallest id is the seed of the budgeted queries.
def _seed(spark: SparkSession, d: str) -> int:
    return table(spark, d, "md_documents").agg(F.min("id")).first()[0]


def _envelope(spark: SparkSession, d: str, **kw) -> dict:
    return context(vault_graph(spark, d), [_seed(spark, d)], depth=1, max_nodes=4, max_edges=6, **kw)


def context_budget(spark, d):
    e = _envelope(spark, d)
    rows = [("node", n["node_id"], n["depth"]) for n in e["nodes"]] + [("edge", x["edge_id"], x["depth"]) for x in e["edges"]]
    return spark.createDataFrame(rows, "kind string, id bigint, depth bigint")


def context_rows(spark, d):
    return spark.createDataFrame(context_table(_envelope(spark, d)), TABLE)


def context_lines(spark, d):
    lines = [json.loads(x) for x in context_ndjson(_envelope(spark, d))]
    return spark.createDataFrame([(x["kind"], (x.get("node") or {}).get("node_id", (x.get("edge") or {}).get("edge_id"))) for x in lines], "kind string, id bigint")


def context_evidence(spark, d):
    e = _envelope(spark, d)
    rows = [("node", n["node_id"], p["field"], p["value"]) for n in e["nodes"] for p in n["evidence"]]
    rows += [("edge", x["edge_id"], p["field"], p["value"]) for x in e["edges"] for p in x["evidence"]]
    return spark.createDataFrame(rows, "kind string, id bigint, field string, value string")


def context_payload(spark, d):
    """A small payload limit: edges go first, the seed stays."""
    e = _envelope(spark, d, max_bytes=1_500)
    size = len(json.dumps(e, default=str).encode())
    return spark.createDataFrame([(size <= 1_500, size == e["retrieval_usage"]["total_payload_bytes"], len(e["edges"]), e["nodes"][0]["depth"], e["retrieval_usage"]["truncated"])], "fits boolean, own_size boolean, n_edges bigint, first_depth bigint, truncated boolean")


def seed_paths(spark, d):
    """Seeds by id and by path, one of them stale, and the warnings."""
    docs = _docs(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("n = 1")
    live = docs.where(tidy("status") == "current").agg(F.min_by("path", "id")).first()[0]
    gone = docs.where(tidy("status") == "missing").agg(F.min_by("path", "id")).first()[0]
    found, warnings = resolve_seeds(vault_graph(spark, d, ()), [_seed(spark, d)] * 2, [live, *([gone] if gone else [])])
    return spark.createDataFrame([("seed", str(s)) for s in found] + [("warning", w) for w in warnings], "kind string, value string")


def search_truncated(spark, d):
    out = search(_texts(spark, d), "budget", limit=7)
    return out.select("rank", "id", "truncated", F.array_join("fields", ",").alias("fields"), "category")


def search_snippet_text(spark, d):
    out = search(_texts(spark, d), "shared parser", limit=25)
    return out.select("rank", "id", "snippet", "snippet_source")


def get_document(spark, d):
    """By id, by a title in other letter case, and a title that several have."""
    docs = _docs(spark, d)
    row = docs.groupBy(fold(F.col("title")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    one = row.where("n = 1").agg(F.min_by("t", "id")).first()[0]
    many = row.where("n > 1").agg(F.min_by("t", "id")).first()[0] or "no such title"
    parts = [S.get_document(docs, key).select(F.lit(kind).alias("asked"), "id", "path") for kind, key in (("id", str(_seed(spark, d))), ("title", one.upper()), ("several", many))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def list_documents(spark, d):
    return S.list_documents(_docs(spark, d), 50).select("id", "path", "title")


def semantic_unconfigured(spark, d):
    e = S.semantic_search("anything")
    return spark.createDataFrame([(e["ok"], e["error"]["code"])], "ok boolean, code string")


def graph_snapshot_edges(spark, d):
    dirs = table(spark, d, "md_directories")
    return health.normal_snapshot(_docs(spark, d), dirs, _edges(spark, d))[1]


def check_unique(spark, d):
    c = ConstraintDef("c", Target("label", "MarkdownDocument"), ("UNIQUE", "title"))
    return violations(vault_graph(spark, d, ()), c).select(F.col("value").alias("title"), "n")


def check_required(spark, d):
    c = ConstraintDef("c", Target("label", "MarkdownDocument"), ("REQUIRED", "aliases"))
    return violations(vault_graph(spark, d, ()), c).select("id")


def check_endpoints(spark, d):
    c = ConstraintDef("c", Target("edge_type", "MD_UP"), ("ENDPOINTS", "MarkdownDocument", "MarkdownDocument"))
    return violations(vault_graph(spark, d, ("MD_UP",)), c).select("id", "src", "dst")


def check_max_outgoing(spark, d):
    c = ConstraintDef("c", Target("edge_type", "MD_LINKS_TO"), ("MAX OUTGOING", 6))
    return violations(vault_graph(spark, d, ("MD_LINKS_TO",)), c).select("src", "n")


def check_duplicate_edges(spark, d):
    return duplicate_edges(vault_graph(spark, d)).select("src", "type", "dst", "n")


QUERIES = {f.__name__: f for f in (
    search_scores, search_rank, search_tags, search_snippet, search_structural, context_both, context_edges_out, context_label_filter, induced_subgraph,
    search_truncated, search_snippet_text, get_document, list_documents, semantic_unconfigured,
    context_budget, context_rows, context_lines, context_evidence, context_payload, seed_paths, viewer_subgraph, viewer_radius,
    health_orphans, health_aliases, health_metadata, health_duplicate_links, health_report, health_stale, reindex_report, citation_graph, citation_query,
    graph_snapshot_edges, graph_snapshot_nodes, graph_snapshot_diff,
    check_unique, check_required, check_endpoints, check_max_outgoing, check_duplicate_edges,
)}


def _low(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _score_sql(text: str, where: str = "true") -> str:
    q, terms = text.lower(), sorted(set(text.lower().split()))
    n = len(terms)

    def field(x: str, tier: int) -> str:
        hits = " + ".join(f"CASE WHEN contains({x}, '{t}') THEN 1 ELSE 0 END" for t in terms)
        return f"CASE WHEN contains({x}, '{q}') THEN {tier} WHEN ({hits}) > 0 THEN {tier + n} - ({hits}) END"

    def values(x: str, tier: int) -> str:
        return f"list_min(list_transform({x}, lambda v: {field(_low('v'), tier)}))"

    parts = [("p", field(_low("title"), 100)), ("p", field(_low("path"), 110)), ("m", values("aliases", 200)), ("m", values("tags", 210)), ("m", values("headings", 220)), ("b", field(_low("body"), 300))]
    best = f"least({', '.join(f's{k}' for k in range(6))})"
    cols = ", ".join(f"{sql} AS s{k}" for k, (_, sql) in enumerate(parts))
    return f"""WITH {_VAULT}, f AS (SELECT *, {_low('title')} = '{q}' OR {_low('path')} = '{q}' AS exact, {cols} FROM doc WHERE {where}),
    sc AS (SELECT *, CASE WHEN exact THEN 0 ELSE {best} END::BIGINT AS score,
      CASE WHEN exact THEN 'exact_title_or_path' WHEN {best} IN (s0, s1) THEN 'partial_title_or_path' WHEN {best} IN (s2, s3, s4) THEN 'structured_metadata' ELSE 'body' END AS category
      FROM f WHERE exact OR {best} IS NOT NULL)"""


def _bfs_sql(seeds: str, depth: int, ways: str) -> str:
    parts = [f"w AS ({ways})", f"n0 AS (SELECT DISTINCT s.id FROM ({seeds}) s JOIN node ON node.id = s.id)", "v0 AS (SELECT id, 0 AS depth FROM n0)"]
    for k in range(1, depth + 1):
        parts.append(f"t{k} AS (SELECT w.edge, w.nxt FROM n{k - 1} n JOIN w ON w.at = n.id JOIN node ON node.id = w.nxt)")
        parts.append(f"n{k} AS (SELECT DISTINCT nxt AS id FROM t{k} WHERE nxt NOT IN (SELECT id FROM v{k - 1}))")
        parts.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT id, {k} FROM n{k})")
    return ", ".join(parts)


_BOTH = "SELECT src AS at, dst AS nxt, id AS edge FROM edge UNION ALL SELECT dst, src, id FROM edge"
_LINK = "t NOT IN ('md_in_directory', 'md_parent_directory')"
_ORPHAN = f"SELECT id FROM doc WHERE lower(trim(status)) = 'current' AND id NOT IN (SELECT src FROM edge WHERE {_LINK} UNION SELECT dst FROM edge WHERE {_LINK})"
_AMBIGUOUS = "SELECT root, alias, count(DISTINCT path) AS n_paths FROM (SELECT root, path, unnest(aliases) AS alias FROM doc WHERE lower(trim(status)) = 'current') WHERE trim(alias) <> '' GROUP BY ALL HAVING count(DISTINCT path) > 1"
_NEWEST = """newest AS (SELECT * FROM context_nodes WHERE (root, snapshot_no) IN (SELECT (root, max(snapshot_no)) FROM context_nodes GROUP BY root)
    QUALIFY row_number() OVER (PARTITION BY root, path ORDER BY loaded_at DESC NULLS LAST, source_hash DESC NULLS LAST) = 1)"""


def _empty_of(fields: dict) -> str:
    return f"concat_ws(',', {', '.join(f"""CASE WHEN coalesce(trim({c}), '') = '' THEN '{n}' END""" for n, c in fields.items())})"


_MISSING = _empty_of({"root": "root", "path": "path", "source_hash": "source_hash", "status": "src_status"})
_KINDS = f"""f AS (SELECT root, path, source_hash AS h FROM newest),
    stale AS (SELECT id, unnest(CASE WHEN coalesce(trim(doc.root), '') = '' OR coalesce(trim(doc.path), '') = '' OR coalesce(trim(doc.source_hash), '') = '' OR coalesce(trim(doc.status), '') = '' THEN ['metadata_incomplete']
      ELSE list_filter([CASE WHEN lower(trim(doc.status)) = 'missing' THEN 'tombstoned_document' WHEN f.path IS NULL AND lower(trim(doc.status)) = 'current' THEN 'missing_file' END,
        CASE WHEN lower(trim(doc.status)) <> 'missing' AND f.path IS NOT NULL AND h IS DISTINCT FROM doc.source_hash THEN 'hash_mismatch' END], lambda x: x IS NOT NULL) END) AS kind
      FROM doc LEFT JOIN f ON f.root = doc.root AND f.path = doc.path)"""
#: The budgeted walk of one step from the document with the smallest id.
_STEP = f"""WITH {_VAULT}, s AS (SELECT min(id) AS s FROM md_documents), w AS (SELECT dst AS nxt, id, 0 AS d, t, src, dst FROM edge, s WHERE src = s UNION ALL SELECT src, id, 1, t, src, dst FROM edge, s WHERE dst = s),
    o AS (SELECT *, row_number() OVER (ORDER BY d, id) AS pos FROM w), f AS (SELECT nxt, min(pos) AS at FROM o, s WHERE nxt <> s GROUP BY nxt),
    u AS (SELECT o.*, coalesce(f.at = o.pos, false) AS new FROM o LEFT JOIN f ON f.nxt = o.nxt),
    c AS (SELECT *, count(DISTINCT id) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had, sum(new::INT) OVER (ORDER BY pos) AS no FROM u),
    e AS (SELECT * FROM c WHERE had < 6), n0 AS (SELECT s AS id, 0 AS depth FROM s UNION ALL SELECT nxt, 1 FROM e WHERE new AND no <= 4),
    n AS (SELECT * FROM n0 ORDER BY depth, id LIMIT 4), k AS (SELECT id, arg_min(d, pos) AS d, any_value(t) AS t, any_value(src) AS src, any_value(dst) AS dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY id),
    about AS (SELECT id, 'MarkdownDocument' AS label, title, path, status FROM doc UNION ALL SELECT id, 'MarkdownDirectory', NULL, path, status FROM md_directories)"""


def _snippet_sql() -> str:
    q, terms = "shared parser", ["parser", "shared"]
    hits = lambda v: " + ".join(f"contains({_low(v)}, '{t}')::INT" for t in terms)
    best = lambda values: f"(SELECT list_min(list_transform(list_filter({values}, lambda v: ({hits('v')}) > 0), lambda v: {{'n': -({hits('v')}), 'v': v}})).v)"
    lines = r"string_split_regex(body, '\r?\n')"
    return _score_sql(q) + f""", top AS (SELECT *, row_number() OVER (ORDER BY score, path) AS rank FROM sc QUALIFY rank <= 25),
      p AS (SELECT *, CASE WHEN NOT exact AND s4 = score THEN {best('headings')} END AS h, CASE WHEN NOT exact AND s5 = score THEN {best(lines)} END AS l FROM top)
      SELECT rank, id, substr(coalesce(h, l, CASE WHEN coalesce(body, '') = '' THEN raw ELSE body END), 1, 500) AS snippet,
        CASE WHEN h IS NOT NULL THEN 'headings' WHEN l IS NOT NULL OR coalesce(body, '') <> '' THEN 'body' ELSE 'raw' END AS snippet_source FROM p"""


SQL = {
    "search_scores": _score_sql("Quiet Network") + " SELECT id, score, category FROM sc",
    "search_rank": _score_sql("budget") + " SELECT row_number() OVER (ORDER BY score, path) AS rank, id, score FROM sc ORDER BY score, path LIMIT 20",
    "search_tags": _score_sql("garden", "list_contains(tags, 'roadmap')") + " SELECT id, score FROM sc",
    "search_snippet": _score_sql("shared parser") + """ SELECT rank, id, CASE WHEN NOT exact AND list_contains([CASE WHEN s4 = score THEN 1 END], 1) THEN 'headings' ELSE 'body' END AS snippet_source
        FROM (SELECT *, row_number() OVER (ORDER BY score, path) AS rank FROM sc) WHERE rank <= 10""",
    "search_structural": _score_sql("network") + """, ind AS (SELECT DISTINCT src AS doc, dst AS dir, round(edge_weight * 100)::BIGINT AS w FROM edge WHERE t = 'md_in_directory'),
        par AS (SELECT DISTINCT src AS child, dst AS parent FROM edge WHERE t = 'md_parent_directory'),
        m AS (SELECT sc.id, sc.score = (SELECT min(score) FROM sc) AS anchor, dir, w FROM sc JOIN ind ON ind.doc = sc.id),
        ev AS (
          SELECT DISTINCT a.id, 'same' AS kind, a.dir AS via, least(a.w, b.w) AS w FROM m a JOIN m b ON b.anchor AND b.dir = a.dir AND b.id <> a.id
          UNION SELECT DISTINCT a.id, 'near', b.dir, least(a.w, b.w) FROM m a JOIN par p ON p.child = a.dir JOIN m b ON b.anchor AND b.dir = p.parent AND b.id <> a.id
          UNION SELECT DISTINCT a.id, 'near', a.dir, least(a.w, b.w) FROM m a JOIN par p ON p.parent = a.dir JOIN m b ON b.anchor AND b.dir = p.child AND b.id <> a.id)
        SELECT sc.id, sc.score, coalesce((SELECT sum(w) FROM ev WHERE ev.id = sc.id), 0)::BIGINT AS signal FROM sc""",
    "context_both": f"WITH {_VAULT}, {_bfs_sql('SELECT doc_id AS id FROM search_items', 2, _BOTH)} SELECT id, depth::BIGINT AS depth FROM v2",
    "context_edges_out": f"""WITH {_VAULT}, {_bfs_sql('SELECT doc_id AS id FROM search_items', 2, "SELECT src AS at, dst AS nxt, id AS edge FROM edge WHERE t IN ('md_up', 'md_related', 'md_next')")}
        SELECT edge AS id, min(depth)::BIGINT AS depth FROM (SELECT edge, 1 AS depth FROM t1 UNION ALL SELECT edge, 2 FROM t2) GROUP BY edge""",
    "context_label_filter": f"""WITH {_VAULT} SELECT id, 0::BIGINT AS depth FROM md_directories
        UNION SELECT src, 1 FROM edge JOIN md_directories d ON d.id = dst JOIN doc ON doc.id = src""",
    "induced_subgraph": f"WITH {_VAULT} SELECT e.id, src, dst, upper(t) AS type FROM edge e JOIN doc a ON a.id = src JOIN doc b ON b.id = dst WHERE a.ext = 'mdx' AND b.ext = 'mdx'",
    "health_orphans": f"WITH {_VAULT} {_ORPHAN}",
    "health_aliases": f"WITH {_VAULT} {_AMBIGUOUS}",
    "health_metadata": f"WITH {_NEWEST} SELECT root, path, {_MISSING} AS missing FROM newest WHERE {_MISSING} <> ''",
    "health_duplicate_links": f"WITH {_VAULT} SELECT src, t AS etype, dst, count(*) AS n FROM edge GROUP BY ALL HAVING count(*) > 1",
    "health_report": f"""WITH {_VAULT}, {_NEWEST}, {_KINDS}, c AS (
        SELECT 'missing_tombstoned_markdown_documents' AS "check", count(*) AS n FROM stale WHERE kind IN ('missing_file', 'tombstoned_document')
        UNION ALL SELECT 'stale_current_markdown_documents', count(*) FROM stale WHERE kind = 'hash_mismatch'
        UNION ALL SELECT 'markdown_documents_missing_source_metadata', count(*) FROM doc WHERE {_empty_of({"root": "root", "path": "path", "source_hash": "source_hash", "status": "status"})} <> ''
        UNION ALL SELECT 'stale_items', count(*) FROM stale UNION ALL SELECT 'orphan_items', count(*) FROM ({_ORPHAN})
        UNION ALL SELECT 'duplicate_current_markdown_document_paths', count(*) FROM (SELECT root, path FROM doc WHERE lower(trim(status)) = 'current' GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'duplicate_connector_owned_md_links_to_edges', coalesce(sum(n), 0) FROM (SELECT count(*) - 1 AS n FROM edge WHERE t = 'md_links_to' GROUP BY src, dst)
        UNION ALL SELECT 'ambiguous_markdown_aliases', count(*) FROM ({_AMBIGUOUS})),
        v AS (SELECT "check", CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status, n::BIGINT::VARCHAR AS value FROM c
        UNION ALL SELECT * FROM (VALUES ('last_tx_id', 'pass', '0'), ('wal_records', 'pass', '0'), ('recovered_tail', 'pass', 'false'), ('schema_indexes', 'pass', '3')))
        SELECT * FROM v UNION ALL SELECT 'status', CASE WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END, CASE WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END FROM v""",
    "health_stale": f"WITH {_VAULT}, {_NEWEST}, {_KINDS} SELECT id, kind FROM stale",
    "reindex_report": """SELECT * FROM (VALUES ('idx_label_Customer_c_acctbal', 'Customer', 'c_acctbal', 'range', 'ready', false), ('idx_label_Customer_c_custkey', 'Customer', 'c_custkey', 'eq', 'ready', false),
        ('idx_label_Part_p_name', 'Part', 'p_name', 'fulltext', 'ready', false)) t(name, target, property, kind, status, created)""",
    "citation_graph": f"WITH {_NEWEST}, a AS (SELECT root, path, {_empty_of({'path': 'path', 'status': 'src_status', 'source_hash': 'source_hash'})} AS failures FROM newest) SELECT * FROM a WHERE failures <> ''",
    "citation_query": f"WITH {_VAULT} SELECT path, concat_ws(',', CASE WHEN coalesce(trim(path), '') = '' THEN 'path' END, CASE WHEN coalesce(trim(status), '') = '' THEN 'status' END, 'source_hash') AS failures FROM doc WHERE ext = 'mdx'",
    "graph_snapshot_nodes": f"WITH {_VAULT} SELECT root || chr(10) || path AS key, lower(trim(status)) AS status, title FROM doc UNION ALL SELECT 'dir:' || root || chr(10) || path, lower(trim(status)), NULL FROM md_directories",
    "graph_snapshot_diff": f"""WITH {_VAULT}, {_NEWEST}, a AS (SELECT root || chr(10) || path AS key, lower(trim(src_status)) AS st, source_hash AS h FROM newest), b AS (SELECT root || chr(10) || path AS key, lower(trim(status)) AS st, source_hash AS h FROM doc)
        SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key
        WHERE a.key IS NULL OR b.key IS NULL OR a.st IS DISTINCT FROM b.st OR a.h IS DISTINCT FROM b.h""",
    "viewer_subgraph": f"""WITH {_VAULT}, n AS (SELECT id FROM doc WHERE ext = 'mdx' ORDER BY id LIMIT 40)
        SELECT id, src, dst, upper(t) AS type FROM edge WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
    "viewer_radius": f"WITH {_VAULT}, {_bfs_sql('SELECT min(id) AS id FROM doc WHERE ext = ' + chr(39) + 'mdx' + chr(39), 2, _BOTH)} SELECT id FROM v2 ORDER BY depth, id LIMIT 60",
    "context_budget": _STEP + " SELECT 'node' AS kind, id, depth::BIGINT AS depth FROM n UNION ALL SELECT 'edge', id, 1 FROM k",
    "context_rows": _STEP + """ SELECT 'seed:node' AS row, 0::BIGINT AS depth, s::VARCHAR AS id, 'node' AS label_or_type, s::VARCHAR AS display, '' AS source, '' AS target FROM s
        UNION ALL SELECT 'node', n.depth, n.id::VARCHAR, label, coalesce(title, path, ''), '', '' FROM n JOIN about USING (id)
        UNION ALL SELECT 'edge', 1, id::VARCHAR, upper(t), CASE d WHEN 0 THEN 'out' ELSE 'in' END, src::VARCHAR, dst::VARCHAR FROM k""",
    "context_lines": _STEP + " SELECT 'context_meta' AS kind, NULL::BIGINT AS id UNION ALL SELECT 'context_seed', NULL UNION ALL SELECT 'context_node', id FROM n UNION ALL SELECT 'context_edge', id FROM k",
    "context_evidence": _STEP + """ SELECT kind, id, field, value FROM (
        SELECT 'node' AS kind, id, unnest(['title', 'path', 'status', 'labels']) AS field, unnest([title, path, status, label]) AS value FROM n JOIN about USING (id)
        UNION ALL SELECT 'edge', id, unnest(['edge_id', 'traversal']), unnest([id::VARCHAR, 'seed ' || s || ' reached node ' || CASE d WHEN 0 THEN dst ELSE src END || ' via ' || CASE d WHEN 0 THEN 'out' ELSE 'in' END || ' edge at depth 1']) FROM k, s) WHERE value IS NOT NULL""",
    "context_payload": "SELECT true AS fits, true AS own_size, 0::BIGINT AS n_edges, 0::BIGINT AS first_depth, true AS truncated",
    "seed_paths": f"""WITH {_VAULT}, one AS (SELECT * FROM doc WHERE path IN (SELECT path FROM doc GROUP BY path HAVING count(*) = 1))
        SELECT 'seed' AS kind, unnest([(SELECT min(id) FROM md_documents), (SELECT min(id) FROM one WHERE lower(trim(status)) = 'current'), (SELECT min(id) FROM one WHERE lower(trim(status)) = 'missing')])::VARCHAR AS value
        UNION SELECT 'warning', unnest(['context_seed_duplicate', 'context_seed_stale'])""",
    "search_truncated": _score_sql("budget") + f""", t AS (SELECT *, count(*) OVER () > 7 AS truncated, row_number() OVER (ORDER BY score, path) AS rank FROM sc)
        SELECT rank, id, truncated, category, CASE WHEN exact THEN concat_ws(',', CASE WHEN {_low('title')} = 'budget' THEN 'title' END, CASE WHEN {_low('path')} = 'budget' THEN 'path' END)
          ELSE concat_ws(',', CASE WHEN s0 = score THEN 'title' END, CASE WHEN s1 = score THEN 'path' END, CASE WHEN s2 = score THEN 'aliases' END, CASE WHEN s3 = score THEN 'tags' END, CASE WHEN s4 = score THEN 'headings' END, CASE WHEN s5 = score THEN 'body' END) END AS fields
        FROM t WHERE rank <= 7""",
    "search_snippet_text": _snippet_sql(),
    "get_document": f"""WITH {_VAULT}, t AS (SELECT *, count(*) OVER (PARTITION BY {_low('title')}) AS n FROM doc)
        SELECT 'id' AS asked, id, path FROM doc WHERE id = (SELECT min(id) FROM doc) UNION ALL SELECT 'title', id, path FROM t WHERE id = (SELECT min(id) FROM t WHERE n = 1)""",
    "list_documents": f"WITH {_VAULT} SELECT id, path, title FROM doc ORDER BY path, id LIMIT 50",
    "semantic_unconfigured": "SELECT false AS ok, 'unconfigured' AS code",
    "graph_snapshot_edges": f"""WITH {_VAULT}, k AS (SELECT id, root || chr(10) || path AS key FROM doc UNION ALL SELECT id, 'dir:' || root || chr(10) || path FROM md_directories)
        SELECT DISTINCT a.key || '|' || t || '|' || b.key AS key FROM edge JOIN k a ON a.id = src JOIN k b ON b.id = dst""",
    "check_unique": f"WITH {_VAULT} SELECT title, count(*) AS n FROM doc WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1",
    "check_required": f"WITH {_VAULT} SELECT id FROM doc WHERE aliases IS NULL",
    "check_endpoints": f"WITH {_VAULT} SELECT id, src, dst FROM edge WHERE t = 'md_up' AND (src NOT IN (SELECT id FROM doc) OR dst NOT IN (SELECT id FROM doc))",
    "check_max_outgoing": f"WITH {_VAULT} SELECT src, count(*) AS n FROM edge WHERE t = 'md_links_to' GROUP BY src HAVING count(*) > 6",
    "check_duplicate_edges": f"WITH {_VAULT} SELECT src, upper(t) AS type, dst, count(*) AS n FROM edge GROUP BY ALL HAVING count(*) > 1",
}

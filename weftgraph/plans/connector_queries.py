"""The Markdown connector over the raw texts of the vault tables, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.graph_queries import _VAULT
from weftgraph.session import Scratch
from weftgraph.sources.markdown import DIRECTORY_WEIGHT, directory_paths, link_edges, merge_documents, parse_notes, resolve_links, sync_report
from weftgraph.sources.tables import current_documents, latest, table, tidy

#: The state that a sync meets: what was loaded before this time.
AS_OF = "2025-07-01"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    docs = current_documents(table(spark, d, "md_documents"), ["root", "path", "raw"])
    return parse_notes(docs.withColumnRenamed("raw", "content"), ["id"])


def note_split(spark, d):
    return _parsed(spark, d).select("id", "has_frontmatter", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def note_yaml(spark, d):
    entries = F.explode(F.from_json("frontmatter", "map<string,string>"))
    rows = _parsed(spark, d).where("frontmatter IS NOT NULL").select("id", entries.alias("name", "v"))
    items = F.array_join(F.from_json("v", "array<string>"), "\n")
    return rows.select("id", "name", F.when(F.col("v").startswith("["), F.coalesce(items, "v")).otherwise(F.col("v")).alias("items"))


def note_headings(spark, d):
    return _parsed(spark, d).select("id", F.posexplode("headings").alias("pos", "heading")).select("id", F.col("pos").cast("bigint").alias("pos"), "heading")


def note_tags(spark, d):
    return _parsed(spark, d).select("id", F.explode("tags").alias("tag"))


def note_links(spark, d):
    refs = _parsed(spark, d).select("id", F.explode("refs").alias("r"))
    return refs.where("r.source = 'body'").select("id", "r.target").distinct()


def note_relations(spark, d):
    refs = _parsed(spark, d).select("id", F.explode("refs").alias("r"))
    return refs.where("r.source = 'frontmatter'").select("id", "r.relation", "r.target").distinct()


def note_titles(spark, d):
    return _parsed(spark, d).select("id", "title")


def note_hash(spark, d):
    return _parsed(spark, d).select("id", "source_hash")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "notes")
    return resolve_links(scratch.cut(_parsed(spark, d).select("id", "root", "path", "refs", "keys"), "parsed"))


def note_resolve(spark, d):
    return _resolved(spark, d).select("src", "target", "relation", "dst").distinct()


def note_edges(spark, d):
    e = link_edges(_resolved(spark, d))
    text = lambda c: F.array_join(c, "\n")
    return e.select("src", "dst", "type", "link_target", text("link_targets").alias("targets"), text("link_sources").alias("sources"), text("link_rels").alias("rels"), "status")


def note_directories(spark, d):
    docs = current_documents(table(spark, d, "md_documents"), ["root", "path"]).where("path IS NOT NULL")
    return directory_paths(docs).select("root", "path", "parent", F.lit(DIRECTORY_WEIGHT).alias("edge_weight"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """A sync of all vaults: what was loaded before AS_OF meets the current documents."""
    rows = table(spark, d, "md_documents")
    old = latest(rows.where(F.col("loaded_at") < F.lit(AS_OF).cast("timestamp")).select("id", "root", "path", "source_hash", "status", "synced_at", "loaded_at", "aliases"), ["id"], ["synced_at", "loaded_at"])
    old = old.select("id", "root", "path", "source_hash", "status", F.size("aliases").alias("user_note"))
    scan = current_documents(rows, ["root", "path", "source_hash", "status", "title"]).where(~F.coalesce(tidy("status") == "missing", F.lit(False)))
    scan = scan.select("root", "path", "source_hash", F.lit("current").alias("status"), "title")
    roots = [r[0] for r in scan.select("root").distinct().collect()]  # one per vault that is synced
    return merge_documents(old, scan, roots)


def note_sync(spark, d):
    return _merged(spark, d).select("root", "path", "id", "source_hash", "status", "title", F.col("user_note").cast("bigint").alias("user_note"), "change")


def note_report(spark, d):
    counts = sync_report(Scratch(spark, "merge").cut(_merged(spark, d)), _resolved(spark, d))
    return spark.createDataFrame(list(counts.items()), "counter string, n bigint")


QUERIES = {f.__name__: f for f in (note_split, note_yaml, note_headings, note_tags, note_links, note_relations, note_titles, note_hash, note_resolve, note_edges, note_directories, note_sync, note_report)}

_LINES = "string_split(body, chr(10))"
_TAG = r"(?:^|[\s\p{Z}(\[{])#([A-Za-z0-9_/-]+)"
_FRONT = "front AS (SELECT doc.id, doc.root, doc.path, u.key AS name, u.value AS v, u.type AS kind FROM doc, LATERAL json_each(frontmatter) u)"


def _items(names: str) -> str:
    """Strings of scalar or list entries of the front matter."""
    return f"""SELECT id, name, x FROM (
      SELECT id, name, unnest(CASE WHEN kind = 'ARRAY' THEN from_json(v, '["VARCHAR"]') WHEN kind = 'VARCHAR' THEN [v ->> '$'] ELSE [] END) AS x FROM front WHERE name IN ({names})) WHERE x IS NOT NULL"""


def _listed(first: str, second: str) -> str:
    """Entries of the first of two keys: a list, or a text cut at commas."""
    return f"""SELECT id, x FROM (SELECT id, unnest(CASE WHEN kind = 'ARRAY' THEN from_json(v, '["VARCHAR"]') WHEN kind = 'VARCHAR' THEN list_filter(list_transform(string_split(v ->> '$', ','), lambda y: trim(y)), lambda y: y <> '') ELSE [] END) AS x
      FROM front WHERE kind IN ('ARRAY', 'VARCHAR') AND (name = '{first}' OR name = '{second}' AND id NOT IN (SELECT id FROM front WHERE name = '{first}' AND kind IN ('ARRAY', 'VARCHAR')))) WHERE x IS NOT NULL"""


_WIKI = r"list_transform(regexp_extract_all(body, '(?s)\[\[(.*?)\]\]', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))"
_MARK = r"list_filter(list_transform(regexp_extract_all(body, '(?s)\[.*?\]\(([^)]*)\)', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: NOT starts_with(x, '#'))"
_BODY_LINKS = f"SELECT DISTINCT id, target FROM (SELECT id, unnest({_WIKI} || {_MARK}) AS target FROM doc) WHERE target <> ''"
_RELATIONS = rf"""SELECT DISTINCT id, CASE WHEN name IN ('up', 'parent') THEN 'up' WHEN name IN ('link', 'links') THEN 'link' ELSE name END AS relation, target FROM (
  SELECT id, name, CASE WHEN regexp_matches(trim(x), '(?s)^\[\[.*\]\]$') THEN trim(trim(x)[3 : -3]) ELSE trim(x) END AS target FROM ({_items("'up', 'parent', 'related', 'next', 'previous', 'link', 'links'")})) WHERE target <> ''"""


def _stem(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\.mdx?$', '')"


def _style(x: str) -> str:
    p = rf"string_split(regexp_replace(trim({_stem(f'replace(trim({x}), chr(92), chr(47))')}, '/'), '/index$', ''), '/')"
    return rf"""(SELECT nullif(lower(array_to_string(list_filter(CASE
      WHEN lower(p[1]) = 'docs' AND len(p) > 1 THEN p[2:]
      WHEN len(p) > 2 AND lower(p[2]) = 'docs' AND (regexp_matches(p[1], '^[A-Za-z0-9]{{2}}$') OR contains(p[1], '-') AND regexp_matches(p[1], '^[A-Za-z0-9-]{{3,12}}$')) THEN p[3:]
      ELSE p END, lambda y: y <> ''), '/')), '') FROM (SELECT {p} AS p))"""


def _slugs(x: str) -> str:
    bare = f"ltrim({x}, '/')"
    return ", ".join([x, bare, *[f"'{s}{p}' || {bare}" for p in ("", "docs/", "en-US/docs/") for s in ("", "/")]])


def _near(x: str) -> str:
    """Dots resolved; null above the root."""
    x = rf"regexp_replace('/' || {x} || '/', '/(\.?/)+', '/', 'g')"
    for _ in range(12):
        x = rf"regexp_replace({x}, '/(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\./', '/')"
    return x


_RESOLVED = rf"""WITH {_VAULT}, {_FRONT},
ref AS (SELECT id, relation, target FROM ({_RELATIONS}) UNION SELECT id, NULL, target FROM ({_BODY_LINKS})),
alias AS ({_listed('aliases', 'alias')}),
keyed AS (
  SELECT id, root, path, unnest([{{'t': 0, 'k': path}}, {{'t': 0, 'k': stem}}, {{'t': 0, 'k': nstem}}, {{'t': 1, 'k': up}}, {{'t': 4, 'k': lower(path)}}, {{'t': 4, 'k': lower(stem)}}, {{'t': 4, 'k': lower(nstem)}}, {{'t': 4, 'k': lower(up)}},
    {{'t': 5, 'k': s1}}, {{'t': 5, 'k': s2}}, {{'t': 5, 'k': s3}}]) AS o
  FROM (SELECT *, {_style('path')} AS s1, {_style('stem')} AS s2, {_style('up')} AS s3 FROM (
    SELECT id, root, path, {_stem('path')} AS stem, {_stem("regexp_extract(path, '([^/]*)$', 1)")} AS nstem, CASE WHEN regexp_matches(path, '(?i)/index\.mdx?$') THEN regexp_replace(path, '/[^/]*$', '') END AS up FROM doc WHERE raw IS NOT NULL))
  UNION ALL SELECT a.id, root, path, {{'t': 3, 'k': x}} FROM alias a JOIN doc USING (id)
  UNION ALL SELECT id, root, path, unnest(list_transform([{_slugs("x")}], lambda y: {{'t': 2, 'k': y}})) FROM (SELECT f.id, doc.root, doc.path, trim(v ->> '$') AS x FROM front f JOIN doc ON doc.id = f.id WHERE name = 'slug' AND kind = 'VARCHAR') WHERE x <> ''),
offer AS (SELECT root, o.t AS t, o.k AS k, arg_min(id, (path, id)) AS dst FROM keyed WHERE o.k IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) = 1 OR t = 0),
cut AS (
  SELECT r.*, root, path, trim(regexp_extract(CASE WHEN contains(t0, '://') THEN coalesce(nullif(regexp_extract(t0, '://[^/]*(/.*)$', 1), ''), '') ELSE t0 END, '^([^?#]*)', 1)) AS t
  FROM (SELECT *, trim(split_part(target, '|', 1)) AS t0 FROM ref) r JOIN doc USING (id)),
based AS (
  SELECT *, {_near(r"CASE WHEN starts_with(t, '/') THEN t ELSE regexp_replace(path, '/?[^/]*$', '') || '/' || rtrim(t, '/') || CASE WHEN regexp_matches(rtrim(t, '/'), '[^/]\.[^./]+$') THEN '' ELSE '.md' END END")} AS n0
  FROM cut WHERE t <> '' AND t <> '/'),
near AS (SELECT *, CASE WHEN n0 LIKE '/../%' OR n0 = '/' THEN NULL ELSE trim(n0, '/') END AS n, {_stem('t')} AS bare FROM based),
asked AS (
  SELECT id, root, relation, target, unnest(generate_series(1, len(c))) AS no, unnest(c) AS c FROM (
    SELECT *, [{{'t': 0, 'k': n}}, {{'t': 0, 'k': {_stem('n')}}}, {{'t': 1, 'k': n}}, {{'t': 1, 'k': {_stem('n')}}}, {{'t': 0, 'k': t}}, {{'t': 0, 'k': bare}}, {{'t': 1, 'k': t}}, {{'t': 1, 'k': bare}}]
      || list_transform([{_slugs('t')}], lambda y: {{'t': 2, 'k': y}}) || [{{'t': 3, 'k': t}}, {{'t': 3, 'k': bare}}]
      || list_transform([n, {_stem('n')}, t, bare], lambda y: {{'t': 4, 'k': lower(y)}}) || [{{'t': 5, 'k': z1}}, {{'t': 5, 'k': z2}}, {{'t': 5, 'k': z3}}, {{'t': 5, 'k': z4}}] AS c
    FROM (SELECT *, {_style('n')} AS z1, {_style(_stem('n'))} AS z2, {_style('t')} AS z3, {_style('bare')} AS z4 FROM near))),
hit AS (SELECT id, target, arg_min(dst, no) AS dst FROM asked a JOIN offer o ON o.root = a.root AND o.t = a.c.t AND o.k = a.c.k GROUP BY id, target),
res AS (SELECT r.id AS src, r.target, r.relation, h.dst FROM ref r LEFT JOIN hit h ON h.id = r.id AND h.target = r.target)"""

_SYNC = f"""WITH {_VAULT},
was AS (SELECT id, root, path, source_hash, status, len(aliases) AS user_note FROM md_documents WHERE loaded_at < TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at DESC NULLS LAST, loaded_at DESC) = 1),
now AS (SELECT root, path, source_hash, title FROM doc WHERE lower(trim(status)) IS DISTINCT FROM 'missing'),
m AS (
  SELECT coalesce(n.root, w.root) AS root, coalesce(n.path, w.path) AS path, w.id, CASE WHEN n.path IS NOT NULL THEN n.source_hash ELSE w.source_hash END AS source_hash,
    CASE WHEN n.path IS NOT NULL THEN 'current' WHEN w.root IN (SELECT root FROM now) THEN 'missing' ELSE w.status END AS status, n.title, w.user_note::BIGINT AS user_note,
    CASE WHEN n.path IS NOT NULL THEN CASE WHEN w.path IS NULL THEN 'created' WHEN lower(trim(w.status)) = 'missing' THEN 'revived' WHEN n.source_hash IS DISTINCT FROM w.source_hash THEN 'updated' ELSE 'unchanged' END
      WHEN w.root IN (SELECT root FROM now) AND coalesce(lower(trim(w.status)), '') <> 'missing' THEN 'tombstoned' ELSE 'kept' END AS change
  FROM now n FULL JOIN was w ON w.root = n.root AND w.path = n.path)"""

_TYPED = """CASE relation WHEN 'up' THEN 'MD_UP' WHEN 'related' THEN 'MD_RELATED' WHEN 'next' THEN 'MD_NEXT' WHEN 'previous' THEN 'MD_PREVIOUS' ELSE 'MD_LINKS_TO' END"""
SQL = {
    "note_split": f"WITH {_VAULT} SELECT id, has_frontmatter, md5(body) AS body_md5 FROM doc",
    "note_yaml": f"""WITH {_VAULT}, {_FRONT} SELECT id, name, CASE WHEN kind = 'ARRAY' THEN array_to_string(from_json(v, '["VARCHAR"]'), chr(10)) ELSE v ->> '$' END AS items FROM front""",
    "note_headings": f"WITH {_VAULT} SELECT id, u.pos - 1 AS pos, headings[u.pos] AS heading FROM doc, LATERAL (SELECT unnest(generate_series(1, len(headings))) AS pos) u",
    "note_tags": rf"""WITH {_VAULT}, {_FRONT}, line AS (SELECT id, unnest({_LINES}) AS l FROM doc)
        SELECT id, x AS tag FROM ({_listed('tags', 'tag')}) UNION SELECT id, unnest(regexp_extract_all(l, '{_TAG}', 1)) FROM line WHERE NOT regexp_matches(l, '^\s*# ')""",
    "note_links": f"WITH {_VAULT} {_BODY_LINKS}",
    "note_relations": f"WITH {_VAULT}, {_FRONT} {_RELATIONS}",
    "note_titles": f"WITH {_VAULT} SELECT id, title FROM doc",
    "note_hash": f"WITH {_VAULT} SELECT id, substr(sha256(raw), 1, 16) AS source_hash FROM doc",
    "note_resolve": _RESOLVED + " SELECT DISTINCT src, target, relation, dst FROM res",
    "note_edges": _RESOLVED + f""", t AS (SELECT src, dst, target, relation, {_TYPED} AS type FROM res WHERE dst IS NOT NULL),
        every_edge AS (SELECT * FROM t UNION ALL SELECT src, dst, target, relation, 'MD_LINKS_TO' FROM t WHERE type <> 'MD_LINKS_TO')
        SELECT src, dst, type, min(target) AS link_target, array_to_string(list_sort(list(DISTINCT target)), chr(10)) AS targets, array_to_string(list_sort(list(DISTINCT CASE WHEN relation IS NULL THEN 'body' ELSE 'frontmatter' END)), chr(10)) AS sources,
          coalesce(array_to_string(list_sort(list(DISTINCT relation) FILTER (WHERE relation IS NOT NULL)), chr(10)), '') AS rels, 'current' AS status FROM every_edge GROUP BY src, dst, type""",
    "note_directories": f"""WITH {_VAULT}, part AS (SELECT root, CASE WHEN contains(path, '/') THEN string_split(regexp_replace(path, '/[^/]*$', ''), '/') ELSE [] END AS p FROM doc WHERE path IS NOT NULL),
        up AS (SELECT DISTINCT root, array_to_string(p[1 : n], '/') AS path FROM (SELECT root, p, unnest(generate_series(0, len(p))) AS n FROM part))
        SELECT root, CASE WHEN path = '' THEN '.' ELSE path END AS path, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent, {DIRECTORY_WEIGHT}::DOUBLE AS edge_weight FROM up""",
    "note_sync": _SYNC + " SELECT root, path, id, source_hash, status, title, user_note, change FROM m",
    "note_report": f"""SELECT u.counter, u.n::BIGINT AS n FROM (SELECT unnest([{{'counter': 'scanned', 'n': a}}, {{'counter': 'created', 'n': b}}, {{'counter': 'updated', 'n': c}}, {{'counter': 'revived', 'n': d}}, {{'counter': 'tombstoned', 'n': e}}, {{'counter': 'links', 'n': f}}, {{'counter': 'resolved', 'n': g}}, {{'counter': 'unresolved', 'n': f - g}}]) AS u FROM
        (SELECT count(*) FILTER (change IN ('created', 'updated', 'revived', 'unchanged')) AS a, count(*) FILTER (change = 'created') AS b, count(*) FILTER (change = 'updated') AS c, count(*) FILTER (change = 'revived') AS d, count(*) FILTER (change = 'tombstoned') AS e
          FROM ({_SYNC} SELECT * FROM m)), (SELECT count(*) AS f, count(dst) AS g FROM ({_RESOLVED} SELECT * FROM res)))""",
}

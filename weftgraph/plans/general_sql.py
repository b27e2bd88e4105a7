"""DuckDB statements with the results of the general queries."""

from __future__ import annotations

_LIVE = """
edge AS (
  SELECT id, src, dst, lower(trim(edge_type)) AS etype, valid_from FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM graph_edges) t
  WHERE rn = 1 AND lower(trim(status)) = 'current' AND valid_to IS NULL)"""

_FOREST = f"""
WITH RECURSIVE {_LIVE},
own AS (
  SELECT CASE WHEN etype = 'md_up' THEN 'up' ELSE 'directory' END AS forest, src, dst, valid_from, id FROM edge
  WHERE etype IN ('md_up', 'md_in_directory', 'md_parent_directory') AND src IS NOT NULL AND dst IS NOT NULL),
par AS (
  SELECT forest, src, dst FROM (
    SELECT *, row_number() OVER (PARTITION BY forest, src ORDER BY valid_from DESC NULLS LAST, id DESC) AS rn FROM own) t WHERE rn = 1),
node AS (SELECT forest, src AS node FROM own UNION SELECT forest, dst FROM own),
anc AS (
  SELECT forest, src AS node, dst AS up FROM par
  UNION SELECT a.forest, a.node, p.dst FROM anc a JOIN par p ON p.forest = a.forest AND p.src = a.up),
tops AS (SELECT n.forest, n.node FROM node n ANTI JOIN par p ON p.forest = n.forest AND p.src = n.node),
res AS (
  SELECT n.forest, n.node,
    CASE WHEN t.node IS NOT NULL THEN n.node ELSE (SELECT max(a.up) FROM anc a JOIN tops x ON x.forest = a.forest AND x.node = a.up WHERE a.forest = n.forest AND a.node = n.node) END AS root,
    (SELECT count(*) FROM anc a WHERE a.forest = n.forest AND a.node = n.node) AS depth,
    EXISTS (SELECT 1 FROM anc a WHERE a.forest = n.forest AND a.node = n.node AND a.up = n.node) AS looped
  FROM node n LEFT JOIN tops t ON t.forest = n.forest AND t.node = n.node)
"""

P2_FOUND = _FOREST + """
SELECT forest, node AS node_id, coalesce(root, -1) AS root_id, CASE WHEN root IS NULL THEN -1 ELSE depth END AS node_depth,
  CASE WHEN looped THEN 1::BIGINT ELSE 0::BIGINT END AS on_cycle FROM res"""

P2_DESCENDANTS = _FOREST + """
, good AS (SELECT forest, node, depth FROM res WHERE root IS NOT NULL)
SELECT a.forest, a.up AS node_id, a.node AS descendant_id, g.depth - u.depth AS distance
FROM anc a JOIN good g ON g.forest = a.forest AND g.node = a.node JOIN good u ON u.forest = a.forest AND u.node = a.up"""

P2_PATHS = _FOREST + """
, good AS (SELECT forest, node, depth FROM res WHERE root IS NOT NULL),
line AS (SELECT a.forest, a.node, a.up, u.depth FROM anc a JOIN good u ON u.forest = a.forest AND u.node = a.up
         UNION ALL SELECT forest, node, node, depth FROM good)
SELECT l.forest, l.node AS node_id, string_agg(l.up::VARCHAR, '/' ORDER BY l.depth) AS id_path, max(g.depth) AS node_depth
FROM line l JOIN good g ON g.forest = l.forest AND g.node = l.node GROUP BY l.forest, l.node"""


def _normal(x: str) -> str:
    return rf"regexp_replace(replace(regexp_replace(nfc_normalize({x}), '^\s+|\s+$', '', 'g'), '\', '/'), '^(\./+)+', '')"


def _key(x: str) -> str:
    k = rf"regexp_replace(lower({x}), '^[/\s]+|[/\s]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({k}, '^docs/', ''), '\.mdx?$', ''), '/index$', '')"


def _fold(x: str) -> str:
    x = f"'/' || {x}"
    x = rf"regexp_replace({x}, '/(\./)+', '/', 'g')"
    for _ in range(12):
        x = rf"regexp_replace(regexp_replace({x}, '^(/\.\.)+/', '/'), '/[^/]+/\.\./', '/')"
    return x


_BARE = r"regexp_replace(regexp_extract(target, '^([^|?#]*)', 1), '^\s+|\s+$', '', 'g')"

def _orphans(m: str, start: str, source: str) -> str:
    """The orphans; with a column ``m`` of load months, those open at the end of each."""
    by, on, cols = (f"{m}, ", f"x.{m} = y.{m} AND ", f"{m}, ") if m else ("", "", "")
    return f"""
WITH {start} doc AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}id ORDER BY synced_at DESC NULLS LAST, loaded_at DESC) AS rn FROM {source.format('md_documents')}) t WHERE rn = 1),
ref AS (
  SELECT {cols}'md_link_refs' AS ref_table, ref_id AS row_key, 0 AS pos, root, any_value(src_path) AS home, any_value(raw_target) AS target, any_value(seen_at) AS ref_at
  FROM {source.format('md_link_refs')} GROUP BY {by}ref_id, root
  UNION ALL
  SELECT {cols}'md_documents', id, u.pos - 1, root, path, links[u.pos], synced_at FROM doc, LATERAL (SELECT unnest(generate_series(1, len(links))) AS pos) u),
cut AS (SELECT *, {_BARE} AS bare FROM ref),
dec AS (
  SELECT *, replace(regexp_replace(nfc_normalize(url_decode(bare)), '^\\s+|\\s+$', '', 'g'), '\\', '/') AS t
  FROM cut WHERE NOT contains(target, '://') AND (contains(bare, '/') OR contains(bare, '\\') OR regexp_matches(lower(bare), '\\.mdx?$'))),
keyed AS (
  SELECT *, CASE WHEN starts_with(t, './') OR starts_with(t, '../')
    THEN regexp_replace({_normal("home")}, '[^/]*$', '') || t ELSE t END AS whole FROM dec),
probe AS (SELECT {cols}ref_table, row_key, pos, root, ref_at, {_key(_fold("whole"))} AS k FROM keyed),
canon AS (SELECT DISTINCT {_key(_normal("path"))} AS k FROM canon_pages),
idx AS (
  SELECT {cols}root, {_key(_normal("path"))} AS k, min(valid_from) FILTER (WHERE lower(trim(status)) <> 'missing') AS since FROM doc GROUP BY ALL),
edge AS (
  SELECT {cols}id, any_value(dst) AS dst, any_value(valid_from) AS ref_at FROM {source.format('graph_edges')}
  WHERE lower(trim(status)) = 'current' AND valid_to IS NULL GROUP BY {by}id),
ids AS (
  SELECT {cols}id, CASE WHEN lower(trim(status)) <> 'missing' THEN valid_from END AS since FROM doc
  UNION ALL SELECT {cols}id, CASE WHEN lower(trim(status)) <> 'missing' THEN valid_from END FROM md_directories{', month' if m else ''}),
judged AS (
  SELECT {'x.m, ' if m else ''}ref_table, row_key, pos, ref_at, CASE WHEN y.k IS NULL THEN 'missing' WHEN since IS NULL THEN 'deleted' WHEN since > ref_at THEN 'late' END AS kind
  FROM probe x LEFT JOIN idx y ON {on}y.root = x.root AND y.k = x.k WHERE x.k NOT IN (SELECT k FROM canon)
  UNION ALL
  SELECT {'x.m, ' if m else ''}'graph_edges', x.id, 0, ref_at, CASE WHEN y.id IS NULL THEN 'missing' WHEN since IS NULL THEN 'deleted' WHEN since > ref_at THEN 'late' END
  FROM edge x LEFT JOIN ids y ON {on}y.id = x.dst WHERE x.dst IS NOT NULL)
SELECT {cols}ref_table, row_key, pos::BIGINT AS pos, kind, strftime(ref_at, '%Y-%m') AS ref_month FROM judged WHERE kind IS NOT NULL"""


P3_FOUND = _orphans("", "", "{}")
P3_COUNTS = f"SELECT ref_table, kind, ref_month, count(*) AS n_refs FROM ({P3_FOUND}) GROUP BY ALL"
_MONTHS = """month AS (SELECT DISTINCT strftime(loaded_at, '%Y-%m') AS m FROM (SELECT loaded_at FROM md_documents
  UNION ALL SELECT loaded_at FROM md_link_refs UNION ALL SELECT loaded_at FROM graph_edges WHERE lower(trim(status)) = 'current' AND valid_to IS NULL)),"""
P3_SNAPSHOTS = f"""SELECT m AS load_period, ref_table, kind, ref_month, count(*) AS n_refs FROM (
  {_orphans("m", _MONTHS, "(SELECT m, t.* FROM month JOIN {} t ON strftime(loaded_at, '%Y-%m') <= m)")}) GROUP BY ALL"""

P6_FOUND = f"""
WITH rec AS (
  SELECT snapshot_no, root, path, hash, st FROM (
    SELECT snapshot_no, root, {_normal("path")} AS path, lower(trim(source_hash)) AS hash, lower(trim(src_status)) AS st,
      row_number() OVER (PARTITION BY snapshot_no, root, {_normal("path")} ORDER BY loaded_at DESC NULLS LAST) AS rn FROM context_nodes
    WHERE root IS NOT NULL AND path IS NOT NULL AND snapshot_no IS NOT NULL) t WHERE rn = 1),
pairs AS (
  SELECT root, snapshot_no, lag(snapshot_no) OVER (PARTITION BY root ORDER BY snapshot_no) AS prev
  FROM (SELECT DISTINCT root, snapshot_no FROM rec)),
now AS (SELECT r.*, p.prev FROM rec r JOIN pairs p USING (root, snapshot_no) WHERE p.prev IS NOT NULL),
was AS (SELECT p.snapshot_no, r.root, r.path, r.hash, r.st FROM rec r JOIN pairs p ON p.root = r.root AND p.prev = r.snapshot_no)
SELECT coalesce(n.snapshot_no, w.snapshot_no) AS snapshot_no, coalesce(n.root, w.root) AS root, coalesce(n.path, w.path) AS path,
  CASE WHEN w.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM now n FULL JOIN was w ON n.root = w.root AND n.path = w.path AND n.snapshot_no = w.snapshot_no
WHERE w.path IS NULL OR n.path IS NULL OR n.hash IS DISTINCT FROM w.hash OR n.st IS DISTINCT FROM w.st"""

SQL = {"p2_found": P2_FOUND, "p2_paths": P2_PATHS, "p2_descendants": P2_DESCENDANTS, "p3_found": P3_FOUND, "p3_counts": P3_COUNTS, "p3_snapshots": P3_SNAPSHOTS, "p6_found": P6_FOUND}

"""DuckDB statements with the results of queries that SQL can express."""

from __future__ import annotations

from weftgraph.llm.canonical import MAX_EDITS, MIN_FRAMED, OUTER_WORDS, STEPS, STOP, base_letters

_DOC = """
doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY synced_at DESC NULLS LAST, loaded_at DESC) AS rn FROM md_documents) t WHERE rn = 1)"""

_TERMS = f"""
WITH {_DOC},
words AS (
  SELECT id, unnest(regexp_extract_all(lower(concat_ws(chr(10), title, array_to_string(headings, chr(10)), body)), '\\p{{L}}+')) AS term FROM doc),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
st AS (
  SELECT term, count(*) AS df, 1 + (sum(tf * ln(tf)) / sum(tf) - ln(sum(tf))) / (SELECT ln(count(*)) FROM doc) AS g FROM tf GROUP BY term)"""

_TAGS = f"""
WITH {_DOC},
item AS (
  SELECT DISTINCT id, tag FROM (
    SELECT id, regexp_replace(lower(trim(u.t)), '^(#\\s*)+|\\s+$', '', 'g') AS tag FROM doc, LATERAL (SELECT unnest(tags) AS t) u) x WHERE tag <> ''),
one AS (SELECT tag, count(*) AS n FROM item GROUP BY tag),
two AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_both FROM item a JOIN item b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL),
pair AS (
  SELECT tag_a, tag_b, n_both, a.n AS n_a, b.n AS n_b, n_both * (SELECT count(*) FROM doc)::DOUBLE / (a.n::DOUBLE * b.n) AS lift
  FROM two JOIN one a ON a.tag = tag_a JOIN one b ON b.tag = tag_b)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _plain(x: str) -> str:
    """The chain of ``canonical.plain`` after brackets and capitals, as SQL."""
    a, b = base_letters()
    x = f"translate(lower({x}), {_quoted(a)}, {_quoted(b)})"
    for what, by, times in STEPS:
        for _ in range(times):
            x = f"regexp_replace({x}, {_quoted(what)}, {_quoted(by)}, 'g')"
    return f"trim(translate({x}, {_quoted(STOP)}, '.'))"


_PARTED = r"CASE WHEN regexp_matches(x, '[\s_.,-]') THEN x ELSE regexp_replace(x, '(\p{Ll})(\p{Lu})', '\1 \2', 'g') END"
_TARGET = r"trim(regexp_replace(regexp_extract(target, '^([^|?#]*)', 1), '^\s+|\s+$', '', 'g'))"


def _names(table: str, column: str) -> str:
    inner = rf"SELECT *, regexp_replace({column}, '\([^)]*\)', ' ', 'g') AS x FROM {table}"
    return f"SELECT *, coalesce({_plain('y')}, '') AS plain FROM (SELECT *, {_PARTED} AS y FROM ({inner}))"


_COST = """list_sum(list_transform(generate_series(1, len(w)), lambda i:
  CASE WHEN levenshtein(t[i], r[i]) = 0 THEN 0
    WHEN (w[i] LIKE '%.' AND length(t[i]) >= 3 AND starts_with(r[i], t[i])) OR (levenshtein(t[i], r[i]) <= 2 AND list_sort(string_split(t[i], '')) = list_sort(string_split(r[i], ''))) THEN 1
    WHEN levenshtein(t[i], r[i]) <= CASE WHEN length(r[i]) <= 5 THEN 1 WHEN length(r[i]) <= 8 THEN 2 ELSE 3 END THEN levenshtein(t[i], r[i]) ELSE 99 END))"""

_P4 = rf"""
WITH {_DOC},
typed AS (
  SELECT 'raw_target' AS src_field, row_key, 0 AS pos, bare AS typed FROM (
    SELECT ref_id AS row_key, target, {_TARGET} AS bare FROM (SELECT ref_id, any_value(raw_target) AS target FROM md_link_refs GROUP BY ref_id))
  WHERE NOT contains(target, '://') AND NOT (contains(bare, '/') OR contains(bare, '\') OR regexp_matches(lower(bare), '\.mdx?$'))
  UNION ALL SELECT 'alias', id, u.pos - 1, aliases[u.pos] FROM doc, LATERAL (SELECT unnest(generate_series(1, len(aliases))) AS pos) u
  UNION ALL SELECT 'path', id, 0, regexp_replace(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1), '\.[^.]*$', '') FROM doc),
name AS ({_names(r"(SELECT * FROM typed WHERE regexp_matches(typed, '\S'))", "typed")}),
ref AS (
  SELECT *, length(rsq) AS rlen, least({MAX_EDITS}, greatest(1, length(rsq) // 3)) AS edits FROM (
    SELECT DISTINCT canon_id AS rid, string_split(plain, ' ') AS r, regexp_replace(plain, '[ .]', '', 'g') AS rsq FROM (
      {_names("(SELECT canon_id, unnest([title, alt_name]) AS n FROM canon_pages)", "n")}) WHERE plain <> '') WHERE rsq <> ''),
word AS (SELECT DISTINCT plain, string_split(plain, ' ') AS w FROM name),
win AS (
  SELECT plain, a + b AS cut, w[a + 1 : len(w) - b] AS w, list_transform(w[1 : a], lambda x: '<' || x) || list_transform(w[len(w) - b + 1 : len(w)], lambda x: '>' || x) AS o
  FROM word, range({OUTER_WORDS + 1}) x(a), range({OUTER_WORDS + 1}) y(b) WHERE a + b = 0 OR len(w) - a - b >= 2),
sized AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '\.$', '')) AS t, regexp_replace(array_to_string(w, ''), '[ .]', '', 'g') AS sq FROM win),
near AS (
  SELECT plain, cut, o, rid, w, t, r, levenshtein(sq, rsq) AS d FROM sized JOIN ref ON length(sq) BETWEEN rlen - edits AND rlen + edits AND levenshtein(sq, rsq) <= edits),
good AS (SELECT * FROM (SELECT *, CASE WHEN len(w) = len(r) THEN {_COST} WHEN d <= 2 THEN d ELSE 99 END AS score FROM near) WHERE score <= 6),
filler AS (
  SELECT o FROM (SELECT rid, unnest(o) AS o FROM good WHERE cut > 0) WHERE substr(o, 2) NOT IN (SELECT unnest(r) FROM ref)
  GROUP BY o HAVING count(DISTINCT rid) >= {MIN_FRAMED}),
best AS (
  SELECT plain, rid FROM good WHERE cut = 0 OR list_has_all((SELECT coalesce(list(o), []) FROM filler), o)
  QUALIFY row_number() OVER (PARTITION BY plain ORDER BY cut, score, d, rid) = 1)
SELECT src_field, row_key, pos::BIGINT AS pos, coalesce(rid, -1)::BIGINT AS canon_id FROM name LEFT JOIN best USING (plain)"""

SQL = {
    "p4_found": _P4,
    "p5_found": _TERMS + " SELECT id AS doc_key, term FROM tf JOIN st USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p5_weights": _TERMS + " SELECT id AS doc_key, term, tf, df, round(log2(1 + tf) * g, 6) AS weight FROM tf JOIN st USING (term)",
    "p5_top": _TERMS + """, w AS (SELECT id AS doc_key, term, round(log2(1 + tf) * g, 6) AS weight FROM tf JOIN st USING (term))
        SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY weight DESC, term) AS place, term, weight FROM w QUALIFY place <= 5""",
    "p7_found": _TAGS + " SELECT tag_a, tag_b FROM pair WHERE n_both >= 5 AND lift >= 2.9 - 1e-12",
    "p7_pairs": _TAGS + " SELECT tag_a, tag_b, n_both, round(lift, 6) AS lift, round(log2(lift), 6) AS pmi, round(n_both / (n_a + n_b - n_both), 6) AS jaccard FROM pair",
}

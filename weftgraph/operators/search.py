"""Lexical search in tiers, as column expressions and one top-k.

A document scores the best of its fields: the tier of the field plus one for
each query term the field lacks; an exact title or path scores 0.  Case folds
for ASCII letters only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers of the fields and the categories they stand for (fixed values).
TIERS = (("title", 100, "partial_title_or_path"), ("path", 110, "partial_title_or_path"), ("aliases", 200, "structured_metadata"), ("tags", 210, "structured_metadata"), ("headings", 220, "structured_metadata"), ("body", 300, "body"))
DEFAULT_LIMIT, MAX_LIMIT, SNIPPET_CHARS = 10, 50, 500


def fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


class Query:
    def __init__(self, text: str):
        self.text = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        self.terms = sorted(set(self.text.split()))

    def matched(self, value: Column) -> Column:
        """The terms that a folded text holds; all if it holds the whole query."""
        each = [F.when(value.contains(t), F.lit(t)) for t in self.terms]
        some = F.array_compact(F.array(*each)) if each else F.expr("cast(array() as array<string>)")
        return F.when(value.contains(self.text), F.array(*[F.lit(t) for t in self.terms]).cast("array<string>")).otherwise(some)


def _best(values: Column, terms: Column) -> Column:
    """The value with most terms, of equals the smallest; null if none has any."""
    scored = F.transform(values, lambda v: F.struct((-F.size(F.filter(terms, lambda t: fold(v).contains(t)))).alias("n"), v.alias("v")))
    hits = F.filter(scored, lambda s: s["n"] < 0)
    return F.when(F.size(hits) > 0, F.array_min(hits)["v"])


def score(docs: DataFrame, text: str, tags: list[str] | None = None) -> DataFrame:
    """Matching documents with ``score``, ``category``, ``fields``, ``terms``.

    ``docs``: id, path, title, aliases, tags, headings, body, raw.  Every tag
    asked for must be present, letter case counts.  Null fields match nothing.
    """
    q = Query(text)
    df = docs
    for t in tags or []:
        df = df.where(F.coalesce(F.array_contains("tags", t), F.lit(False)))
    n = len(q.terms)
    parts = []
    for name, tier, _ in TIERS:
        if name in ("aliases", "tags", "headings"):
            # a value scores for itself; those of a field that tie add their terms
            found = F.filter(F.transform(F.coalesce(F.col(name), F.expr("cast(array() as array<string>)")), lambda v: q.matched(fold(v))), lambda m: F.size(m) > 0)
            most = F.array_max(F.transform(found, lambda m: F.size(m)))
            tied = F.filter(F.transform(found, lambda m: F.struct(F.size(m).alias("n"), m.alias("m"))), lambda x: x["n"] == most)
            terms = F.array_sort(F.array_distinct(F.flatten(F.transform(tied, lambda x: x["m"]))))
            parts.append(F.struct((F.lit(tier + n) - most).alias("s"), F.lit(name).alias("f"), terms.alias("t")))
        else:
            m = q.matched(fold(F.col(name)))
            parts.append(F.struct(F.when(F.size(m) > 0, F.lit(tier + n) - F.size(m)).alias("s"), F.lit(name).alias("f"), m.alias("t")))
    hits = F.filter(F.array(*parts), lambda p: p["s"].isNotNull())
    # a generator of one row: what follows reads the hits and does not look for them again
    df = df.withColumn("_hits", F.explode(F.array(hits))).withColumn("_best", F.array_min(F.transform("_hits", lambda p: p["s"])))
    title, path = fold(F.col("title")) == q.text, fold(F.col("path")) == q.text
    exact = F.coalesce(title, F.lit(False)) | F.coalesce(path, F.lit(False))
    df = df.where(exact | F.col("_best").isNotNull())
    top = F.filter("_hits", lambda p: p["s"] == F.col("_best"))
    own = F.array_compact(F.array(F.when(title, F.lit("title")), F.when(path, F.lit("path"))))
    category = F.lit(TIERS[-1][2])
    for name, _, cat in reversed(TIERS):
        category = F.when(top[0]["f"] == name, F.lit(cat)).otherwise(category)
    return df.select(
        *docs.columns,
        F.when(exact, F.lit(0)).otherwise(F.col("_best")).cast("bigint").alias("score"),
        F.when(exact, F.lit("exact_title_or_path")).otherwise(category).alias("category"),
        F.when(exact, own).otherwise(F.transform(top, lambda p: p["f"])).alias("fields"),
        F.when(exact, F.array(*[F.lit(t) for t in q.terms]).cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(top, lambda p: p["t"]))))).alias("terms"),
    )


def structural(scored: DataFrame, in_dir: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``signal``: evidence that best-scored documents are near in the tree.

    ``in_dir``: doc, dir, weight; ``parents``: child, parent.  An anchor (a
    document of the best score) in the same directory, or in the parent or a
    child of it, counts the weight once per kind and directory; a document is no
    anchor for itself.  Anchors are counted per directory first.
    """
    least = scored.agg(F.min("score")).first()[0]
    marked = scored.withColumn("_anchor", F.coalesce(F.col("score") == F.lit(least).cast("bigint"), F.lit(False)))
    w = F.round(F.col("weight") * 100).cast("bigint").alias("w")
    own = marked.select("id", "_anchor").join(in_dir.select(F.col("doc").alias("id"), "dir", w), "id")
    anchors = own.where("_anchor").groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("aw"))
    same = own.join(anchors, "dir").where(F.col("n") > F.col("_anchor").cast("int")).select("id", F.least("w", "aw").alias("s"))
    up = own.join(parents.select(F.col("child").alias("dir"), F.col("parent")), "dir").join(anchors.withColumnRenamed("dir", "parent"), "parent")
    up = up.select("id", "parent", F.least("w", "aw").alias("s")).distinct().select("id", "s")
    down = parents.select("parent", F.col("child").alias("dir")).join(anchors, "dir").groupBy("parent").agg(F.max("aw").alias("aw"))
    down = own.join(down.withColumnRenamed("parent", "dir"), "dir").select("id", "dir", F.least("w", "aw").alias("s")).distinct().select("id", "s")
    total = same.unionByName(up).unionByName(down).groupBy("id").agg(F.sum("s").alias("signal"))
    return marked.drop("_anchor").join(total, "id", "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


def search(docs: DataFrame, text: str, tags: list[str] | None = None, limit: int = DEFAULT_LIMIT, tree: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best documents in order: score, structural signal, path.

    Returns ``rank`` (from 1), ``id, path, title, score, signal, category,
    fields, snippet, snippet_source, truncated`` (more documents match).
    """
    limit = max(1, min(limit, MAX_LIMIT))
    found = score(docs, text, tags)
    found = structural(found, *tree) if tree else found.withColumn("signal", F.lit(0).cast("bigint"))
    order = [F.col("score"), F.col("signal").desc(), F.col("path")]
    top = found.orderBy(*order).limit(limit + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # at most limit + 1 rows
    last = F.max("rank").over(Window.partitionBy(F.lit(0)))
    ranked = ranked.withColumn("truncated", last > limit).where(F.col("rank") <= limit)
    heading = F.when(F.array_contains("fields", "headings"), _best(F.col("headings"), F.col("terms")))
    line = F.when(F.array_contains("fields", "body"), _best(F.split("body", "\r?\n"), F.col("terms")))
    empty = F.coalesce(F.col("body"), F.lit("")) == ""
    rest = F.when(empty, F.col("raw")).otherwise(F.col("body"))
    snippet = F.substring(F.coalesce(heading, line, rest), 1, SNIPPET_CHARS)
    source = F.when(heading.isNotNull(), "headings").when(line.isNotNull() | ~empty, "body").otherwise("raw")
    return ranked.select("rank", "id", "path", "title", "score", "signal", "category", "fields", snippet.alias("snippet"), source.alias("snippet_source"), "truncated")


def semantic_search(*_args, **_kw) -> dict:
    """No vector backend is configured; there is no silent fallback."""
    return {"ok": False, "error": {"code": "unconfigured", "message": "semantic search is not configured"}}


def get_document(docs: DataFrame, key: str) -> DataFrame:
    """The one document with this id, path, or title (ASCII case folded).

    No rows if none or several match.
    """
    ident = F.col("id") == int(key) if key.isdigit() else F.lit(False)
    hit = docs.where(ident | (F.col("path") == key) | (fold(F.col("title")) == Query(key).text))
    few = hit.limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # at most two rows
    return few.where("_n = 1").drop("_n")


def list_documents(docs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return docs.orderBy("path", "id").limit(min(limit, MAX_LIMIT))

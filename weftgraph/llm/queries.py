"""Queries p1, p4, p5, p7, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.paths import bare_target, is_path_target
from weftgraph.llm import bpe, canonical, cooccurrence, mixing, mojibake, residue, terms
from weftgraph.sources.tables import current_documents, current_wide, latest, table


def _markup(spark: SparkSession, d: str, clean: bool) -> DataFrame:
    """Per text its markup kinds or clean text; only these short results are
    shuffled to find the current rows, not the texts."""
    docs = residue.describe(table(spark, d, "md_documents"), ["id", "synced_at", "loaded_at"], ["body", "raw"], ["raw"], clean)
    docs = latest(docs, ["id"], ["synced_at", "loaded_at"])
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("src_field"), F.col(f).alias("said")) for f in ("body", "raw")]))
    docs = docs.select(F.col("id").alias("row_key"), by_field.alias("x")).select("x.src_field", "row_key", "x.said")
    items = residue.describe(table(spark, d, "search_items").where("item_id IS NOT NULL"), ["item_id"], ["snippet"], [], clean)
    items = items.select(F.lit("snippet").alias("src_field"), F.col("item_id").alias("row_key"), F.col("snippet").alias("said"))
    return docs.unionByName(items)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    said = _markup(spark, d, False).where("said <> ''")
    return said.select("src_field", "row_key", F.explode(F.split("said", ",")).alias("markup")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every body, raw and snippet."""
    return _markup(spark, d, True).select("src_field", "row_key", F.col("said").alias("clean_text"))


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "md_link_refs")
    refs = latest(refs.select("ref_id", "raw_target", "loaded_at"), ["ref_id"], ["loaded_at"])
    t = F.col("raw_target")
    refs = refs.where(~is_path_target(t) & ~t.contains("://"))
    none = F.lit(0).cast("bigint").alias("pos")
    a = refs.select(F.lit("raw_target").alias("src_field"), F.col("ref_id").alias("row_key"), none, bare_target(t).alias("typed"))
    docs = current_documents(table(spark, d, "md_documents"), ["aliases", "path"])
    b = docs.select(F.lit("alias").alias("src_field"), F.col("id").alias("row_key"), F.posexplode("aliases").alias("pos", "typed"))
    stem = F.regexp_replace(F.regexp_extract(F.translate("path", "\\", "/"), r"([^/]*)$", 1), r"\.[^.]*$", "")
    c = docs.select(F.lit("path").alias("src_field"), F.col("id").alias("row_key"), none, stem.alias("typed"))
    names = a.unionByName(b.withColumn("pos", F.col("pos").cast("bigint"))).unionByName(c)
    return names.where(F.col("typed").rlike(r"\S"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "canon_pages")
    refs = pages.select("canon_id", F.explode(F.array("title", "alt_name")).alias("ref_name"))
    out = canonical.match(_typed_names(spark, d), "typed", refs, "canon_id", "ref_name")
    return out.select("src_field", "row_key", "pos", F.col("match_id").alias("canon_id"))


def _document_terms(spark: SparkSession, d: str) -> DataFrame:
    return current_wide(table(spark, d, "md_documents"), ["title", "headings", "body"])


def _all_terms():
    return terms.term_list(F.col("title"), F.array_join("headings", "\n"), F.col("body"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = terms.log_entropy(_document_terms(spark, d), "id", _all_terms(), min_tf=3, min_df=2, max_df=8, unique=True)
    return out.select(F.col("key").alias("doc_key"), "term")


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of every term in every current document."""
    out = terms.log_entropy(_document_terms(spark, d), "id", _all_terms(), unique=True)
    return out.select(F.col("key").alias("doc_key"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    """The five terms of highest weight of every current document."""
    out = terms.log_entropy(_document_terms(spark, d), "id", _all_terms(), unique=True)
    out = terms.top_terms(out.withColumn("weight", F.round("weight", 6)), 5)
    return out.select(F.col("key").alias("doc_key"), "place", "term", "weight")


def _tag_baskets(spark: SparkSession, d: str) -> DataFrame:
    docs = current_documents(table(spark, d, "md_documents"), ["tags"])
    clean = F.transform("tags", lambda t: F.regexp_replace(F.lower(F.trim(t)), r"^(?:#\s*)+|\s+$", ""))
    return docs.select(F.filter(clean, lambda t: t != "").alias("tags"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurrence.associations(_tag_baskets(spark, d), "tags", min_both=5, min_lift=2.9)
    return out.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with their counts and how much more often than chance."""
    out = cooccurrence.associations(_tag_baskets(spark, d), "tags")
    return out.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_both", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"), F.round("jaccard", 6).alias("jaccard"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str):
    targets = table(spark, d, "mix_targets")
    listed = F.broadcast(targets.select(F.col("src_name").alias("source")).distinct())  # one line per source
    sized = bpe.count_tokens(table(spark, d, "documents").join(listed, "source", "left_semi"), ["doc_id", "source"], "text")
    chosen, plan = mixing.mix(sized, "doc_id", "source", "n_tokens", targets)
    return chosen, plan, targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen decisions with their number of copies."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of all tokens per source."""
    chosen, plan, targets = _mix(spark, d)
    return mixing.shares(chosen, "source", "n_tokens", plan, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled decisions with the restored text and what is lost for good."""
    return mojibake.restore(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p4_found, p5_found, p5_weights, p5_top, p7_found, p7_pairs, p8_ids, p9_mix, p9_shares, p10_found, p10_restored)}

"""How distinctive a term is per record: log-entropy weighting by aggregations.

The weight of a term in a record is log2(1 + tf) times its global weight
1 + sum(p log p) / log N, where p is the record's share of all occurrences of
the term and N the number of records.  A term spread evenly over all records
gets 0, one in a single record 1.  Two aggregations give it: occurrences per
(record, term), then per term the count, the sum and the sum of tf log tf; as
sum(p log p) = sum(tf log tf) / gf - log gf, no third pass is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.skew import HOT_ROWS, HOT_SHARE, salted_join
from weftgraph.session import Scratch


def term_list(*parts: Column) -> Column:
    """The longest runs of letters of any alphabet, in lower case, of several texts."""
    text = F.lower(F.concat_ws("\n", *parts))
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def record_terms(records: DataFrame, key: str, terms: Column, unique: bool = False) -> DataFrame:
    """Occurrences ``tf`` per (record, term); counted in each row before anything moves.

    In the sorted terms of a row, a term's count is the way from the start of
    its run to the start of the next.  With ``unique`` (one row per key) that is
    the whole count and nothing is shuffled.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_sort(terms).alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.where(F.size("w") > 0).withColumn("at", starts)
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("w")))
    runs = F.zip_with("at", ends, lambda a, b: F.struct(F.get("w", a).alias("term"), (b - a).cast("bigint").alias("tf")))
    out = rows.select("key", F.explode(runs).alias("r")).select("key", "r.term", "r.tf")
    return out if unique else out.groupBy("key", "term").agg(F.sum("tf").alias("tf"))


def term_stats(tf: DataFrame, n_records: int) -> DataFrame:
    """Per term: records ``df``, occurrences ``gf`` and the global weight ``g``."""
    x = F.col("tf").cast("double")
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(x * F.log(x)).alias("s"))
    n = max(2, n_records)
    return stats.select("term", "df", "gf", (1 + (F.col("s") / F.col("gf") - F.log(F.col("gf").cast("double"))) / F.log(F.lit(float(n)))).alias("g"))


def log_entropy(records: DataFrame, key: str, terms: Column, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, unique: bool = False) -> DataFrame:
    """``key, term, tf, df, weight`` of each term of each record.

    Counts run over all records and all terms; ``min_tf``, ``min_df`` and
    ``max_df`` choose which pairs come out.  A term of at most ``max_df``
    records has a global weight of at least 1 - log max_df / log N (its entropy
    is at most log max_df), so the weights choose the pairs and the exact counts
    are checked afterwards.  Null texts and records without letters give no
    terms, rows with a null key are left out; a term occurs as often as it
    stands in the record's rows (``unique``: a record has one row).
    """
    scratch = Scratch(records.sparkSession, "terms")
    tf = scratch.cut(record_terms(records, key, terms, unique), "tf")  # texts are cut into terms once
    n = records.where(F.col(key).isNotNull()).count() if unique else records.select(key).distinct().count()
    stats = scratch.cut(term_stats(tf, n), "stats")
    # terms that many records hold: few by construction, and known before the join
    rows = stats.agg(F.sum("df")).first()[0] or 0
    hot = [r[0] for r in stats.where(F.col("df") > max(HOT_ROWS, rows // HOT_SHARE)).select("term").collect()]
    stats = stats.where(F.col("df") >= min_df)
    shown = tf.where(F.col("tf") >= min_tf)
    least = 0.0
    if max_df is not None:
        least = 1 - math.log(max(1, max_df)) / math.log(max(2, n)) - 1e-9
        stats = stats.where((F.col("g") >= least) & (F.col("df") <= max_df))
        if hot and max_df < HOT_ROWS:
            shown, hot = shown.where(~F.col("term").isin(hot)), []  # none of them is wanted
    out = salted_join(shown, stats, "term", F.col("key"), hot)
    out = out.select("key", "term", "tf", "df", (F.log2(1 + F.col("tf")) * F.col("g")).alias("weight"))
    return out if max_df is None else out.where(F.col("weight") >= math.log2(1 + min_tf) * least)


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of highest weight of each record, ties by the term; ``place`` from 1."""
    w = Window.partitionBy("key").orderBy(F.col("weight").desc(), "term")
    return weights.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)

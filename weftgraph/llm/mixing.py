"""Sources mixed to target weights, with capped repetition.

Every record of a source gets the same expected number of copies, the size the
source is wanted at over the size it has.  The whole part is taken as it is;
the fractional parts are rounded by the pivotal method: two records with
fractional copies pass mass to each other at random until one of them is
integral, keeping their joint size and each one's expectation.  Every bucket of
a source leaves at most one fractional record; these meet in a reduction tree,
so the size of a source is off by less than one record in the end.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Scratch

#: Records per bucket of the first round, and buckets joined in each further one.
BUCKET_ROWS = 20_000
FAN_IN = 16
_EPS = 1e-9


def _uniform(*parts: int) -> float:
    """A number in [0, 1) that depends on the parts only."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
    return x / 2.0**64


def pivotal(ids: list[int], sizes: list[float], probs: list[float], seed: int, last: bool) -> list[float]:
    """Probabilities rounded to 0 or 1, all but one unless ``last``."""
    out = list(probs)
    held = -1
    for j in range(len(out)):
        if not _EPS < out[j] < 1 - _EPS:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        a, b = sizes[i], sizes[j]
        up = min(a * (1 - out[i]), b * out[j])  # mass that may pass from j to i
        down = min(a * out[i], b * (1 - out[j]))
        if _uniform(seed, ids[i], ids[j]) * (up + down) < down:
            out[i], out[j] = out[i] + up / a, out[j] - up / b
        else:
            out[i], out[j] = out[i] - down / a, out[j] + down / b
        held = -1
        for k in (i, j):
            if out[k] < _EPS or out[k] > 1 - _EPS:
                out[k] = float(round(out[k]))
            else:
                held = k
    if last and held >= 0:
        out[held] = float(_uniform(seed, ids[held]) < out[held])
    return out


def plan_copies(sizes: DataFrame, source: str, size: str, targets: DataFrame) -> list[dict]:
    """Per listed source with records: its wanted share and expected copies.

    The mix is as large as the caps allow with every wanted share met.  Shares
    are taken relative to the listed sources that have records; listed ones
    without records, shares that are null or not positive, and records of
    sources not listed take no part.
    """
    have = sizes.where(F.col(size) > 0).groupBy(F.col(source).alias("src_name")).agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n"))
    wanted = targets.where("target_share > 0").groupBy("src_name").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = [r.asDict() for r in wanted.join(have, "src_name").collect()]  # one row per line of the target list
    whole = sum(r["share"] for r in rows)
    if not rows:
        return []
    for r in rows:
        r["share"] /= whole
    volume = min(r["cap"] * r["total"] / r["share"] for r in rows)
    for r in rows:
        r["copies"] = min(float(r["cap"]), r["share"] * volume / r["total"])
    return sorted(rows, key=lambda r: r["src_name"])


def _round(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["rid", "w"], kind="stable")
        g["p"] = pivotal(g["rid"].tolist(), g["w"].astype(float).tolist(), g["p"].tolist(), seed, last)
        return g

    return run


def mix(records: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """Chosen records with ``n_copies`` (>= 1), and the plan per source.

    ``records``: ``key`` (integer), ``source`` and ``size``.  Records with a
    null key, source or size and those of size 0 are never chosen.  Rows that
    repeat a key are records of their own.  The choice depends on the data and
    the seed only, not on partitions or retries.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.cut(records.select(F.col(key).alias("rid"), F.col(source).alias("src_name"), F.col(size).alias("w")).where(f"rid IS NOT NULL AND src_name IS NOT NULL AND w > 0"), "sizes")
    plan = plan_copies(rows, "src_name", "w", targets)
    if not plan:
        empty = rows.limit(0).select(F.col("rid").alias(key), F.col("src_name").alias(source), F.col("w").alias(size), F.lit(0).cast("bigint").alias("n_copies"))
        return empty, []
    copies = spark.createDataFrame([(r["src_name"], r["copies"]) for r in plan], "src_name string, c double")
    rows = rows.join(F.broadcast(copies), "src_name")
    buckets = max(1, math.ceil(sum(r["n"] for r in plan) / BUCKET_ROWS))
    rows = rows.withColumn("base", F.floor(F.col("c") + _EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("c") - F.col("base")))
    # repeats of a record are one line here: of m with fraction p, floor(m p) get a copy more
    # for sure, and the rest is one fraction to be rounded
    rows = rows.groupBy("src_name", "rid", "w", "base").agg(F.count(F.lit(1)).alias("m"), F.first("p").alias("each"))
    rows = rows.withColumn("sure", F.floor(F.col("m") * F.col("each") + _EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("m") * F.col("each") - F.col("sure")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid", "w"), F.lit(buckets)).cast("int"))
    cols = ["src_name", "bucket", "rid", "w", "base", "m", "sure", "p"]
    schema = "src_name string, bucket int, rid bigint, w bigint, base bigint, m bigint, sure bigint, p double"
    settled: list[DataFrame] = []
    level = rows.select(*cols)
    while True:
        last = buckets == 1
        done = scratch.cut(level.groupBy("src_name", "bucket").applyInPandas(_round(seed, last), schema), "level")
        settled.append(done.where("p = 0 OR p = 1"))
        if last:
            break
        # at most one record per source and bucket goes on
        buckets = -(-buckets // FAN_IN)
        level = done.where("p > 0 AND p < 1").withColumn("bucket", F.pmod("bucket", F.lit(buckets)).cast("int"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    # the repeats as rows again, a record of very many in several tasks
    out = out.withColumn("more", F.col("sure") + F.col("p").cast("bigint"))
    if (out.agg(F.max("m")).first()[0] or 0) > BUCKET_ROWS:
        out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / BUCKET_ROWS)))).repartition("rid", "w", "block")
        first = F.col("block") * BUCKET_ROWS
        out = out.withColumn("k", F.explode(F.sequence(first, F.least(first + BUCKET_ROWS, F.col("m")) - 1)))
    else:
        out = out.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    n = (F.col("base") + (F.col("k") < F.col("more")).cast("bigint")).alias("n_copies")
    return out.select(F.col("rid").alias(key), F.col("src_name").alias(source), F.col("w").alias(size), n).where("n_copies > 0"), plan


def shares(chosen: DataFrame, source: str, size: str, plan: list[dict], targets: DataFrame) -> DataFrame:
    """Wanted and reached share per listed source; sources left out have nulls."""
    spark = chosen.sparkSession
    want = spark.createDataFrame([(r["src_name"], r["share"], r["n"], r["total"]) for r in plan], "src_name string, wanted_share double, n_records bigint, tokens_available bigint")
    got = chosen.groupBy(F.col(source).alias("src_name")).agg(F.count(F.lit(1)).alias("n_used"), F.max("n_copies").alias("most_copies"), F.sum(F.col(size) * F.col("n_copies")).alias("tokens_used"))
    whole = chosen.agg(F.sum(F.col(size) * F.col("n_copies"))).first()[0]
    out = targets.join(F.broadcast(want), "src_name", "left").join(got, "src_name", "left")
    return out.withColumn("reached_share", F.col("tokens_used") / F.lit(whole).cast("double"))

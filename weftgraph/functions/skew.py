"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are.
HOT_SHARE = 500
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, rows: int) -> list:
    """Keys of ``df`` that hold more than ``1/HOT_SHARE`` of its ``rows`` rows.

    At most ``HOT_SHARE`` values by construction, whatever the table's size.
    """
    if rows <= HOT_ROWS:
        return []
    least = max(HOT_ROWS, rows // HOT_SHARE)
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return [r[0] for r in found.select(key).collect() if r[0] is not None]


def salted_join(big: DataFrame, small: DataFrame, key: str, spread, hot: list, how: str = "inner", salts: int = 64) -> DataFrame:
    """Equi-join in which hot keys of ``big`` are spread over ``salts`` tasks.

    ``small`` has one row per key; only its hot rows are repeated, at most
    ``HOT_SHARE * salts`` rows in all.  ``spread`` is a column of ``big`` whose
    hash picks the salt.  ``how`` is ``inner`` or ``left``.
    """
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("__salt", F.explode(copies))
    return left.join(right, [key, "__salt"], how).drop("__salt")

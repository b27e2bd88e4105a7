"""Readers for the parquet tables, and the row rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import Scratch

#: Repeated ids up to this many are broadcast (under 150 bytes each); more are shuffled.
REPEATED_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(c: Column | str) -> Column:
    """Case-folded and trimmed form in which statuses and types compare."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; rows with a null key are dropped.

    ``row_number() = 1`` lets Spark keep one candidate per key and input
    partition before the shuffle, so a key with very many copies does not
    travel to one task.
    """
    live = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return live.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def current_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The current row of every document id with the columns asked for.

    Several rows of one ``id`` are earlier states and copies; the row with the
    latest ``synced_at`` counts.
    """
    keep = list(dict.fromkeys(["id", "synced_at", "loaded_at", *columns]))
    rows = latest(docs.select(*keep), ["id"], ["synced_at", "loaded_at"])
    return rows.select(*dict.fromkeys(["id", *columns]))


def current_wide(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Like ``current_documents``, for long columns: they stay where they are read.

    Only ids that have several rows need a decision.  It is made on the stamps
    and the place of each row in its file; ``docs`` must be read from files.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    last = F.max(F.struct("synced_at", "loaded_at", "__file", "__row")).alias("b")
    stamps = docs.select("id", "synced_at", "loaded_at", *place).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), last)
    best = Scratch(docs.sparkSession, "current").cut(stamps.where("n > 1").select("id", F.col("b.__file").alias("f"), F.col("b.__row").alias("r")), "repeated")
    if best.count() <= REPEATED_IDS:
        best = F.broadcast(best)
    rows = docs.select(*dict.fromkeys(["id", *columns]), *place).where("id IS NOT NULL")
    chosen = F.col("f").isNull() | ((F.col("f") == F.col("__file")) & (F.col("r") == F.col("__row")))
    return rows.join(best, "id", "left").where(chosen).select(*dict.fromkeys(["id", *columns]))


def live_edges(edges: DataFrame, columns: list[str]) -> DataFrame:
    """Live edges, redeliveries counted once, with ``etype`` in tidy form."""
    keep = list(dict.fromkeys(["id", "loaded_at", "edge_type", "status", "valid_to", *columns]))
    rows = latest(edges.select(*keep), ["id"], ["loaded_at"])
    rows = rows.where((tidy("status") == "current") & F.col("valid_to").isNull())
    rest = [c for c in dict.fromkeys(["id", *columns]) if c != "edge_type"]
    return rows.select(*rest, tidy("edge_type").alias("etype"))

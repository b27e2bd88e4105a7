"""What changed between full snapshots, found with Merkle trees.

Records are hashed into 2^leaf_bits ranges.  A leaf digest combines the hashes
of its rows in any order; an inner digest combines those of its 16 children.
The trees of a snapshot and its predecessor are compared from the root: only
children of nodes that differ are looked at, and rows are compared only within
leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import Scratch
from weftgraph.sources.tables import latest

FAN_BITS = 4


def changes(rows: DataFrame, scope: str, key: str, number: str, order: list[str], values: list[str], leaf_bits: int = 16) -> DataFrame:
    """Records added, removed or changed against the scope's preceding snapshot.

    ``rows``: full snapshots; ``scope`` names what is delivered as a whole (its
    snapshots are those in which it has rows at all), ``key`` the record within
    it, ``number`` the snapshot.  Where a snapshot holds several rows of a
    record, the last by ``order`` counts.  ``values`` decide about a change;
    null equals only null.  Rows with a null scope, key or number are left out.
    Returns ``scope, key, number`` (of the later snapshot) and ``change_kind``.
    An empty table or a scope with one snapshot gives no rows.
    """
    assert leaf_bits % FAN_BITS == 0
    scratch = Scratch(rows.sparkSession, "snapshots")
    own = [f"v{k}" for k in range(len(values))]
    names = [F.col(scope).alias("s"), F.col(number).alias("no"), F.col(key).alias("k")]
    fields = [F.col(v).alias(o) for v, o in zip(values, own)]
    ids = ["s", "no", "k"]
    state = latest(rows.select(*names, *[F.col(o).alias(f"o{j}") for j, o in enumerate(order)], *fields), ids, [*[f"o{j}" for j in range(len(order))], *own]).select(*ids, *own)
    marked = [F.coalesce(F.concat(F.lit("="), F.col(o).cast("string")), F.lit("-")) for o in own]
    leaf = F.shiftrightunsigned(F.xxhash64("k"), 64 - leaf_bits).cast("int")
    state = scratch.cut(state.withColumn("leaf", leaf).withColumn("h", F.xxhash64("k", *marked)), "state")

    pairs = state.select("s", "no").distinct()
    w = Window.partitionBy("s").orderBy("no")
    pairs = pairs.withColumn("prev", F.lag("no").over(w)).where("prev IS NOT NULL")

    # leaf digests, then each level above from the one below
    digest = [F.bit_xor("h").alias("d1"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("d2"), F.count(F.lit(1)).alias("n")]
    level = scratch.cut(state.groupBy("s", "no", F.col("leaf").alias("bucket")).agg(*digest), "leaves")
    levels = [level]
    for _ in range(leaf_bits // FAN_BITS):
        mixed = F.xxhash64("bucket", "d1", "d2", "n")
        up = [F.bit_xor(mixed).alias("d1"), F.bit_xor(F.xxhash64("bucket", "d2", "d1")).alias("d2"), F.sum("n").alias("n")]
        level = level.groupBy("s", "no", F.shiftright("bucket", FAN_BITS).alias("bucket")).agg(*up)
        level = level.withColumn("bucket", F.col("bucket").cast("int"))
        levels.append(level)

    # top-down: (scope, number, prev, bucket) that differ, from the root to the leaves
    differ = pairs.withColumn("bucket", F.lit(0))
    for depth, level in enumerate(reversed(levels)):
        if depth:
            below = F.explode(F.sequence(F.lit(0), F.lit((1 << FAN_BITS) - 1)))
            differ = differ.withColumn("c", below).withColumn("bucket", F.shiftleft("bucket", FAN_BITS) + F.col("c")).drop("c")
        now = level.select("s", "no", "bucket", F.struct("d1", "d2", "n").alias("now"))
        was = level.select("s", F.col("no").alias("prev"), "bucket", F.struct("d1", "d2", "n").alias("was"))
        differ = differ.join(now, ["s", "no", "bucket"], "left").join(was, ["s", "prev", "bucket"], "left")
        differ = differ.where(~F.col("now").eqNullSafe(F.col("was"))).select("s", "no", "prev", "bucket")
    differ = scratch.cut(differ, "differ")

    at = ["s", "no", F.col("bucket").alias("leaf")]
    new = state.join(differ.select(*at), ["s", "no", "leaf"]).select(*ids, F.lit(True).alias("is_new"), *own)
    old = state.withColumnRenamed("no", "prev").join(differ.select(*at, "prev"), ["s", "prev", "leaf"])
    old = old.select(*ids, F.lit(False).alias("is_new"), *own)
    a, b = F.struct(*own), F.col("is_new")
    both = new.unionByName(old).groupBy(*ids).agg(
        F.max(F.when(b, a)).alias("now"), F.max(F.when(~b, a)).alias("was"), F.bool_or(b).alias("in_new"), F.bool_or(~b).alias("in_old")
    )
    kind = F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "removed").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    out = both.select(F.col("s").alias(scope), F.col("no").alias(number), F.col("k").alias(key), kind.alias("change_kind"))
    return out.where("change_kind IS NOT NULL")

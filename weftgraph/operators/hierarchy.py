"""Parent-child rows resolved to full hierarchies by pointer doubling.

Every node holds a pointer some way up its line.  In each round the pointer is
replaced by the pointer of the node it points to, so the reach doubles: a
forest of depth d is done after ceil(log2 d) rounds.  Rounds are written
tables; only nodes that have not reached a top node take part in the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.skew import hot_keys, salted_join
from weftgraph.session import Scratch


def parent_links(edges: DataFrame, keys: list[str], child: str, parent: str, order: list[str]) -> DataFrame:
    """One parent per child: the edge that is last by ``order`` counts."""
    best = F.max(F.struct(*order, F.col(parent).alias("__p")))
    rows = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull())
    return rows.groupBy(*keys, F.col(child).alias("node")).agg(best.alias("b")).select(*keys, "node", F.col("b.__p").alias("parent"))


def resolve(links: DataFrame, ends: DataFrame, with_path: bool = False, max_rounds: int = 64) -> DataFrame:
    """Root, depth and cycle mark of each node.

    ``links`` (node, parent) has at most one row per node; ``ends`` (node) has
    every id that must come out.  Both may be empty.  Rows with a null end are
    left out.  Returns ``node, root, depth, on_cycle`` and, if asked for,
    ``path`` (ids from the root down to the node).  Nodes whose way up never
    ends get root and depth -1 and a null path; ``on_cycle`` is 1 for those on
    the loop itself, else 0.  A node may be of any type that compares; -1 is
    given in that type.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    kind = links.schema["node"].dataType.simpleString()
    ids = F.array(F.col("node"))
    tops = ends.where("node IS NOT NULL").distinct().join(links.select("node"), "node", "left_anti")
    start = tops.select("node", F.col("node").alias("ptr"), F.lit(0).cast("bigint").alias("dist"), F.lit(True).alias("done"), *([ids.alias("path")] if with_path else []))
    rest = links.select("node", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.lit(False).alias("done"), *([ids.alias("path")] if with_path else []))
    # path of an open node: the ids below its pointer down to itself
    finished = scratch.cut(start, "tops")
    active = scratch.write(rest, "round0")
    open_rows = active.df.count()
    rounds, last_targets = 0, -1
    while open_rows and rounds < max_rounds:
        up = finished.unionByName(active.df)
        up = up.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), *([F.col("path").alias("path2")] if with_path else []))
        joined = salted_join(active.df.drop("done"), up, "ptr", F.col("node"), hot_keys(active.df, "ptr", open_rows))
        if with_path:
            # a finished pointer gives the whole line from the root; an open one
            # extends the piece upwards
            joined = joined.withColumn("path", F.concat("path2", "path"))
        step = joined.select("node", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), *(["path"] if with_path else []))
        step = scratch.cut(step, f"round{rounds + 1}")
        counts = step.agg(F.count(F.lit(1)), F.sum(F.when(F.col("done"), 1).otherwise(0)), F.countDistinct(F.when(~F.col("done"), F.col("ptr")))).first()
        now_done, targets = counts[1] or 0, counts[2] or 0
        rounds += 1
        finished = finished.unionByName(step.where("done")) if now_done else finished
        active = _Part(step.where("NOT done"))
        open_rows = counts[0] - now_done
        if open_rows and now_done == 0 and targets == last_targets:
            break  # only lines that end in loops are left, and their images no longer shrink
        last_targets = targets if now_done == 0 else -1
    out = finished.select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), F.lit(0).cast("bigint").alias("on_cycle"), *(["path"] if with_path else []))
    if not open_rows:
        return out
    loop = active.df.select(F.col("ptr").alias("node")).distinct().withColumn("__on", F.lit(1))
    lost = active.df.select("node").join(loop, "node", "left")
    none = F.lit(-1).cast(kind)
    lost = lost.select("node", none.alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.coalesce("__on", F.lit(0)).cast("bigint").alias("on_cycle"), *([F.expr(f"cast(null as array<{kind}>)").alias("path")] if with_path else []))
    return out.unionByName(lost)


class _Part:
    def __init__(self, df: DataFrame):
        self.df = df


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a result with paths.

    Nodes on or under loops have no path and give no pairs.
    """
    pairs = resolved.where("path IS NOT NULL").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance")).where("distance > 0")

"""Items that appear together: pair counts and their strength against chance.

Large-basket blocking.  A basket of up to ``block`` items gives its pairs in
the task that reads it.  A larger one is split into chunks of ``block`` items;
the pairs of chunk numbers are spread over the tasks and meet their chunks there,
so no task ever holds the pairs, or copies, of a huge basket.  Counts of
both kinds are combined before and after the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Scratch

BLOCK = 64


def _pairs(a: Column, b: Column) -> Column:
    """All (x, y) with x of a, y of b."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _own_pairs(items: Column) -> Column:
    """All (x, y) with x before y in a sorted array."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def pair_counts(baskets: DataFrame, items: str, block: int = BLOCK) -> DataFrame:
    """``item_a, item_b, n_both`` over all baskets, item_a < item_b.

    ``items`` is an array; an item counts once per basket, null items and null
    or empty baskets give no pairs.  Baskets of any size are counted whole.
    """
    sets = baskets.select(F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).alias("s")).where(F.size("s") > 1)
    small = sets.where(F.size("s") <= block).select(F.explode(_own_pairs(F.col("s"))).alias("p"))

    # a large basket: its chunks are written once, only their numbers are paired
    n = ((F.size("s") - 1) / block).cast("int")
    huge = sets.where(F.size("s") > block).select(F.monotonically_increasing_id().alias("basket"), "s", n.alias("last"))
    huge = huge.select("basket", "last", "s", F.explode(F.sequence(F.lit(0), "last")).alias("i"))
    chunks = Scratch(baskets.sparkSession, "pairs").cut(huge.select("basket", "i", "last", F.slice("s", F.col("i") * block + 1, block).alias("c")), "chunks")
    if chunks.isEmpty():
        return _summed(small)
    numbers = chunks.select("basket", "i", F.explode(F.sequence("i", "last")).alias("j")).repartition("basket", "i", "j")
    a = chunks.select("basket", "i", F.col("c").alias("a"))
    b = chunks.select("basket", F.col("i").alias("j"), F.col("c").alias("b"))
    cross = numbers.join(a, ["basket", "i"]).join(b, ["basket", "j"])
    own = F.col("i") == F.col("j")
    big = cross.select(F.explode(F.when(own, _own_pairs(F.col("a"))).otherwise(_pairs(F.col("a"), F.col("b")))).alias("p"))
    return _summed(small.unionByName(big))


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("p.x").alias("item_a"), F.col("p.y").alias("item_b")).agg(F.count(F.lit(1)).alias("n_both"))


def associations(baskets: DataFrame, items: str, min_both: int = 1, min_lift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Pairs with their counts, lift, pointwise mutual information and Jaccard.

    ``lift`` is n_both x all baskets / (n_a x n_b); all baskets are the rows of
    ``baskets``, those without items included.
    """
    total = baskets.count()
    single = baskets.select(F.explode(F.array_distinct(F.array_compact(F.col(items)))).alias("item"))
    single = single.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # an item of a frequent pair is itself frequent
    single = single.where(F.col("n") >= min_both)
    both = pair_counts(baskets, items, block).where(F.col("n_both") >= min_both)
    out = both.join(single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
    out = out.join(single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    lift = F.col("n_both") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))
    # the threshold in whole numbers where it can be, so that ties do not turn on rounding
    out = out.withColumn("lift", lift).where(F.col("lift") >= F.lit(min_lift) - 1e-12)
    return out.select("item_a", "item_b", "n_both", "n_a", "n_b", "lift", F.log2("lift").alias("pmi"), (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"))

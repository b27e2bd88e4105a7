"""References to records that do not exist, kept as incremental keyed state.

The state is a log.  It holds, for every reference, the time it counts and the
steps of its verdict over the load periods; and every parent row.  A batch may
hold several periods.  New references probe the parent index of their key; what
arrives in a later period resolves waiting orphans from that period on, and
deletions reopen them.  A further batch judges again only the references of
owners and keys that it touches and appends these; nothing else is rewritten.

Verdicts: ``missing`` no parent has the key; ``deleted`` all parents with the
key are deleted; ``late`` the first live parent became valid after the time of
the reference; null, the reference holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.skew import hot_keys, salted_join
from weftgraph.session import Scratch
from weftgraph.sources.tables import latest

PARENT = "parent_id string, key string, deleted boolean, valid_from timestamp, version timestamp, period string"
REF = "ref_table string, row_key bigint, pos bigint, version timestamp, key string, shared string, ref_time timestamp, period string"
#: Keys under which one parent serves all scopes begin with this.
SHARED = "*\n"
#: Shared keys up to this many are broadcast (under 1 KB each); more are shuffled.
SHARED_KEYS = 20_000
_OWN = ["ref_table", "row_key"]
_START = "0001-01-01"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _steps(rows: DataFrame, own: list[str], period: str, values: list[str]) -> DataFrame:
    """What holds per ``own`` from period to period: the greatest struct so far.

    ``values`` in order of weight; adds ``since`` and ``until`` (null: still).
    Rows are reduced to one per period before they meet.
    """
    top = rows.groupBy(*own, F.col(period).alias("since")).agg(F.max(F.struct(*values)).alias("v"))
    w = Window.partitionBy(*own).orderBy("since")
    top = top.withColumn("v", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = top.withColumn("was", F.lag("v").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("v")))
    top = top.withColumn("until", F.lead("since").over(w))
    return top.select(*own, *[F.col(f"v.{c}").alias(c) for c in values], "since", "until")


class OrphanState:
    """Pending-orphan state over batches.

    Parents have the columns of ``PARENT``: ``key`` is the value references
    hold; a newer ``version`` of a ``parent_id`` replaces the older from the
    period on in which it arrives.  References have the columns of ``REF``: a
    parent with the key ``shared`` serves as well as one with ``key``; the rows
    of one (ref_table, row_key) of the newest version replace those of older
    versions, a null version is never replaced, and a repeated row counts once,
    from its first period on.  A row with a null ``key`` marks an owner that
    refers to nothing.  Parents with a null id or key and references with a null
    row_key are left out.  A null period comes before all others, a null
    ``valid_from`` or ``ref_time`` never makes a reference late.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scratch = Scratch(spark, "orphans")
        self.parents: DataFrame | None = None
        self.parts: list[DataFrame] = []

    def apply(self, parents: DataFrame, refs: DataFrame) -> "OrphanState":
        """Take one batch, whose periods follow those before, into the state."""
        period = F.coalesce("period", F.lit("")).alias("period")
        came = parents.select(*_columns(PARENT)[:-1], period).where("key IS NOT NULL AND parent_id IS NOT NULL")
        came = self.scratch.cut(came, "parents")
        refs = refs.select(*_columns(REF)[:-1], period).where("row_key IS NOT NULL AND (key IS NOT NULL OR version IS NOT NULL)")
        if self.parents is None:
            self.parents = came
            self.parts = [self._judged(refs, came)]
            return self
        known, self.parents = self.parents, self.parents.unionByName(came)
        again = known.join(came.select("parent_id").distinct(), "parent_id", "left_semi")
        touched = self.scratch.cut(came.select("key").union(again.select("key")).distinct(), "touched")
        owners = self.scratch.cut(refs.select(*_OWN).distinct(), "owners")
        log = self.current()
        by_key = log.join(touched, "key", "left_semi").unionByName(log.join(touched, "key", "left_anti").join(touched.withColumnRenamed("key", "shared"), "shared", "left_semi").select(*log.columns))
        known_refs = log.join(owners, _OWN, "left_semi").unionByName(by_key.join(owners, _OWN, "left_anti").select(*log.columns))
        both = known_refs.select(*_columns(REF)[:-1], F.col("since").alias("period")).unionByName(refs)
        near = both.select("key").union(both.select(F.col("shared").alias("key"))).distinct()
        self.parts.append(self._judged(both, self.parents.join(near, "key", "left_semi")))
        return self

    def _judged(self, refs: DataFrame, parents: DataFrame) -> DataFrame:
        """One written part of the log: references with their verdicts over time."""
        own, shared = self._index(parents)
        rows = self._counted(refs)
        cols = rows.columns
        rows = rows.join(F.broadcast(shared) if shared.count() <= SHARED_KEYS else shared, "shared", "left")
        rows = self.scratch.cut(rows.select(*cols, "other"), "probe")
        hot = hot_keys(rows, "key", rows.count())
        hit = salted_join(rows.where("key IS NOT NULL"), own, "key", F.col("row_key"), hot, "left").select(*cols, "other", "held")
        none = F.expr("cast(array() as array<struct<since:string,until:string,live_from:timestamp>>)")
        bare = rows.where("key IS NULL").select(*cols, "other", none.alias("held"))
        hit = hit.withColumn("held", F.concat(F.coalesce("held", none), F.coalesce("other", none))).drop("other").unionByName(bare.drop("other"))
        out = hit.withColumn("steps", self._verdicts()).drop("held")
        last = F.element_at("steps", -1)["kind"]
        out = out.withColumn("kind", F.when(F.col("until").isNull(), last)).withColumn("seq", F.lit(len(self.parts)))
        return self.scratch.cut(out, "judged")

    def _index(self, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Per key the spans of periods with a parent, and since when a live one is valid.

        Parents of one span are one entry, so a key has at most as many as there
        are pairs of periods, however many parents have it.
        """
        steps = _steps(parents, ["parent_id"], "period", ["version", "key", "deleted", "valid_from"])
        live = F.when(~F.col("deleted"), F.coalesce("valid_from", F.lit(_START).cast("timestamp")))
        spans = steps.groupBy("key", "since", "until").agg(F.min(live).alias("live_from"))
        index = self.scratch.cut(spans.groupBy("key").agg(F.collect_list(F.struct("since", "until", "live_from")).alias("held")), "index")
        shared = index.where(F.col("key").startswith(SHARED)).select(F.col("key").alias("shared"), F.col("held").alias("other"))
        return index.where(~F.col("key").startswith(SHARED)), shared

    def _counted(self, refs: DataFrame) -> DataFrame:
        """References once each with the periods in which they count."""
        place = [*_OWN, "pos", "version"]
        first = [F.first(c).alias(c) for c in ("key", "shared", "ref_time")]
        fixed = refs.where("version IS NULL").groupBy(*place).agg(*first, F.min("period").alias("since"))
        fixed = fixed.withColumn("until", F.lit(None).cast("string"))
        owned = refs.where("version IS NOT NULL")
        spans = _steps(owned.select(*_OWN, "period", "version"), _OWN, "period", ["version"]).withColumnRenamed("since", "from")
        owned = owned.join(spans, [*_OWN, "version"]).groupBy(*place).agg(*first, F.min("from").alias("since"), F.max(F.coalesce("until", F.lit("~"))).alias("until"))
        owned = owned.withColumn("until", F.when(F.col("until") != "~", F.col("until")))
        return fixed.unionByName(owned)

    def _verdicts(self) -> Column:
        """The steps (since, kind) of a reference over the spans of its key."""
        whole = (F.size("held") == 1) & (F.col("held")[0]["since"] <= F.col("since")) & F.col("held")[0]["until"].isNull()
        since, until = F.col("since"), F.col("until")

        def kind(live_from: Column) -> Column:
            return F.when(live_from.isNull(), "deleted").when(live_from > F.col("ref_time"), "late")

        def at(p: Column) -> Column:
            over = F.filter("held", lambda h: (h["since"] <= p) & (h["until"].isNull() | (h["until"] > p)))
            found = F.when(F.size(over) == 0, "missing").otherwise(kind(F.array_min(F.transform(over, lambda h: h["live_from"]))))
            return F.struct(p.alias("since"), found.alias("kind"))

        one = lambda k: F.array(F.struct(since.alias("since"), k.alias("kind")))
        ends = F.flatten(F.transform("held", lambda h: F.array(h["since"], h["until"])))
        within = F.filter(ends, lambda p: p.isNotNull() & (p > since) & (until.isNull() | (p < until)))
        points = F.array_sort(F.array_distinct(F.concat(F.array(since), within)))
        verdict = F.when(F.size("held") == 0, one(F.lit("missing"))).when(whole, one(kind(F.col("held")[0]["live_from"]))).otherwise(F.transform(points, at))
        return F.when(F.col("key").isNotNull(), verdict).otherwise(one(F.lit(None).cast("string")))

    def current(self) -> DataFrame:
        """The log with the last entry of each reference."""
        if len(self.parts) == 1:
            return self.parts[0]
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        key = F.coalesce("version", F.lit(_START).cast("timestamp"))
        return latest(out.withColumn("__v", key), [*_OWN, "pos", "__v"], ["seq"]).drop("__v")

    def orphans(self) -> DataFrame:
        """The references that are open now, with their verdict."""
        return self.current().where("kind IS NOT NULL").select(*_OWN, "pos", "kind", _month())

    def counts(self) -> DataFrame:
        """Open references per table, verdict and month."""
        return self.orphans().groupBy("ref_table", "kind", "ref_month").agg(F.count(F.lit(1)).alias("n_refs"))

    def snapshots(self) -> DataFrame:
        """The counts at the end of every period, those of orphans resolved since included."""
        own = ["ref_table", "kind", "ref_month"]
        log = self.current()
        at = F.transform("steps", lambda s, i: F.struct(s["since"].alias("a"), F.coalesce(F.get("steps", i + 1)["since"], "until").alias("b"), s["kind"].alias("kind")))
        spans = log.select("ref_table", _month(), F.explode(at).alias("s")).where("s.kind IS NOT NULL")
        spans = spans.groupBy("ref_table", "s.kind", "ref_month", "s.a", "s.b").agg(F.count(F.lit(1)).alias("n"))
        loads = log.select(F.explode(F.array("since", "until")).alias("p")).union(self.parents.select("period")).where("p IS NOT NULL").distinct()
        periods = F.array(*[F.lit(r[0]) for r in loads.orderBy("p").collect()]).cast("array<string>")  # one per period
        open_in = F.filter(periods, lambda p: (p >= F.col("a")) & (F.col("b").isNull() | (p < F.col("b"))))
        return spans.select(F.explode(open_in).alias("load_period"), *own, "n").groupBy("load_period", *own).agg(F.sum("n").alias("n_refs"))


def _month() -> Column:
    return F.date_format("ref_time", "yyyy-MM").alias("ref_month")

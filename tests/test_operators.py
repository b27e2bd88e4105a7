"""Hierarchies, orphans and snapshot changes on small and awkward tables."""

import datetime as dt
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftgraph import session
from weftgraph.functions import skew
from weftgraph.functions.paths import is_path_target, normal_path, path_key, target_key
from weftgraph.operators.hierarchy import descendants, parent_links, resolve
from weftgraph.operators.orphans import PARENT, REF, OrphanState
from weftgraph.operators.snapshots import changes
from weftgraph.session import ship
from weftgraph.sources.tables import current_documents, current_wide, live_edges


def brute_forest(parent: dict) -> dict:
    out = {}
    for n in {*parent, *parent.values()}:
        seen, cur = [n], n
        while cur in parent and parent[cur] not in seen:
            cur = parent[cur]
            seen.append(cur)
        if cur in parent:
            on = 1 if parent[cur] == n or n in seen[seen.index(parent[cur]) :] else 0
            out[n] = (-1, -1, on)
        else:
            out[n] = (cur, len(seen) - 1, 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_against_walking(spark, seed):
    r = random.Random(seed)
    n = 60
    parent = {i: r.randrange(n) if r.random() < 0.15 else r.randrange(max(1, i)) for i in range(n) if r.random() < 0.9}
    links = spark.createDataFrame(list(parent.items()), "node bigint, parent bigint")
    ends = links.select("node").union(links.select("parent"))
    got = {x["node"]: (x["root"], x["depth"], x["on_cycle"]) for x in resolve(links, ends).collect()}
    assert got == brute_forest(parent)


def test_hierarchy_shapes(spark):
    empty = spark.createDataFrame([], "node bigint, parent bigint")
    assert resolve(empty, empty.select("node")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (101, 100), (None, 5)], "node bigint, parent bigint").where("node is not null")
    ends = chain.select("node").union(chain.select("parent")).union(spark.createDataFrame([(None,)], "node bigint"))
    got = {x["node"]: (x["root"], x["depth"], x["on_cycle"]) for x in resolve(chain, ends).collect()}
    assert got[0] == (40, 40, 0) and got[40] == (40, 0, 0) and got[100] == (-1, -1, 1) and got[101] == (-1, -1, 0)
    good = chain.where("node < 100")
    paths = resolve(good, good.select("node").union(good.select("parent")), with_path=True)
    assert paths.where("node = 37").first()["path"] == [40, 39, 38, 37]
    assert descendants(paths).count() == 40 * 41 // 2


def test_hierarchy_with_a_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    links = spark.createDataFrame([(i, 0) for i in range(1, 300)] + [(1000 + i, i % 50 + 1) for i in range(200)], "node bigint, parent bigint")
    got = resolve(links, links.select("node").union(links.select("parent")))
    assert {(x["root"], x["depth"]): x["n"] for x in got.groupBy("root", "depth").agg(F.count("*").alias("n")).collect()} == {(0, 0): 1, (0, 1): 299, (0, 2): 200}


def test_parent_choice(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 2)]
    e = spark.createDataFrame([(1, 7, 8, t[0]), (2, 7, 9, t[1]), (3, 7, 10, t[2]), (4, None, 1, t[0]), (5, 3, None, t[0])], "id bigint, src bigint, dst bigint, valid_from timestamp")
    assert [tuple(r) for r in parent_links(e, [], "src", "dst", ["valid_from", "id"]).collect()] == [(7, 10)]


T = [dt.datetime(2025, m, 1) for m in range(1, 13)]


def _open(state):
    return {(r["ref_table"], r["row_key"], r["pos"], r["kind"]) for r in state.orphans().collect()}


def _refs(spark, *rows):
    """(table, key of the row, pos, version, key, time, period) as references without shared keys."""
    return spark.createDataFrame([(*r[:5], None, *r[5:]) for r in rows], REF)


def test_orphans_resolve_and_reopen(spark):
    refs = lambda *x: _refs(spark, *x)
    parents = lambda *x: spark.createDataFrame(list(x), PARENT)
    s = OrphanState(spark)
    s.apply(parents(("a", "ka", False, T[0], T[0], "01")), refs(("t", 1, 0, None, "ka", T[5], "01"), ("t", 2, 0, None, "kb", T[5], "01"), ("t", 2, 0, None, "kb", T[5], "01"), ("t", 3, -1, None, None, T[5], "01"), ("t", None, 0, None, "ka", T[5], "01")))
    assert _open(s) == {("t", 2, 0, "missing")}
    s.apply(parents(("b", "kb", False, T[7], T[7], "02")), refs(("t", 4, 0, None, "kb", T[8], "02")))
    assert _open(s) == {("t", 2, 0, "late")}
    s.apply(parents(("a", "ka", True, T[0], T[9], "03"), ("b", "kb", False, T[1], T[9], "03")), refs())
    assert _open(s) == {("t", 1, 0, "deleted")}
    s.apply(parents(), refs(("d", 9, 0, T[1], "zz", T[1], "04"), ("d", 9, 1, T[1], "ka", T[1], "04"), ("d", 9, 0, T[2], "kb", T[2], "04")))
    assert _open(s) == {("t", 1, 0, "deleted")}
    got = {r["load_period"]: (r["kind"], r["n_refs"]) for r in s.snapshots().collect()}
    assert got == {"01": ("missing", 1), "02": ("late", 1), "03": ("deleted", 1), "04": ("deleted", 1)}
    assert s.counts().first()["n_refs"] == 1


def test_shared_parents_hold_everywhere_until_they_go(spark):
    page = lambda gone, version, period: spark.createDataFrame([("c", "*\nhelp", gone, None, version, period)], PARENT)
    rows = spark.createDataFrame([("t", k, 0, None, f"v{k}\nhelp", "*\nhelp", T[3], "01") for k in (1, 2)], REF)
    s = OrphanState(spark).apply(page(False, T[0], "01"), rows)
    assert _open(s) == set()
    s.apply(page(True, T[4], "02").unionByName(spark.createDataFrame([("p", "v2\nhelp", False, T[0], T[4], "02")], PARENT)), rows.limit(0))
    assert _open(s) == {("t", 1, 0, "deleted")}


def brute_orphans(ps, rs, last):
    """Verdicts at the end of a period, by looking at everything anew."""
    now = {}
    for p in sorted((p for p in ps if p[5] <= last), key=lambda p: (p[4], p[1], p[2], p[3])):
        now[p[0]] = p
    out = set()
    for t, k, pos, _, key, at, period in rs:
        if period <= last:
            mine = [p for p in now.values() if p[1] == key]
            live = [p[3] for p in mine if not p[2]]
            kind = "missing" if not mine else "deleted" if not live else "late" if min(live) > at else None
            if kind:
                out.add((t, k, pos, kind))
    return out


def test_orphans_batches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    r = random.Random(5)
    ps = [(f"p{i % 25}", f"k{i % 12}", r.random() < 0.3, T[r.randrange(12)], dt.datetime(2025, 1, 1) + dt.timedelta(hours=i * 7 % 90), f"{r.randrange(1, 7):02d}") for i in range(60)]
    rs = [("t", i, 0, None, "k1" if i % 3 == 0 else f"k{r.randrange(16)}", T[r.randrange(12)], f"{r.randrange(1, 7):02d}") for i in range(200)]
    one, many = OrphanState(spark), OrphanState(spark)
    one.apply(spark.createDataFrame(ps, PARENT), _refs(spark, *rs))
    for lo, hi in (("01", "02"), ("03", "03"), ("04", "06")):
        many.apply(spark.createDataFrame([p for p in ps if lo <= p[5] <= hi], PARENT), _refs(spark, *[x for x in rs if lo <= x[6] <= hi]))
        assert _open(many) == brute_orphans(ps, rs, hi)
    assert _open(one) == _open(many) == brute_orphans(ps, rs, "06")
    seen = {}
    for x in one.snapshots().collect():
        seen[x["load_period"]] = seen.get(x["load_period"], 0) + x["n_refs"]
    assert seen == {p: len(brute_orphans(ps, rs, p)) for p in {f"{k:02d}" for k in range(1, 7)} if brute_orphans(ps, rs, p)}
    assert {tuple(x) for x in many.snapshots().collect()} == {tuple(x) for x in one.snapshots().collect()}


def test_orphans_of_empty_tables(spark):
    s = OrphanState(spark).apply(spark.createDataFrame([], PARENT), spark.createDataFrame([], REF))
    assert _open(s) == set() and s.counts().count() == 0


def brute_changes(rows):
    best = {}
    for root, no, path, at, h in rows:
        if None not in (root, no, path) and (at, h or "") >= best.get((root, no, path), (None,))[0:1] + ("",) if (root, no, path) in best else True:
            if None not in (root, no, path):
                best[(root, no, path)] = (at, h)
    out = set()
    for root in {k[0] for k in best}:
        nos = sorted({k[1] for k in best if k[0] == root})
        for a, b in zip(nos, nos[1:]):
            old = {k[2]: v[1] for k, v in best.items() if k[:2] == (root, a)}
            new = {k[2]: v[1] for k, v in best.items() if k[:2] == (root, b)}
            for p in old.keys() | new.keys():
                kind = "added" if p not in old else "removed" if p not in new else "changed" if old[p] != new[p] else None
                if kind:
                    out.add((root, b, p, kind))
    return out


@pytest.mark.parametrize("bits", [4, 16])
def test_snapshot_changes_against_comparing(spark, bits):
    r = random.Random(bits)
    rows = []
    for root in ("a", "b"):
        state = {f"p{i}": "h0" for i in range(80)}
        for no in (1, 2, 4, 5):
            if (root, no) == ("b", 4):
                continue
            for _ in range(6):
                p = f"p{r.randrange(100)}"
                if r.random() < 0.3:
                    state.pop(p, None)
                else:
                    state[p] = r.choice(["h1", "h2", None])
            rows += [(root, no, p, no, h) for p, h in state.items()]
    rows += [(None, 1, "x", 1, "h"), ("a", None, "x", 1, "h"), ("a", 1, None, 1, "h"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "root string, snapshot_no int, path string, loaded_at int, h string").withColumn("now", F.lit(1))
    got = {tuple(x) for x in changes(df, "root", "path", "snapshot_no", ["loaded_at"], ["h"], leaf_bits=bits).collect()}
    assert got == brute_changes(rows) and got


def test_snapshot_corrections_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "p", 1, "x"), ("a", 2, "p", 1, "y"), ("a", 2, "p", 2, "x")], "root string, n int, path string, at int, h string")
    assert changes(df, "root", "path", "n", ["at"], ["h"]).count() == 0
    assert changes(df.limit(0), "root", "path", "n", ["at"], ["h"]).count() == 0


def test_paths(spark):
    ship(spark)
    nfd = unicodedata.normalize("NFD", "größe/Été.md")
    df = spark.createDataFrame([(" ./" + nfd + " ",), ("a\\b\\C.MDX",), (None,)], "p string")
    assert [r[0] for r in df.select(normal_path(F.col("p"))).collect()] == ["größe/Été.md", "a/b/C.MDX", None]
    keys = spark.createDataFrame([("/docs/A/Index.md",), ("index.md",), ("a/index",)], "p string").select(path_key(F.col("p")))
    assert [r[0] for r in keys.collect()] == ["a", "index", "a"]
    cases = {"../x/y.md|z": "a/x/y", "./y%20z.md#h": "a/b/y z", "docs/q/": "q", "50%/x": "50%/x", "/a+b/c.mdx?v=1": "a+b/c", "..\\..\\up.md": "up", "../../../../top.md": "top"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("home", F.lit("a/b/doc.md"))
    assert {r["t"]: r["k"] for r in df.select("t", target_key(F.col("t"), F.col("home")).alias("k")).collect()} == cases
    flags = spark.createDataFrame([("a/b",), ("x.MD",), ("http://a/b.md",), ("name",), (" ",), (None,), ("a|b/c",)], "t string").select(is_path_target(F.col("t")))
    assert [r[0] for r in flags.collect()] == [True, True, False, False, False, False, False]


def test_current_rows_and_live_edges(spark):
    docs = spark.createDataFrame([(1, "a", T[0], T[0]), (1, "b", T[2], T[1]), (1, "b", T[2], T[3]), (None, "z", T[0], T[0])], "id bigint, path string, synced_at timestamp, loaded_at timestamp")
    assert [tuple(r) for r in current_documents(docs, ["path"]).collect()] == [(1, "b")]
    cols = "id bigint, loaded_at timestamp, edge_type string, status string, valid_to timestamp, src bigint, dst bigint"
    edges = spark.createDataFrame([(1, T[0], " MD_UP", "Current ", None, 1, 2), (1, T[1], " MD_UP", "Current ", None, 1, 2), (2, T[0], "md_up", "missing", None, 1, 2), (3, T[0], "md_up", "current", T[1], 1, 2)], cols)
    assert [tuple(r) for r in live_edges(edges, ["src", "dst"]).collect()] == [(1, 1, 2, "md_up")]


def test_current_wide_keeps_one_row_of_each_id(spark, tmp_path):
    rows = [(1, "a", T[0], T[0], "x"), (1, "b", T[2], T[1], "y"), (1, "b", T[2], T[1], "y"), (2, "c", None, T[0], "z"), (None, "n", T[0], T[0], "w")]
    spark.createDataFrame(rows, "id bigint, path string, synced_at timestamp, loaded_at timestamp, body string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(tuple(r) for r in current_wide(docs, ["body"]).collect()) == [(1, "y"), (2, "z")]
    assert current_wide(docs.limit(0) if False else docs.where("id > 9"), ["body"]).count() == 0


def test_scratch_tables_go(spark):
    root = session.scratch_root(spark).removeprefix("file://") + "/weftgraph"
    with session.scratch_scope(spark):
        resolve(spark.createDataFrame([(1, 2)], "node bigint, parent bigint"), spark.createDataFrame([(1,), (2,)], "node bigint")).collect()
        inside = set(os.listdir(root))
    assert inside - set(os.listdir(root)) and not [b for b in session._OPEN if os.path.basename(b) in inside - set(os.listdir(root))]
    s = session.Scratch(spark, "mine")
    s.cut(spark.range(3))
    s.close()
    assert not os.path.exists(s.base.removeprefix("file://"))


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    class Other:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[3,2,1024]"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        session.scratch_root(Other)

"""The driver contract, and queries against their SQL on the smallest data."""

import glob
import math
import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

FAST = ["flagship", "index_range", "expand_both", "edge_alternation", "hops_1_3", "path_lengths", "agg_group", "with_having", "limit_before_aggregate", "search_scores", "health_report", "check_endpoints", "note_resolve", "note_edges", "note_sync", "context_budget", "viewer_radius", "p2_found", "p3_found", "p6_found"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return list(v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    df = entry.entry(spark)
    assert df.columns == ["customer", "nation", "acctbal"] and df.count() >= 0


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_snapshots_of_the_counts(spark):
    rows = entry.queries()["p3_snapshots"](spark, DATA).collect()
    cols = ["ref_table", "kind", "ref_month", "n_refs"]
    by_month = {k: Counter(tuple(r[c] for c in cols) for r in rows if r["load_period"] == k) for k in {r["load_period"] for r in rows}}
    first, last = min(by_month), max(by_month)
    assert len(by_month) > 3 and by_month[first] != by_month[last]
    assert by_month[last] == Counter(tuple(r[c] for c in cols) for r in entry.queries()["p3_counts"](spark, DATA).collect())


def test_core_stands_without_the_corpus_operators(tmp_path):
    """In a copy without both folders the entry imports and offers the core."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(home, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p4_found' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr

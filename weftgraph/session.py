"""Session helpers: scratch tables in the shared folder and lineage cuts.

Iterative operators cut their lineage by writing a table into the folder that
the cluster names in ``spark.checkpoint.dir`` and reading it back.  Parquet
files there outlive an executor, so a lost executor costs a re-read and not a
recomputation of every earlier round.  Tables go when nothing reads them any
more: an operator drops its own intermediate ones, ``scratch_scope`` those of a
finished query, and the end of the session all that are left.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="weftgraph-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "weftgraph.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the workers before it runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session, read from ``spark.checkpoint.dir``.

    A cluster must name it: a folder of one machine would lose tables with that
    machine, so without the setting this fails.  Only a session whose tasks all
    run in this one process (master ``local``, as in tests) gets a folder of its
    own.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


#: Folders of written tables that were not deleted yet, with the session's file settings.
_OPEN: dict[str, "Scratch"] = {}


class Scratch:
    """A set of written tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/weftgraph/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t", by: list[str] | None = None) -> "Table":
        """Write ``df`` and return a handle whose lineage starts at the files."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path, partitionBy=by)
        self._register()
        return Table(self.spark, path, schema)

    def folder(self) -> str:
        """The folder itself, for what writes its own files there; it goes like the tables."""
        fs, p = _file_system(self.spark, self.base)
        fs.mkdirs(p)
        self._register()
        return self.base

    def _register(self) -> None:
        if self.base not in _OPEN:
            _OPEN[self.base] = self
            fs, p = _file_system(self.spark, self.base)
            fs.deleteOnExit(p)  # also where this process ends without its own exit handlers

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.write(df, name).df

    def close(self) -> None:
        """Delete every table of this run; call only when none is read again."""
        if _OPEN.pop(self.base, None) is not None:
            _delete(self.spark, self.base)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written within; results must be stored by then."""
    before = set(_OPEN)
    try:
        yield
    finally:
        for base in [b for b in _OPEN if b not in before]:
            _OPEN[base].close()


@atexit.register
def _sweep() -> None:
    for s in list(_OPEN.values()):
        try:
            s.close()
        except Exception:  # the JVM is gone and has deleted them itself
            return


class Table:
    """One written table."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)

"""Watching a directory of notes with Structured Streaming.

A rate stream gives the ticks; each tick takes a digest of the files (size and
time of change), and a change starts a sync once it has been quiet for the debounce
time or the batch window is over.  All is processing time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str) -> tuple[int, int, int]:
    """Number of notes below ``root`` and two digests of their paths, sizes and times of change.

    The file source lists in parallel and reads no content; only this one row
    comes back, however many notes there are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],[mM][dD][xX]}").load(root)
    h = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.select(h.alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("h", F.lit(1))), F.lit(0))).first())


@dataclass
class Watch:
    """Decides at each tick whether to sync."""

    list_files: Callable[[], object]  # what it gives is only compared
    sync: Callable[[], dict]
    debounce: float = 0.2
    window: float = 2.0
    clock: Callable[[], float] = time.monotonic
    runs: list = field(default_factory=list)
    _synced: object = None
    _last: object = None
    _first_change: float | None = None
    _last_change: float = 0.0

    def tick(self) -> dict | None:
        """One poll; the report of a sync if one ran."""
        now, files = self.clock(), self.list_files()
        if self._synced is None:
            return self._run(files)
        if files != self._last:
            self._last, self._last_change = files, now
            self._first_change = self._first_change if self._first_change is not None else now
        if self._first_change is None:
            return None
        if files == self._synced:
            self._first_change = None  # changed back
            return None
        if now - self._last_change >= self.debounce or now - self._first_change >= self.window:
            return self._run(files)
        return None

    def _run(self, files: object) -> dict:
        report = self.sync()
        self._synced = self._last = files
        self._first_change = None
        self.runs.append(report)
        return report


def start(spark: SparkSession, root: str, sync: Callable[[], dict], poll: float = 0.1, max_runs: int | None = None, idle: float | None = None):
    """A streaming query that keeps a vault in step with its directory.

    It stops after ``max_runs`` syncs or ``idle`` seconds without one.
    """
    w = Watch(lambda: listing(spark, root), sync)
    began = [time.monotonic()]

    def batch(_df, _no) -> None:
        if w.tick() is not None:
            began[0] = time.monotonic()
        if (max_runs and len(w.runs) >= max_runs) or (idle and time.monotonic() - began[0] > idle):
            query.stop()

    stream = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = stream.writeStream.foreachBatch(batch).trigger(processingTime=f"{max(1, int(poll * 1000))} milliseconds").start()
    query.watch = w
    return query

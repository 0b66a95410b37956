"""Keyed state of a stream as sorted runs that are merged by size.

Every micro-batch appends one run: its own best row per key, sorted by a hash of the key. No batch
reads what came before it. A run is a folder ``run=<first>-<last>`` named after the batches it
covers; reading the state takes the widest runs that cover all batches and picks the best row per
key over them. When ``fanout`` neighbouring runs have the same size class they are merged into one,
so a row is written once per size class: the work of a batch follows the batch, and the number of
runs follows the logarithm of the state. A run is cut into buckets, ranges of the key hash in files
of about ``bucket_bytes``; it has as many as its bytes ask for, so buckets split as the state grows.

Recovery: a run counts once its ``_SUCCESS`` file exists. A replayed batch writes its own run anew.
Only runs of earlier batches are merged, which a replay can no longer touch, and the runs that a
merge replaced are deleted by a later batch, so that whoever is reading them can finish.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import top_per_key

HASH = "_key_hash"


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    size: int

    @property
    def name(self) -> str:
        return f"run={self.first}-{self.last}"


class SortedRuns:
    """Best row per key in sorted runs.

    ``order`` ranks the rows of a key, as in ``dedupe.keep_best``. With ``best`` the runs keep every
    row and ``best`` is applied to all of them when the state is read, for rules in which rows that
    lose still give something to the winner. Null keys are a key of their own.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        order: Sequence[Column],
        best: Callable[[DataFrame], DataFrame] | None = None,
        fanout: int = 4,
        bucket_bytes: int = 128 << 20,
        least_bytes: int = 1 << 20,
    ):
        self.spark, self.path, self.keys, self.order, self.best = spark, path, list(keys), list(order), best
        self.fanout, self.bucket_bytes, self.least_bytes = fanout, bucket_bytes, least_bytes

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[Run]:
        """All complete runs, also those that a wider one replaces."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        found = []
        for status in fs.listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith("run=") and fs.exists(self._path(name, "_SUCCESS")):
                first, last = name[len("run=") :].split("-")
                found.append(Run(int(first), int(last), fs.getContentSummary(status.getPath()).getLength()))
        return sorted(found, key=lambda r: (r.first, -r.last))

    def current(self, below: int | None = None) -> list[Run]:
        """The widest runs that cover the batches before ``below``, oldest first."""
        kept: list[Run] = []
        for run in self.runs():
            if (below is None or run.last < below) and (not kept or run.first > kept[-1].last):
                kept.append(run)
        return kept

    def _rows(self, runs: Sequence[Run]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{r.name}") for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _picked(self, rows: DataFrame) -> DataFrame:
        return rows if self.best else top_per_key(rows, [HASH, *self.keys], self.order)

    def _write(self, rows: DataFrame, run: Run, buckets: int | None) -> None:
        """Rows of one range of key hashes lie in one file, sorted, so that a lookup reads few of them."""
        dealt = rows.repartitionByRange(buckets, HASH) if buckets else rows
        picked = self._picked(dealt).sortWithinPartitions(HASH)
        picked.write.mode("overwrite").parquet(f"{self.path}/{run.name}")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Write the run of one batch, then merge runs of earlier batches where their sizes ask for it."""
        self.drop_replaced(batch_id)
        self._write(batch.withColumn(HASH, F.xxhash64(*self.keys)), Run(batch_id, batch_id, 0), None)
        self.compact(batch_id)

    def _class(self, run: Run) -> int:
        size, of = max(run.size, 1), 0
        while size > self.least_bytes:
            size, of = size // self.fanout, of + 1
        return of

    def due(self, below: int) -> list[Run]:
        """The newest ``fanout`` neighbouring runs of one size class, if there are any."""
        runs = self.current(below)
        for end in range(len(runs), self.fanout - 1, -1):
            group = runs[end - self.fanout : end]
            if len({self._class(r) for r in group}) == 1:
                return group
        return []

    def compact(self, below: int) -> None:
        while group := self.due(below):
            size = sum(r.size for r in group)
            merged = Run(group[0].first, group[-1].last, size)
            self._write(self._rows(group), merged, -(-size // self.bucket_bytes))

    def drop_replaced(self, below: int) -> None:
        """Delete the runs that a wider run of earlier batches replaces."""
        kept = self.current(below)
        for run in self.runs():
            if run not in kept and any(k.first <= run.first and run.last <= k.last for k in kept):
                self._fs().delete(self._path(run.name), True)

    def read(self, below: int | None = None) -> DataFrame | None:
        """Best row per key over all runs; None before the first batch."""
        rows = self._rows(self.current(below))
        if rows is None:
            return None
        return self.best(rows.drop(HASH)) if self.best else self._picked(rows).drop(HASH)

    def lookup(self, wanted: DataFrame) -> DataFrame | None:
        """The state of the keys in ``wanted``: rows of other keys are dropped before the rows of a key meet."""
        rows = self._rows(self.current())
        if rows is None:
            return None
        hashes = wanted.select(F.xxhash64(*self.keys).alias(HASH)).distinct()
        near = rows.join(hashes, HASH, "left_semi")
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.keys]
        asked = near.alias("s").join(wanted.select(*self.keys).distinct().alias("w"), reduce(lambda a, b: a & b, same), "left_semi")
        return self.best(asked.drop(HASH)) if self.best else self._picked(asked).drop(HASH)

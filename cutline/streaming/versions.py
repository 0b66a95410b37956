"""Results of a stream as numbered Parquet versions, one per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedState:
    """Numbered parquet versions, one per micro-batch.

    A batch reads the newest version below its own number and writes its own, so a
    replayed batch overwrites what its first run left behind and nothing is applied twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        hadoop = path(self.path)
        fs = self._fs(hadoop)
        if not fs.exists(hadoop):
            return []
        names = [s.getPath() for s in fs.listStatus(hadoop)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(path(p, "_SUCCESS")))

    def latest(self, below: int | None = None) -> DataFrame | None:
        versions = [v for v in self.versions() if below is None or v < below]
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}") if versions else None

    def all(self) -> DataFrame | None:
        """Rows of every version together, for results that batches add to."""
        versions = self.versions()
        return self.spark.read.parquet(*[f"{self.path}/v={v}" for v in versions]) if versions else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def keep_newest(self, n: int, below: int) -> None:
        """Delete all but the newest ``n`` versions below ``below``, which are all that a replay can ask for."""
        for version in [v for v in self.versions() if v < below][:-n]:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version}")
            self._fs(old).delete(old, True)

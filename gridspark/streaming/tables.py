"""The tables of a volume that grows batch by batch, in a folder that all executors share."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from gridspark.operators.grid import Grid
from gridspark.operators.neighborhood import check_connectivity, half_offsets


class VolumeTables:
    """A growing volume in the folder `path`. grid.sz may grow: in order F it isn't used, and cells are numbered plane by
    plane."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, connectivity: int = 26, binary: bool = False):
        check_connectivity(connectivity, grid)
        if grid.order != "F":
            raise ValueError("a volume that grows in z is numbered in order F")
        self.spark, self.path, self.binary = spark, path.rstrip("/"), binary
        self.grid = replace(grid, sz=(1 << 31) - 1)
        self.steps = half_offsets(connectivity, grid.ndim)

    def _folders(self, name: str) -> list[str]:
        """The names of the folders of a table, sorted; none if there is no table yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()) if files.exists(at) else []

    def _read(self, name: str, parts: list[str] | None = None) -> DataFrame | None:
        """A table of the volume, or those of its folders that are named and exist."""
        there = self._folders(name)
        parts = there if parts is None else [p for p in parts if p in there]
        base = f"{self.path}/{name}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/{p}" for p in parts]) if parts else None

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in the cells (x, y, z, v) of one batch."""
        raise NotImplementedError

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        """A writer of a stream of cells into this volume; give it a checkpoint location and a trigger, and start it."""
        return stream.writeStream.foreachBatch(lambda batch, batch_id: self.add(batch, batch_id))

    def _done(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

"""Components of a volume that arrives as slabs in z order, each given out once it can't grow any more, then forgotten.

What is kept between batches is bounded by one plane: the cells of the last plane that came, each with the name of its
component so far, and one row of sums for each component that has a cell there. Only these can grow. A component's name
is the linear index of its first cell, so that a name never changes unless two components that both reach the plane
meet; then the smaller name stays. Three tables are only ever appended to, a folder for each batch:

* cells: x, y, z, v, and root, the name when the cell came;
* merged: root, into, for each name that went;
* closed: a row for each component that ended, with its final name, size, box and sums.

A batch reads the state that the batch before it left, never what was given out. If it comes again after a failure it
reads the same state and overwrites its own folders; the state is written last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import halo
from gridspark.operators.grid import foreground
from gridspark.operators.label import matching
from gridspark.operators.seams import BROADCAST_LABELS, components, label_blocks
from gridspark.operators.stats import BOXES
from gridspark.plans.components import connected_components
from gridspark.plans.scratch import small, written
from gridspark.streaming.tables import VolumeTables

#: States that stay: the one of the last batch, and the one it came from, should it come again.
STATES = 2
#: Sums over the cells of a component; whole numbers that no volume makes too long.
SUMS = [f"{n}sum" for n in "xyz"]
_EMPTY = "root long, voxel_counts long, " + ", ".join(f"{b} int" for b in BOXES) + ", " + ", ".join(f"{s} decimal(38,0)" for s in SUMS)


class FrontierLabels(VolumeTables):
    """Components of slabs that come in z order: every batch holds whole planes, all above those that came before. A batch
    without rows changes nothing; planes without foreground may be left out or come as cells of value 0. Of cells that
    come twice in one batch each counts. Cells off the grid count for nothing."""

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in one batch, and gives out the components without a cell in its last plane. A plane that isn't above all
        that came before is refused."""
        reach = batch.agg(F.min("z").alias("low"), F.max("z").alias("high")).first()
        if reach.low is None:
            return
        before = self._state(batch_id)
        if before is not None and self._table(f"{before}/reach").first().high >= reach.low:
            raise ValueError(f"batch {batch_id} has planes from {reach.low} on, which aren't above those before it")
        joined = matching(0, self.binary)
        cells, rooted = components(foreground(batch, self.binary), self.grid, self.steps, joined)
        cells = cells.join(small(rooted, BROADCAST_LABELS), "root").select("x", "y", "z", "v", F.col("first").alias("root"))
        held = None if before is None else self._table(f"{before}/open")
        names = None
        if before is not None:
            met = self._table(f"{before}/plane").unionByName(written(cells.filter(F.col("z") == reach.low), "plane"))
            links = written(halo.edges(met, self.grid, self.steps, "root", joined, label_blocks(self.grid)), "links")
            names = written(connected_components(links, written).select(F.col("node").alias("root"), F.col("label").alias("into")).filter("root <> into"), "names")
            cells = self._renamed(cells, names)
            gone = names.join(held.select("root"), "root", "left_semi")  # names of this batch alone were never given out
            gone.write.mode("overwrite").parquet(f"{self.path}/merged/batch={batch_id}")
            held = self._renamed(held, names)
        cells.write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch_id}")
        cells = self._table(f"cells/batch={batch_id}")
        parts = cells.groupBy("root").agg(*self._sums(cells=True))
        if held is not None:
            parts = parts.unionByName(held).groupBy("root").agg(*self._sums(cells=False))
        parts = written(parts, "parts")
        plane = cells.filter(F.col("z") == reach.high)
        self._settle(batch_id, parts, plane, reach.high)

    def finish(self, batch_id: int) -> None:
        """Gives out what is left: nothing more will come. batch_id is above those of all batches."""
        before = self._state(batch_id)
        if before is not None:
            plane = self._table(f"{before}/plane").limit(0)
            self._settle(batch_id, self._table(f"{before}/open"), plane, self._table(f"{before}/reach").first().high)

    def _settle(self, batch_id: int, parts: DataFrame, plane: DataFrame, high: int) -> None:
        """Writes the components of parts that have no cell in the plane as closed, the others as the new state."""
        alive = written(plane.select("root").distinct(), "alive")
        parts.join(alive, "root", "left_anti").write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")
        new = f"state/v={batch_id}"
        plane.write.mode("overwrite").parquet(f"{self.path}/{new}/plane")
        parts.join(alive, "root", "left_semi").write.mode("overwrite").parquet(f"{self.path}/{new}/open")
        self.spark.createDataFrame([(high,)], "high int").write.mode("overwrite").parquet(f"{self.path}/{new}/reach")
        for old in self._states(batch_id)[:-STATES]:
            self._delete(f"state/v={old}")

    @staticmethod
    def _sums(cells: bool) -> list:
        """Aggregates of a component, from its cells or from parts of it."""
        count = F.count(F.lit(1)) if cells else F.sum("voxel_counts")
        boxes = [f(n if cells else f"{n}{m}").cast("int").alias(f"{n}{m}") for n in "xyz" for m, f in (("min", F.min), ("max", F.max))]
        sums = [F.sum(F.col(n if cells else f"{n}sum").cast("decimal(28,0)")).cast("decimal(38,0)").alias(f"{n}sum") for n in "xyz"]
        return [count.alias("voxel_counts"), *boxes, *sums]

    @staticmethod
    def _renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
        """rows with root as the table names (root, into) has it."""
        found = rows.join(small(names, BROADCAST_LABELS), "root", "left")
        return found.withColumn("root", F.coalesce("into", "root")).select(*rows.columns)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _states(self, upto: int) -> list[int]:
        """The batches up to that one whose states are whole, in order."""
        found = sorted(int(v.split("=")[1]) for v in self._folders("state"))
        return [v for v in found if v <= upto and self._done(f"state/v={v}/reach")]

    def _state(self, batch_id: int) -> str | None:
        """The state that a batch goes on from; None for the first one."""
        before = self._states(batch_id - 1)
        return f"state/v={before[-1]}" if before else None

    def _since(self, name: str, after: int | None) -> DataFrame | None:
        """The rows of a table that batches after a given one wrote; of all batches that are whole if it is None."""
        last = self._states((1 << 63) - 1)
        parts = [p for p in self._folders(name) if last and int(p.split("=")[1]) <= last[-1] and (after is None or int(p.split("=")[1]) > after)]
        return self._read(name, parts)

    def statistics(self, after: int | None = None) -> DataFrame:
        """first, voxel_counts, inclusive boxes and centroids of the components that are closed, or that were closed by
        batches after a given one. first is the linear index of the component's first cell, in order F."""
        closed = self._since("closed", after)
        closed = self.spark.createDataFrame([], _EMPTY) if closed is None else closed
        means = [(F.col(f"{n}sum").cast("double") / F.col("voxel_counts")).alias(f"c{n}") for n in "xyz"]
        return closed.select(F.col("root").alias("first"), "voxel_counts", *BOXES, *means)

    def finished(self, after: int | None = None) -> DataFrame:
        """(x, y, z, first) of the cells of the components that statistics() tells. Names that went are followed to the
        one that stayed; then cells meet the names of closed components, in any order of batches."""
        cells, merged = self._since("cells", None), self._since("merged", None)
        if cells is None:
            return self.spark.createDataFrame([], "x int, y int, z int, first long")
        closed = self.statistics(after).select("first")
        known = [closed.select(F.col("first").alias("root"), "first")]
        if merged is not None:
            edges = written(merged.select(F.col("root").alias("a"), F.col("into").alias("b")), "merged")
            gone = connected_components(edges, written).select(F.col("node").alias("root"), F.col("label").alias("first")).filter("root <> first")
            known.append(gone.join(closed, "first", "left_semi").select("root", "first"))
        names = written(reduce(DataFrame.unionByName, known), "names")
        return cells.join(small(names, BROADCAST_LABELS), "root").select("x", "y", "z", "first")

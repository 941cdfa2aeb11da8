"""Labelling a volume that arrives in micro-batches of cells, larger than any of them.

The components of a batch are found on its own; its cells are kept with their root, the component's first cell. Links to
what came before are found from the planes next to the batch's alone, one for each two roots that touch. A batch never
rewrites earlier ones: which roots belong together is a table of its own, brought up to date when labels are asked for.
Then only the links of batches that came since are contracted, with ends replaced by what the table says. Batches may
come in any order and may split planes and rows. A repeated batch overwrites its own files, which makes a restarted
stream exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import halo
from gridspark.operators.grid import foreground
from gridspark.operators.label import dense_labels, matching
from gridspark.operators.seams import BROADCAST_LABELS, components, label_blocks
from gridspark.plans.components import connected_components
from gridspark.plans.scratch import small, written
from gridspark.streaming.tables import VolumeTables

#: Planes whose cells share a folder.
DEPTH = 32


class SlabLabels(VolumeTables):
    """Labels of a growing volume in the folder `path`, which all executors share. grid.sz may grow: in order F it
    isn't used, and cells are numbered plane by plane."""

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in the cells (x, y, z, v) of one batch. Cells lie in folders by z, so that a batch opens only those next
        to it, however many came before."""
        joined = matching(0, self.binary)
        cells, rooted = components(foreground(batch, self.binary), self.grid, self.steps, joined)
        planes = cells.agg(F.min("z").alias("low"), F.max("z").alias("high")).first()
        if planes.low is None:
            return
        cells = cells.join(small(rooted, BROADCAST_LABELS), "root").select("x", "y", "z", "v", F.col("first").alias("root"))
        placed = cells.withColumns({"zs": F.floor(F.col("z") / DEPTH), "batch": F.lit(batch_id)})
        placed.write.partitionBy("zs", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/cells")
        near = self._read("cells", [f"zs={k}" for k in range((planes.low - 1) // DEPTH, (planes.high + 1) // DEPTH + 1)])
        others = near.filter((F.col("batch") != batch_id) & F.col("z").between(planes.low - 1, planes.high + 1))
        reach = others.agg(F.min("z").alias("low"), F.max("z").alias("high")).first()
        links = f"{self.path}/links/batch={batch_id}"
        if reach.low is None:
            self.spark.createDataFrame([], "a long, b long").write.mode("overwrite").parquet(links)
            return
        mine = near.filter((F.col("batch") == batch_id) & F.col("z").between(reach.low - 1, reach.high + 1))
        met = mine.unionByName(others).select("x", "y", "z", "v", "root")
        halo.edges(met, self.grid, self.steps, "root", joined, label_blocks(self.grid)).write.mode("overwrite").parquet(links)

    def equivalences(self) -> DataFrame | None:
        """(root, first) of the roots that have links: the smallest root of their component. Brought up to date with the
        batches whose links it doesn't hold yet; a new version is written beside the old one, which goes afterwards."""
        versions = sorted(self._folders("solved"), key=lambda v: int(v.split("=")[1]))
        whole = [v for v in versions if self._done(f"solved/{v}/batches") and self._done(f"solved/{v}/roots")]
        held = self.spark.read.parquet(f"{self.path}/solved/{whole[-1]}/roots") if whole else None
        known = {r.batch for r in self.spark.read.parquet(f"{self.path}/solved/{whole[-1]}/batches").collect()} if whole else set()  # a row for each batch
        batches = {p.split("=")[1] for p in self._folders("links")}
        if batches == known:
            return held
        links = self._read("links", [f"batch={b}" for b in sorted(batches - known)]).select("a", "b")
        if held is not None:
            for end in ("a", "b"):
                to = held.select(F.col("root").alias(end), F.col("first").alias("_to"))
                links = links.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "new_links")
        found = connected_components(links, written).select(F.col("node").alias("root"), F.col("label").alias("first"))
        if held is not None:
            moved = found.select(F.col("root").alias("first"), F.col("first").alias("_new"))
            kept = held.join(moved, "first", "left").select("root", F.coalesce("_new", "first").alias("first"))
            found = kept.unionByName(found.join(held, "root", "left_anti"))
        new = f"{self.path}/solved/v={1 + (int(versions[-1].split('=')[1]) if versions else 0)}"
        found.write.parquet(f"{new}/roots")
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").write.parquet(f"{new}/batches")
        for old in versions:
            self._delete(f"solved/{old}")
        return self.spark.read.parquet(f"{new}/roots")

    def _rooted(self, cells: DataFrame) -> DataFrame:
        same = self.equivalences()
        if same is None:
            return cells.withColumn("first", F.col("root"))
        return cells.join(same, "root", "left").withColumn("first", F.coalesce("first", "root"))

    def labels(self) -> DataFrame | None:
        """(x, y, z, label) of all cells so far, numbered as connected_components() does; None before any cell came."""
        cells = self._read("cells")
        if cells is None:
            return None
        rooted = written(self._rooted(cells.select("root").distinct()), "rooted")
        labels = written(rooted.join(dense_labels(rooted, "first"), "first").select("root", "label"), "labels")
        return cells.join(small(labels, BROADCAST_LABELS), "root").select("x", "y", "z", "label")

    def finished(self, below: int) -> DataFrame | None:
        """(first, x, y, z) of the cells of components that can't grow any more if all cells with z < below have come and no
        others will: those without a cell in the plane below - 1. Each is named by its first cell. None before any cell
        came. A component is told by its roots: the highest plane of each, one partial aggregate."""
        cells = self._read("cells")
        if cells is None:
            return None
        cells = cells.filter(F.col("z") < below)
        tops = written(self._rooted(cells.groupBy("root").agg(F.max("z").alias("top"))), "tops")
        closed = tops.groupBy("first").agg(F.max("top").alias("top")).filter(F.col("top") < below - 1).select("first")
        done = written(tops.join(closed, "first").select("root", "first"), "finished")
        return cells.join(small(done, BROADCAST_LABELS), "root").select("first", "x", "y", "z")

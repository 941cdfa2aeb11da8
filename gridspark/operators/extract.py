"""Images of single labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.grid import foreground
from gridspark.plans.scratch import written


def each(labels: DataFrame, binary: bool = False, column: str = "label") -> DataFrame:
    """(label, x, y, z, value) of every label but 0: its cells with the label as value, or true. The images of all
    labels are one relation; ComponentIndex has them apart."""
    cells = foreground(labels, column=column).select(F.col("v").cast("long").alias("label"), "x", "y", "z")
    return cells.withColumn("value", F.lit(True) if binary else F.col("label"))


class ComponentIndex:
    """Cells clustered by label in files, and an index of which files hold a label, its count of cells and its box.

    One range shuffle and one scan of the result make it; a giant label is spread over several files, many little ones
    share one. An image then reads the files of its label alone, and all images together read every file once.
    """

    def __init__(self, labels: DataFrame, column: str = "label"):
        cells = each(labels, column=column).drop("value")
        order = ["label", "z", "y", "x"]
        self.cells = written(cells.repartitionByRange(*order).sortWithinPartitions(*order), "images")
        boxes = [f(n).alias(f"{n}{m}") for n in "xyz" for m, f in (("min", F.min), ("max", F.max))]
        found = self.cells.groupBy("label", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), *boxes)
        self.files = written(found, "image_files")

    def labels(self) -> DataFrame:
        """(label, voxel_counts, xmin, xmax, ...) from the index alone; boxes are inclusive."""
        boxes = [f(f"{n}{m}").alias(f"{n}{m}") for n in "xyz" for m, f in (("min", F.min), ("max", F.max))]
        return self.files.groupBy("label").agg(F.sum("n").alias("voxel_counts"), *boxes)

    def _read(self, files: list[str]) -> DataFrame:
        return self.cells.sparkSession.read.schema(self.cells.schema).parquet(*files)

    def image(self, label: int) -> DataFrame:
        """(x, y, z) of one label; only its files are opened. A label that doesn't occur has no cells."""
        files = [r.file for r in self.files.filter(F.col("label") == label).select("file").collect()]  # files of one label
        return (self._read(files) if files else self.cells.limit(0)).filter(F.col("label") == label).select("x", "y", "z")

    def images(self) -> Iterator[tuple[int, DataFrame]]:
        """(label, its cells as a lazy DataFrame), by ascending label."""
        by_label = self.files.groupBy("label").agg(F.collect_list("file").alias("files")).orderBy("label")
        for row in by_label.toLocalIterator():
            yield row.label, self._read(row.files).filter(F.col("label") == row.label).select("x", "y", "z")

    def arrays(self) -> Iterator[tuple[int, tuple[int, int, int], np.ndarray]]:
        """(label, corner, mask of its box) of every label, ascending. Files come to the driver one after another, in
        the order of their labels; it holds one file and the cells of one label."""
        order = self.files.groupBy("file").agg(F.min("label").alias("low"), F.max("label").alias("high")).orderBy("low", "high")
        held: list[np.ndarray] = []
        last = None
        for row in order.select("file").toLocalIterator():
            table = self._read([row.file]).toArrow()
            label = table.column("label").to_numpy()
            at = np.stack([table.column(n).to_numpy() for n in "xyz"], 1)
            by_label = np.argsort(label, kind="stable")  # a file may come in more than one piece
            label, at = label[by_label], at[by_label]
            starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(label)), strict=True):
                if label[a] != last and held:
                    yield (last, *_crop(held))
                    held = []
                last = int(label[a])
                held.append(at[a:b])
        if held:
            yield (last, *_crop(held))


def _crop(parts: list[np.ndarray]) -> tuple[tuple[int, int, int], np.ndarray]:
    at = np.concatenate(parts)
    corner = at.min(axis=0)
    mask = np.zeros(at.max(axis=0) - corner + 1, bool)
    mask[tuple((at - corner).T)] = True
    return tuple(map(int, corner)), mask


class Each:
    """Iterates over (label, cells (x, y, z, value) of the label), ascending, without label 0; len() is the number of
    labels. The labels are read once, for the index; an image reads its own files."""

    def __init__(self, labels: DataFrame, binary: bool = False, column: str = "label"):
        self._labels, self._binary, self._column = labels, binary, column
        self._index: ComponentIndex | None = None

    @property
    def index(self) -> ComponentIndex:
        if self._index is None:
            self._index = ComponentIndex(self._labels, self._column)
        return self._index

    def __len__(self) -> int:
        return self.index.files.select("label").distinct().count()

    def __iter__(self) -> Iterator[tuple[int, DataFrame]]:
        for label, cells in self.index.images():
            yield label, cells.withColumn("value", F.lit(True) if self._binary else F.lit(label).cast("long"))

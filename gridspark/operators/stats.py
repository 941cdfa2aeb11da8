"""Per-label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid
from gridspark.plans.scratch import written

BOXES = ["xmin", "xmax", "ymin", "ymax", "zmin", "zmax"]


def label_statistics(labels: DataFrame, column: str = "label") -> DataFrame:
    """label, voxel_counts, inclusive boxes and centroids of the labels that occur; one partial aggregate."""
    boxes = [f(n).cast("int").alias(f"{n}{m}") for n in "xyz" for m, f in (("min", F.min), ("max", F.max))]
    means = [F.avg(F.col(n).cast("double")).alias(f"c{n}") for n in "xyz"]
    return labels.groupBy(F.col(column).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("voxel_counts"), *boxes, *means)


def _background(cells: DataFrame, grid: Grid) -> DataFrame:
    """The row of label 0, or none if the cells fill the grid: what the planes across each axis lack of being full."""
    sizes = dict(zip("xyz", (grid.sx, grid.sy, grid.sz), strict=True))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).cast("long").alias("at")) for n in "xyz"])).alias("_p")
    held = cells.select(at).groupBy("_p.axis", "_p.at").agg(F.count(F.lit(1)).alias("_n"))
    spark = cells.sparkSession
    planes = [spark.range(size).select(F.lit(n).alias("axis"), F.col("id").alias("at"), F.lit(grid.cells // size).alias("_full")) for n, size in sizes.items()]
    left = planes[0].unionByName(planes[1]).unionByName(planes[2]).join(held, ["axis", "at"], "left").withColumn("_n", F.col("_full") - F.coalesce("_n", F.lit(0).cast("long"))).filter("_n > 0")

    def on(n: str, value: Column) -> Column:
        return F.when(F.col("axis") == n, value)

    boxes = [f(on(n, F.col("at"))).cast("int").alias(f"{n}{m}") for n in "xyz" for m, f in (("min", F.min), ("max", F.max))]
    count = F.sum(on("x", F.col("_n")))
    means = [(F.sum(on(n, (F.col("at") * F.col("_n")).cast("double"))) / count).alias(f"c{n}") for n in "xyz"]
    return left.agg(count.alias("voxel_counts"), *boxes, *means).select(F.lit(0).cast("long").alias("label"), "*").filter("voxel_counts > 0")


def statistics(labels: DataFrame, grid: Grid, column: str = "label", no_slice_conversion: bool = False) -> DataFrame:
    """Row for each label from 0, the background, to the largest: count, box and centroid.

    Boxes are half-open (xmin <= x < xmax), with no_slice_conversion inclusive. A label that doesn't occur has count
    0, a null box and a NaN centroid. Negative labels and labels above the number of cells are refused.
    """
    cells = labels.select("x", "y", "z", F.col(column).cast("long").alias("label")).filter("label <> 0")
    found = written(label_statistics(cells).unionByName(_background(cells, grid)), "statistics")
    limits = found.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if limits.low is not None and (limits.low < 0 or limits.high > grid.cells):
        raise ValueError("labels must be from 0 to the number of cells")
    full = labels.sparkSession.range((limits.high or 0) + 1).withColumnRenamed("id", "label").join(found, "label", "left")
    nan = F.lit(float("nan"))
    out = full.withColumn("voxel_counts", F.coalesce("voxel_counts", F.lit(0).cast("long"))).withColumns({f"c{n}": F.coalesce(f"c{n}", nan) for n in "xyz"})
    return out if no_slice_conversion else out.withColumns({f"{n}max": F.col(f"{n}max") + 1 for n in "xyz"})

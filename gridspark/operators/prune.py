"""Keeping components by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid, foreground
from gridspark.operators.label import cell_labels
from gridspark.operators.seams import BROADCAST_LABELS
from gridspark.plans.scratch import small, written


def _labelled(df: DataFrame, grid: Grid, connectivity: int, binary: bool, precomputed: bool, delta: float, periodic: bool, column: str) -> tuple[DataFrame, DataFrame]:
    """Foreground cells (x, y, z, _value, root), and (root, label, n): the label of each root and how many cells have that
    root. The cells of a block are summed where they lie; what is joined and summed again are roots."""
    if precomputed:
        cells = foreground(df.withColumn("_value", F.col(column)), column=column, keep=("_value",)).withColumn("root", F.col("v").cast("long"))
        sizes = cells.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        return cells, written(sizes.select("root", F.col("root").alias("label"), "n"), "sizes")
    cells, labels = cell_labels(df, grid, connectivity, delta, periodic, binary, column, keep=True)
    sizes = cells.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return cells, written(labels.join(sizes, "root"), "sizes")


def _sizes(roots: DataFrame) -> DataFrame:
    return written(roots.groupBy("label").agg(F.sum("n").alias("voxel_counts")), "sizes")


def dust(
    df: DataFrame, grid: Grid, threshold: float | tuple[float, float], connectivity: int = 26, invert: bool = False, binary_image: bool = False,
    precomputed_ccl: bool = False, return_N: bool = False, delta: float = 0, periodic_boundary: bool = False, column: str = "v",
) -> DataFrame | tuple[DataFrame, int]:
    """Foreground cells of df, with their values, in components that are large enough.

    A number as threshold keeps sizes of at least that; a pair (low, high) keeps low <= size < high; invert keeps the
    others instead. With precomputed_ccl the values are the labels.
    """
    cells, roots = _labelled(df, grid, connectivity, binary_image, precomputed_ccl, delta, periodic_boundary, column)
    size = F.col("voxel_counts")
    fits = (size >= threshold[0]) & (size < threshold[1]) if isinstance(threshold, (tuple, list)) else size >= threshold
    kept = written(_sizes(roots).filter(~fits if invert else fits).select("label"), "kept")
    kept_roots = written(roots.join(small(kept), "label", "left_semi").select("root"), "kept_roots")
    out = cells.join(small(kept_roots, BROADCAST_LABELS), "root", "left_semi").select("x", "y", "z", F.col("_value").alias(column))
    return (out, kept.count()) if return_N else out


def largest_k(
    df: DataFrame, grid: Grid, k: int, connectivity: int = 26, binary_image: bool = False, precomputed_ccl: bool = False,
    return_N: bool = False, delta: float = 0, periodic_boundary: bool = False, column: str = "v",
) -> DataFrame | tuple[DataFrame, int]:
    """(x, y, z, label) of the k largest components, labelled 1 to k by ascending size, ties by ascending old label
    (of those as large as the smallest kept one, the lower labels stay). With k components or fewer labels stay."""
    if k < 0:
        raise ValueError("k must not be negative")
    cells, roots = _labelled(df, grid, connectivity, binary_image, precomputed_ccl, delta, periodic_boundary, column)
    sizes = _sizes(roots)
    n = sizes.count()
    if n > k > 0:
        top = sizes.orderBy(F.desc("voxel_counts"), "label").limit(k)
        new = top.select("label", F.row_number().over(Window.orderBy("voxel_counts", "label")).cast("long").alias("_new"))  # k rows
        roots = written(roots.join(small(written(new, "largest")), "label").select("root", F.col("_new").alias("label")), "largest_roots")
        n = k
    elif k == 0:
        roots, n = roots.limit(0), 0
    out = cells.join(small(roots.select("root", "label"), BROADCAST_LABELS), "root").select("x", "y", "z", "label")
    return (out, n) if return_N else out

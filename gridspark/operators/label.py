"""Connected-component labelling of grids."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid, foreground, is_float
from gridspark.operators.neighborhood import check_connectivity, offsets
from gridspark.operators.seams import BROADCAST_LABELS, Joined, components
from gridspark.plans.scratch import small, written

_OUT = {"uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}


def matching(delta: float, binary: bool) -> Joined:
    """Whether the values of cells are equal, or differ by delta at most; in binary mode all go together. NaN is unequal."""

    def joined(rows: pa.Table, _: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if binary:
            return np.ones(len(i), bool)
        v = rows.column("v").to_numpy()
        if not delta:
            return np.equal(v[i], v[j]).astype(bool)
        if v.dtype.kind != "i":
            return np.abs(v[i] - v[j]).astype(float) <= delta
        one, other = v[i].astype(np.int64), v[j].astype(np.int64)
        apart = np.maximum(one, other).view(np.uint64) - np.minimum(one, other).view(np.uint64)  # wraps to the true difference
        return apart <= np.uint64(min(int(delta), 2**64 - 1))

    return joined


def _across_borders(cells: DataFrame, grid: Grid, connectivity: int, binary: bool) -> DataFrame:
    """Edges (a, b) between roots of cells of equal value that are neighbours across opposite borders of the grid."""
    sizes = (grid.sx, grid.sy, grid.sz)
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for n, d in zip("xyz", o, strict=True)]) for o in offsets(connectivity, grid.ndim)])
    border = reduce(or_, [(F.col(n) == 0) | (F.col(n) == size - 1) for n, size in zip("xyz", sizes, strict=True) if size > 1] or [F.lit(True)])
    edge = cells.filter(border)
    if is_float(cells):
        edge = edge.filter(~F.isnan("v"))
    there = {n: F.col(n) + F.col(f"_o.d{n}") for n in "xyz"}
    leaves = reduce(or_, [~there[n].between(0, size - 1) for n, size in zip("xyz", sizes, strict=True)])
    one = edge.select("x", "y", "z", "v", F.col("root").alias("a"), F.explode(steps).alias("_o")).filter(leaves)
    one = one.select("a", "v", *[F.pmod(there[n], F.lit(size)).alias(n) for n, size in zip("xyz", sizes, strict=True)])
    keys = ["x", "y", "z"] + ([] if binary else ["v"])
    met = one.join(edge.select("x", "y", "z", "v", F.col("root").alias("b")), keys).filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dense_labels(roots: DataFrame, column: str = "root") -> DataFrame:
    """(root, label): 1, 2, ... in the order of the distinct roots.

    Roots are dealt by range; the sizes of the parts, one number each, give every part its first label.
    """
    ranged = roots.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "roots")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the shuffle
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_part").orderBy(column)
    return ranged.join(small(written(offsets, "offsets")), "_part").select(column, (F.col("_from") + F.row_number().over(inside)).cast("long").alias("label"))


def cell_labels(
    df: DataFrame, grid: Grid, connectivity: int = 26, delta: float = 0, periodic: bool = False, binary: bool = False, column: str = "v", keep: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Foreground cells (x, y, z, v, root), and (root, label) of all roots, as written tables. With keep, cells have their
    value as _value too, which v isn't in binary mode."""
    check_connectivity(connectivity, grid, periodic, delta)
    binary = binary or dict(df.dtypes)[column] == "boolean"
    cells = foreground(df.withColumn("_value", F.col(column)), binary, column, ("_value",) if keep else ())
    back = [o for o in offsets(connectivity, grid.ndim) if sum(d * s for d, s in zip(o, _order(grid), strict=True)) < 0]
    wrapped = (lambda rooted: _across_borders(rooted, grid, connectivity, binary)) if periodic else None
    cells, rooted = components(cells, grid, back, matching(0 if binary else delta, binary), wrapped)
    return cells, written(rooted.join(dense_labels(rooted, "first"), "first").select("root", "label"), "labels")


def _order(grid: Grid) -> tuple[int, int, int]:
    """Weights that put offsets by memory order."""
    return (1, 3, 9) if grid.order == "F" else (9, 3, 1)


def connected_components(
    df: DataFrame, grid: Grid, connectivity: int = 26, delta: float = 0, periodic_boundary: bool = False, binary_image: bool = False,
    return_N: bool = False, out_dtype: str | None = None, max_labels: int | None = None, column: str = "v",
) -> DataFrame | tuple[DataFrame, int]:
    """(x, y, z, label) of the foreground; labels count up from 1 by each component's first cell in memory order.

    Cells with 0 or null are background and get no row. Neighbours join if their values are equal; with delta, if
    they differ by delta at most; in binary mode, always. A NaN is a component of its own unless binary. Cells are
    labelled within blocks, which are joined at their seams. Cells off the grid get no row; of rows with equal
    coordinates each gets the label of one of them. max_labels is accepted and not needed; out_dtype is checked against
    the number of labels.
    """
    if out_dtype is not None and out_dtype not in _OUT:
        raise ValueError(f"out_dtype must be one of {sorted(_OUT)}: {out_dtype}")
    cells, labels = cell_labels(df, grid, connectivity, delta, periodic_boundary, binary_image, column)
    out = cells.join(small(labels, BROADCAST_LABELS), "root").select("x", "y", "z", "label")
    if not return_N and out_dtype is None:
        return out
    n = component_count(labels)
    if out_dtype is not None and n > _OUT[out_dtype]:
        raise ValueError(f"{out_dtype} can't hold {n} labels")
    return (out, n) if return_N else out


def component_count(labels: DataFrame) -> int:
    """The largest label, 0 if there is none."""
    return labels.agg(F.coalesce(F.max("label"), F.lit(0)).alias("n")).first().n


def connected_components_stack(slabs, grid: Grid, connectivity: int = 26, binary_image: bool = False, return_N: bool = False, column: str = "v"):
    """Labels of a volume that comes as slabs in z order: an iterable of (DataFrame with z from 0, depth).

    The slabs are joined by their z offsets and labelled as one volume, so that seams need no second step. An empty
    iterable gives an empty result. grid.sz counts for nothing; the depths add up to it.
    """
    whole, depth = None, 0
    for df, size in slabs:
        shifted = df.select("x", "y", (F.col("z") + F.lit(depth)).cast("int").alias("z"), column)
        whole = shifted if whole is None else whole.unionByName(shifted)
        depth += size
    if whole is None:
        return (None, 0) if return_N else None
    full = Grid(grid.sx, grid.sy, max(depth, 1), 3, grid.order)
    return connected_components(whole, full, connectivity, binary_image=binary_image, return_N=return_N, column=column)

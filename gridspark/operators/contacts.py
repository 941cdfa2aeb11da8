"""Contacts between labelled regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import halo
from gridspark.operators.grid import Grid, foreground
from gridspark.operators.neighborhood import check_connectivity, half_offsets


def _pairs(labels: DataFrame, grid: Grid, connectivity: int, weights: tuple[float, ...], column: str) -> DataFrame:
    """(label_1, label_2, face, n): how many neighbouring cells with these labels, none of them 0, share a face of that
    area; rows are sums over a block of cells each."""
    check_connectivity(connectivity, grid)
    wx, wy, wz = (*weights, 1.0, 1.0, 1.0)[:3]
    cells = foreground(labels, column=column).select("x", "y", "z", F.col("v").cast("long").alias("label"))
    steps, blocks = half_offsets(connectivity, grid.ndim), halo.blocks_of(grid)

    def area(o: tuple[int, int, int]) -> float:
        if sum(map(abs, o)) > 1:
            return 0.0
        if grid.ndim < 3:
            return float(wy if o[0] else wx)
        return float(wy * wz if o[0] else wx * wz if o[1] else wx * wy)

    areas = [area(o) for o in steps]

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        label, out = rows.column("label").to_numpy(), []
        for k, i, j in blocks.meetings(rows, key[0].as_py(), steps):
            other = label[i] != label[j]
            one, two, n = halo.distinct_pairs(label[i][other], label[j][other])
            out.append(pa.table({"label_1": one, "label_2": two, "face": np.full(len(n), areas[k]), "n": n}))
        return pa.concat_tables(out)

    schema = "label_1 long, label_2 long, face double, n long"
    return blocks.spread(cells).groupBy("_block").applyInArrow(meet, schema)


def contacts(labels: DataFrame, grid: Grid, connectivity: int = 26, surface_area: bool = True, anisotropy: tuple[float, ...] = (1, 1, 1), column: str = "label") -> DataFrame:
    """(label_1, label_2, value), label_1 < label_2: shared area of each pair of regions, or number of neighbouring
    cells. Pairs that touch only across edges or corners have area 0 and stay. Each adjacency counts once."""
    value = F.sum(F.col("face") * F.col("n")) if surface_area else F.sum("n").cast("double")
    return _pairs(labels, grid, connectivity, tuple(anisotropy), column).groupBy("label_1", "label_2").agg(value.alias("value"))


def region_graph(labels: DataFrame, grid: Grid, connectivity: int = 26, column: str = "label") -> DataFrame:
    """The pairs of touching regions."""
    return _pairs(labels, grid, connectivity, (1, 1, 1), column).select("label_1", "label_2").distinct()

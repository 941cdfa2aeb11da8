"""Connectivity bit fields of cells, and their components."""

from __future__ import annotations

from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.operators import halo
from gridspark.operators.grid import Grid
from gridspark.operators.label import component_count, dense_labels
from gridspark.operators.neighborhood import BITS_2D, BITS_3D, check_connectivity, offsets
from gridspark.operators.seams import BROADCAST_LABELS, components
from gridspark.plans.scratch import small, written


def _encoding(connectivity: int, grid: Grid) -> list[tuple[int, int, int]]:
    return BITS_2D if connectivity in (4, 8) and grid.ndim < 3 else BITS_3D


def voxel_connectivity_graph(df: DataFrame, grid: Grid, connectivity: int = 26, column: str = "v") -> DataFrame:
    """(x, y, z, bits) of every cell: a bit for each direction that leads to a cell of the same value or off the grid.

    Connectivity 4 and 8 use the bit order of two dimensions, the others that of three; bits beyond the connectivity
    are 0. Background matches background, so that cells without a row count as 0.
    """
    check_connectivity(connectivity, grid)
    if not isinstance(df.schema[column].dataType, (T.IntegralType, T.BooleanType)):
        raise TypeError("only whole numbers and booleans are supported")
    reach = set(offsets(connectivity, 2 if connectivity in (4, 8) else 3))
    bits = {o: 1 << i for i, o in enumerate(_encoding(connectivity, grid)) if o in reach}
    steps, full = list(bits), reduce(int.__or__, bits.values())
    value = F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")).alias("v")
    blocks = halo.blocks_of(grid)
    side, sizes = blocks.side, blocks.size
    cells = blocks.spread(df.select("x", "y", "z", value).filter("v <> 0"))
    nothing = [F.lit(None).cast(cells.schema[n].dataType).alias(n) for n in ("x", "y", "z", "v")]
    empty = df.sparkSession.range(reduce(mul, blocks.counts)).select(*nothing, F.col("id").alias("_block"))  # blocks without cells too

    def field(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows.column("x")))
        first = blocks.corner(key[0].as_py())
        values = np.zeros([s + 2 for s in side], np.int64)
        at = [rows.column(n).to_numpy().astype(np.int64) - f + 1 for n, f in zip("xyz", first, strict=True)]
        values[tuple(at)] = rows.column("v").to_numpy()
        size = [int(min(s, n - f)) for s, n, f in zip(side, sizes, first, strict=True)]
        place = np.indices(size)
        here = values[tuple(slice(1, n + 1) for n in size)]
        clear = np.zeros(size, np.int64)
        for step in steps:
            there = values[tuple(slice(1 + d, n + 1 + d) for d, n in zip(step, size, strict=True))]
            inside = np.ones(size, bool)
            for d, p, f, n in zip(step, place, first, sizes, strict=True):
                inside &= (p + f + d >= 0) & (p + f + d < n)
            clear |= np.where(inside & (here != there), bits[step], 0)
        out = {n: (p + f).ravel().astype(np.int32) for n, p, f in zip("xyz", place, first, strict=True)}
        return pa.table(out | {"bits": (full - clear).ravel().astype(np.int32)})

    return cells.unionByName(empty).groupBy("_block").applyInArrow(field, "x int, y int, z int, bits int")


def color_connectivity_graph(graph: DataFrame, grid: Grid, connectivity: int = 26, return_N: bool = False, wide: bool | None = None, column: str = "bits"):
    """(x, y, z, label) of every cell: components of the cells along passable directions back in x, y and z.

    Only backward bits are read. In two dimensions connectivity 4 and 8 take the bit order of two dimensions unless
    `wide` says that the field has that of three, as 6 and 26 do.
    """
    if connectivity not in ((4, 8, 6, 26) if grid.ndim < 3 else (6, 26)):
        raise ValueError(f"connectivity {connectivity} is not supported for rank {grid.ndim}")
    wide = grid.ndim == 3 or connectivity in (6, 26) if wide is None else wide
    order = BITS_3D if wide else BITS_2D
    reach = set(offsets(connectivity, 2 if connectivity in (4, 8) or grid.sz == 1 else 3))
    back = [(o, i) for i, o in enumerate(order) if o in reach and o[::-1] < (0, 0, 0)]
    cells = graph.select("x", "y", "z", F.col(column).cast("int").alias("_bits"))
    passable = np.array([1 << i for _, i in back], np.int64)

    def passes(rows: pa.Table, n: int, i: np.ndarray, _: np.ndarray) -> np.ndarray:
        return (rows.column("_bits").to_numpy()[i].astype(np.int64) & passable[n]) != 0

    cells, rooted = components(cells, grid, [o for o, _ in back], passes)
    labels = written(rooted.join(dense_labels(rooted, "first"), "first").select("root", "label"), "labels")
    out = cells.join(small(labels, BROADCAST_LABELS), "root").select("x", "y", "z", "label")
    return (out, component_count(labels)) if return_N else out


def estimate_graph_labels(graph: DataFrame, grid: Grid, column: str = "bits") -> DataFrame:
    """One row: epl, an upper bound of the components of a field: rows of cells plus places in a row that can't be
    passed backwards."""
    blocked = F.count_if((F.col("x") > 0) & (F.getbit(column, F.lit(1)) == 0))
    return graph.agg((F.lit(grid.sy * grid.sz).cast("long") + blocked).alias("epl"))

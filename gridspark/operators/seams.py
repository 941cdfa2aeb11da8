"""Components of cells: found within blocks, joined at the seams between them.

Every block is one group: its cells are put in memory order, stretches of joined cells along the fastest axis become
nodes, and nodes that meet one step away are united, all by NumPy. A cell's root is the first cell, in memory order, of
its component in the block. Only cells at the faces of blocks travel again, to meet those of the blocks beside theirs;
edges between roots are left, whose number follows the surfaces, and components of these are found by contraction.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators import halo
from gridspark.operators.grid import Grid
from gridspark.plans.components import connected_components, smallest_reached
from gridspark.plans.scratch import written

#: Sides of a block for ranks 1 to 3: 2 ** 18 cells at most in a group.
SIDES = {1: (1 << 18, 1, 1), 2: (512, 512, 1), 3: (64, 64, 64)}

#: Rows of (root, label), 16 bytes each, that are broadcast to the cells, at most; a larger table is joined by a shuffle, in
#: which a root has the cells of one block at most.
BROADCAST_LABELS = 500_000

#: joined(rows, n, i, j) says for pairs of rows, j being step n away from i, whether they belong together.
Joined = Callable[[pa.Table, int, np.ndarray, np.ndarray], np.ndarray]


def label_blocks(grid: Grid) -> halo.Blocks:
    return halo.Blocks(grid, SIDES[3 if grid.sz > 1 else 2 if grid.sy > 1 else 1])


def _on_face(blocks: halo.Blocks) -> Column:
    """Whether a cell lies at a face that another block touches."""
    sides = [(F.pmod(F.col(n), F.lit(s)) == 0) & (F.col(n) > 0) | (F.pmod(F.col(n), F.lit(s)) == s - 1) & (F.col(n) < size - 1) for n, s, size in zip("xyz", blocks.side, blocks.size, strict=True)]
    return reduce(or_, sides)


def block_roots(cells: DataFrame, grid: Grid, steps: list[halo.Step], joined: Joined) -> DataFrame:
    """cells with root, the linear index of the first cell of their component within the block. The steps lead back in
    memory order. Cells off the grid are left out."""
    blocks = label_blocks(grid)
    fast = (-1, 0, 0) if grid.order == "F" else (0, 0, -1)

    def roots(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop(["_block"])
        at = np.stack([rows.column(n).to_numpy() for n in "xyz"], 1).astype(np.int64)
        lin = at @ np.array(grid.strides)
        order = np.argsort(lin, kind="stable")
        rows, at, lin = rows.take(pa.array(order)), at[order] - blocks.corner(key[0].as_py()), lin[order]
        extent = at.max(axis=0) + 3  # a margin on both sides, so that no step meets the next row
        places = np.array([1, extent[0], extent[0] * extent[1]] if grid.order == "F" else [extent[1] * extent[2], extent[2], 1])
        place = (at + 1) @ places
        row_at = np.full(int(np.prod(extent)), -1, np.int32)
        row_at[place] = np.arange(len(place), dtype=np.int32)
        rest = np.arange(len(place))
        begins = np.append(True, place[1:] != place[:-1])  # repeated cells go together
        if fast in steps:
            on = np.flatnonzero(np.append(False, place[1:] == place[:-1] + 1))
            begins[on[joined(rows, steps.index(fast), on, on - 1)]] = False
        run = np.cumsum(begins) - 1
        a, b = [], []
        for n, step in enumerate(steps):
            if step == fast:
                continue
            met = row_at[place + int(np.dot(step, places))]
            i = rest[met >= 0]
            j = met[i]
            new = run[i] != run[j]
            i, j = i[new], j[new]
            good = joined(rows, n, i, j)
            one, other = run[i[good]], run[j[good]]
            fresh = np.append(True, (one[1:] != one[:-1]) | (other[1:] != other[:-1]))[: len(one)]
            a.append(one[fresh])
            b.append(other[fresh])
        top = smallest_reached(int(run[-1]) + 1, np.concatenate(a), np.concatenate(b)) if a else np.arange(int(run[-1]) + 1)
        return rows.append_column("root", pa.array(lin[np.flatnonzero(begins)[top[run]]]))

    inside = reduce(lambda x, y: x & y, [F.col(n).between(0, size - 1) for n, size in zip("xyz", blocks.size, strict=True)])
    schema = cells.select("*", F.lit(0).cast("long").alias("root")).schema
    return cells.filter(inside).withColumn("_block", blocks.number()).groupBy("_block").applyInArrow(roots, schema)


def components(cells: DataFrame, grid: Grid, steps: list[halo.Step], joined: Joined, wrapped: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """cells with root, and (root, first) of all roots: first is the linear index of the component's first cell; both as
    written tables. wrapped(cells) gives further edges (a, b) between roots, as across the borders of the grid."""
    cells = written(block_roots(cells, grid, steps, joined), "cells")
    blocks = label_blocks(grid)
    edges = None
    if max(blocks.counts) > 1:
        edges = halo.edges(cells.filter(_on_face(blocks)), grid, steps, "root", joined, blocks)
    if wrapped is not None:
        edges = wrapped(cells) if edges is None else edges.unionByName(wrapped(cells))
    roots = cells.select("root").distinct()
    edges = None if edges is None else written(edges, "edges")
    if edges is None or edges.isEmpty():
        return cells, written(roots.withColumn("first", F.col("root")), "rooted")
    found = connected_components(edges, written).select(F.col("node").alias("root"), F.col("label").alias("first"))
    return cells, written(roots.join(found, "root", "left").select("root", F.coalesce("first", "root").alias("first")), "rooted")

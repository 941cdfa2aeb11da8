"""Blocks of cells with a margin of one cell, so that every neighbour of a block's own cells is at hand in one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid

#: Sides of a block along x, y, z for ranks 1 to 3; a group holds at most the cells of a block and its margin.
SIDES = {1: (65536, 1, 1), 2: (256, 256, 1), 3: (32, 32, 32)}

Step = tuple[int, int, int]


@dataclass(frozen=True)
class Blocks:
    """The blocks of a grid; goes to the workers along with the functions that compare cells."""

    grid: Grid
    side: tuple[int, int, int]

    @property
    def size(self) -> tuple[int, int, int]:
        return self.grid.sx, self.grid.sy, self.grid.sz

    @property
    def counts(self) -> tuple[int, int, int]:
        """Number of blocks along each axis."""
        return tuple(-(-n // s) for n, s in zip(self.size, self.side, strict=True))

    def spread(self, cells: DataFrame) -> DataFrame:
        """cells with _block, the number of a block that holds the cell or has it in its margin: one row for each, that is
        one for most cells and eight at most. Cells off the grid get none."""
        out = cells
        for n, side, size, blocks in zip("xyz", self.side, self.size, self.counts, strict=True):
            low, high = F.floor((F.col(n) - 1) / side), F.floor((F.col(n) + 1) / side)
            reached = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(blocks - 1)))
            out = out.filter(F.col(n).between(0, size - 1)).withColumn(f"_b{n}", F.explode(reached))
        nx, ny, _ = self.counts
        return out.withColumn("_block", F.col("_bx") + nx * (F.col("_by") + ny * F.col("_bz"))).drop("_bx", "_by", "_bz")

    def number(self) -> Column:
        """The number of the block that holds a cell."""
        bx, by, bz = (F.floor(F.col(n) / side) for n, side in zip("xyz", self.side, strict=True))
        nx, ny, _ = self.counts
        return bx + nx * (by + ny * bz)

    def corner(self, block: int) -> np.ndarray:
        """x, y, z of the first cell of a block."""
        nx, ny, _ = self.counts
        return np.array([block % nx, block // nx % ny, block // (nx * ny)]) * self.side

    def meetings(self, rows: pa.Table, block: int, steps: list[Step]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the step, i, j) for each step: j are the rows one step away from the block's own rows i."""
        side = np.array(self.side)
        at = np.stack([rows.column(n).to_numpy() for n in "xyz"], 1).astype(np.int64) - self.corner(block) + 1
        strides = np.array([1, side[0] + 2, (side[0] + 2) * (side[1] + 2)])
        place = at @ strides
        row_at = np.full(int(np.prod(side + 2)), -1, np.int32)
        row_at[place] = np.arange(len(place), dtype=np.int32)
        own = np.flatnonzero(((at >= 1) & (at <= side)).all(1))
        for n, step in enumerate(steps):
            met = row_at[place[own] + int(np.dot(step, strides))]
            found = met >= 0
            yield n, own[found], met[found]


def blocks_of(grid: Grid) -> Blocks:
    """The blocks of a grid, by the axes along which it has more than one cell."""
    return Blocks(grid, SIDES[3 if grid.sz > 1 else 2 if grid.sy > 1 else 1])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (smaller, larger), and how often each occurs."""
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    found, n = np.unique(pairs, axis=0, return_counts=True)
    return found[:, 0], found[:, 1], n


def edges(cells: DataFrame, grid: Grid, steps: list[Step], node: str, joined: Callable[..., np.ndarray], blocks: Blocks | None = None) -> DataFrame:
    """Distinct (a, b) of the nodes of cells that are one of the steps apart and that joined(rows, n, i, j), a boolean for
    each pair of rows of step n, lets meet; no node meets itself."""
    blocks = blocks or blocks_of(grid)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        nodes = rows.column(node).to_numpy()
        found = [np.empty((0, 2), np.int64)]
        for n, i, j in blocks.meetings(rows, key[0].as_py(), steps):
            kept = (nodes[i] != nodes[j]) & joined(rows, n, i, j)
            found.append(np.stack([nodes[i[kept]], nodes[j[kept]]], 1))
        a, b, _ = distinct_pairs(*np.concatenate(found).T)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.spread(cells).groupBy("_block").applyInArrow(compare, "a long, b long").distinct()

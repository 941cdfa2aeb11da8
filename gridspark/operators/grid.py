"""Grids as relations: cells (x, y, z, v) with the size of each axis beside them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DimensionError(ValueError):
    """The rank of the data isn't 1, 2 or 3."""


@dataclass(frozen=True)
class Grid:
    """Sizes along x, y, z (the array's axes 0, 1, 2), the rank, and the memory order that numbers the cells."""

    sx: int
    sy: int = 1
    sz: int = 1
    ndim: int = 3
    order: str = "F"

    def __post_init__(self) -> None:
        if self.ndim not in (1, 2, 3):
            raise DimensionError(f"only ranks 1 to 3 are supported: {self.ndim}")
        if self.order not in ("C", "F"):
            raise ValueError(f"order must be C or F: {self.order}")

    @property
    def cells(self) -> int:
        return self.sx * self.sy * self.sz

    @property
    def strides(self) -> tuple[int, int, int]:
        """Steps of the linear index along x, y, z."""
        if self.order == "F":
            return 1, self.sx, self.sx * self.sy
        return self.sy * self.sz, self.sz, 1

    def lin(self, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
        """Linear index of a cell, the fastest axis of the memory order first."""
        at = [F.col(c) if isinstance(c, str) else c for c in (x, y, z)]
        return sum((c.cast("long") * s for c, s in zip(at[1:], self.strides[1:], strict=True)), at[0].cast("long") * self.strides[0])

    def coordinates(self, lin: Column) -> dict[str, Column]:
        """x, y, z of a linear index."""
        sizes = (self.sx, self.sy, self.sz)
        return {n: F.pmod(F.floor(lin / F.lit(s)), F.lit(size)).cast("int") for n, s, size in zip("xyz", self.strides, sizes, strict=True)}


def all_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell (x, y, z) of the grid, in parallel from its linear index."""
    ids = spark.range(grid.cells)
    return ids.select(*[c.alias(n) for n, c in grid.coordinates(F.col("id")).items()])


def densify(df: DataFrame, grid: Grid, column: str = "v", fill: object = 0) -> DataFrame:
    """Every cell of the grid with df's value, or fill where df has none."""
    kind = df.schema[column].dataType
    joined = all_cells(df.sparkSession, grid).join(df.select("x", "y", "z", column), ["x", "y", "z"], "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(fill).cast(kind)))


def foreground(df: DataFrame, binary: bool = False, column: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells with a value other than 0 and null; in binary mode, or for booleans, with the value 1. The columns keep stay."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        binary, df = True, df.withColumn(column, F.col(column).cast("int"))
    elif not isinstance(kind, (T.NumericType,)):
        raise TypeError(f"type {kind.simpleString()} is not supported")
    out = df.select("x", "y", "z", F.col(column).alias("v"), *keep).filter(F.col("v").isNotNull() & (F.col("v") != 0))
    return out.withColumn("v", F.lit(1)) if binary else out


def is_float(df: DataFrame, column: str = "v") -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))


def from_numpy(spark: SparkSession, array: np.ndarray, order: str | None = None, background: bool = False) -> tuple[DataFrame, Grid]:
    """Cells of a small array, and its grid; the order is the array's own unless given. For tests and examples."""
    if array.ndim not in (1, 2, 3):
        raise DimensionError(f"only ranks 1 to 3 are supported: {array.ndim}")
    order = order or ("F" if array.flags.f_contiguous and not array.flags.c_contiguous else "C")
    full = array.reshape(array.shape + (1,) * (3 - array.ndim))
    grid = Grid(*full.shape, ndim=array.ndim, order=order)
    kinds = {"b": "boolean", "i": "long", "u": "long", "f": "float" if array.dtype.itemsize <= 4 else "double"}
    if array.dtype.kind not in kinds:
        raise TypeError(f"type {array.dtype} is not supported")
    if array.dtype == np.uint64:
        kinds["u"] = "decimal(20,0)"
    at = np.argwhere(np.ones(full.shape, bool) if background else full != 0)
    values = full[tuple(at.T)]
    convert = int if array.dtype == np.uint64 else lambda v: v.item()
    if array.dtype == np.uint64:
        from decimal import Decimal

        convert = lambda v: Decimal(int(v))
    rows = [(*map(int, p), convert(v)) for p, v in zip(at, values, strict=True)]
    return spark.createDataFrame(rows, f"x int, y int, z int, v {kinds[array.dtype.kind]}"), grid


def to_numpy(df: DataFrame, grid: Grid, column: str = "label", dtype=np.int64) -> np.ndarray:
    """The grid as a dense array; cells without a row are 0. For tests and small results only."""
    out = np.zeros((grid.sx, grid.sy, grid.sz), dtype)
    got = df.select("x", "y", "z", column).toPandas()
    out[got["x"], got["y"], got["z"]] = got[column]
    return out.reshape(out.shape[: grid.ndim])

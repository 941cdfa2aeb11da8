"""Runs: maximal stretches of one value along x, and along the flattened grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid, foreground, is_float
from gridspark.plans.scratch import written


#: Cells along x, and of the flattened grid, that one task puts in order; runs that go on are joined afterwards.
ROW_STRETCH, FLAT_STRETCH = 1 << 18, 1 << 20
#: Cells of the flattened grid that are drawn or erased together.
DRAWN = 1 << 16


def _apart(cells: DataFrame, one: Column, other: Column, delta: float) -> Column:
    """Whether two values belong to different runs."""
    differs = F.abs(one - other) > F.lit(delta) if delta else one != other
    return differs | F.isnan(one) | F.isnan(other) if is_float(cells) else differs


def cell_runs(cells: DataFrame, grid: Grid, delta: float = 0) -> DataFrame:
    """Foreground cells (x, y, z, v) with run, the linear index of the first cell of their run along x.

    Neighbours in a row share a run if their values are equal, or differ by delta at most. NaN is never equal. Rows
    longer than ROW_STRETCH are put in order by stretches.
    """
    long = grid.sx > ROW_STRETCH
    keys = ["y", "z", "_k"] if long else ["y", "z"]
    if long:
        cells = cells.withColumn("_k", F.floor(F.col("x") / ROW_STRETCH))
    row = Window.partitionBy(*keys).orderBy("x")
    gap = (F.col("x") - F.lag("x").over(row)) != 1
    starts = F.coalesce(gap | _apart(cells, F.col("v"), F.lag("v").over(row), delta), F.lit(True))
    first = F.last("_at", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    marked = cells.withColumn("_at", F.when(starts, F.col("x"))).withColumn("_first", first).drop("_at")
    if long:
        marked = written(marked, "stretches")
        heads = marked.filter(F.col("x") == F.col("_k") * ROW_STRETCH).select(*keys, F.col("v").alias("_head"))
        tails = marked.filter(F.col("x") == (F.col("_k") + 1) * ROW_STRETCH - 1).select("y", "z", (F.col("_k") + 1).alias("_k"), F.col("v").alias("_tail"), F.col("_first").alias("_from"))
        met = heads.join(tails, keys).filter(~_apart(cells, F.col("_head"), F.col("_tail"), delta))
        # a run that fills the stretch before goes on from where that one began; two rows for each stretch at most
        order = Window.partitionBy("y", "z").orderBy("_k")
        goes_on = (F.lag("_k").over(order) == F.col("_k") - 1) & (F.col("_from") == (F.col("_k") - 1) * ROW_STRETCH)
        begun = met.withColumn("_begun", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("_from")))
        begun = begun.select(*keys, F.last("_begun", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_begun"))
        marked = marked.join(begun, keys, "left").withColumn("_first", F.when(F.col("_first") == F.col("_k") * ROW_STRETCH, F.coalesce("_begun", "_first")).otherwise(F.col("_first"))).drop("_begun", "_k")
    return marked.withColumn("run", grid.lin(F.col("_first"))).drop("_first")


def x_runs(cells: DataFrame, grid: Grid) -> DataFrame:
    """One row per run of equal values: run, v, y, z, x1, x2 (inclusive)."""
    return cell_runs(cells, grid).groupBy("run", "y", "z").agg(F.first("v").alias("v"), F.min("x").alias("x1"), F.max("x").alias("x2"))


def flat_runs(labels: DataFrame, grid: Grid, column: str = "label") -> DataFrame:
    """(label, start, end): half-open runs of each label over the flattened grid, across row ends; no label 0.

    Islands are found within label and block of the flattened index, then joined where blocks meet, so that no task
    sorts all cells of one label.
    """
    block = FLAT_STRETCH
    cells = labels.filter(F.col(column).isNotNull() & (F.col(column) != 0)).select(F.col(column).cast("long").alias("label"), grid.lin().alias("lin"))
    inside = Window.partitionBy("label", F.floor(F.col("lin") / block)).orderBy("lin")
    parts = cells.withColumn("_island", F.col("lin") - F.row_number().over(inside)).groupBy("label", F.floor(F.col("lin") / block).alias("_block"), "_island").agg(F.min("lin").alias("start"), (F.max("lin") + 1).alias("end"))
    # only parts that touch a block's border, two for each label and block at most, can go on in another
    touches = (F.col("start") % block == 0) | (F.col("end") % block == 0)
    order = Window.partitionBy("label").orderBy("start")
    fresh = F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True))
    chained = parts.filter(touches).withColumn("_run", F.sum(F.when(fresh, 1).otherwise(0)).over(order))
    chained = chained.groupBy("label", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    return parts.filter(~touches).select("label", "start", "end").unionByName(chained)


def run_pieces(runs: DataFrame, grid: Grid) -> DataFrame:
    """(label, start, end, stretch): runs cut at multiples of DRAWN, a row for each stretch that they touch. Cut by coarser
    stretches first, so that no row holds a long array, and dealt anew. Runs outside the grid are refused."""
    bad = runs.filter((F.col("start") < 0) | (F.col("end") > grid.cells) | (F.col("start") > F.col("end")))
    if not bad.isEmpty():
        raise ValueError("a run leaves the grid or ends before it starts")
    pieces = runs.select(F.col("label").cast("long").alias("label"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start < end")
    for size in (DRAWN**3, DRAWN**2, DRAWN):
        stretch = F.explode(F.sequence(F.floor(F.col("start") / F.lit(size)), F.floor((F.col("end") - 1) / F.lit(size)))).alias("stretch")
        cut = pieces.select("label", "start", "end", stretch)
        low, high = F.greatest("start", F.col("stretch") * F.lit(size)), F.least("end", (F.col("stretch") + 1) * F.lit(size))
        pieces = cut.select("label", low.alias("start"), high.alias("end"), "stretch")
    return pieces


def _filled(pieces: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Which cells of a stretch lie on a run, and the largest label on each."""
    on, label = np.zeros(DRAWN, bool), np.zeros(DRAWN, np.int64)
    pieces = pieces.sort_by("label")
    for name, start, end in zip(*(pieces.column(n).to_numpy() for n in ("label", "start", "end")), strict=True):
        on[start - first : end - first] = True
        label[start - first : end - first] = name
    return on, label


def draw(runs: DataFrame, grid: Grid, image: DataFrame | None = None, value: object = None, column: str = "label") -> DataFrame:
    """Cells (x, y, z, column) along runs: the run's label, or value; other cells of image keep theirs.

    Where runs overlap the largest label is drawn. Drawing 0 erases: those cells have no row in the result. Runs outside
    the grid are refused. Runs and the cells of image meet by stretches of DRAWN cells of the flattened grid, each filled
    on its own, so that a run of any length is drawn in parallel.
    """
    pieces = run_pieces(runs, grid).distinct()
    kept = F.col("label") if value is None else F.lit(value)

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first = key[0].as_py() * DRAWN
        on, label = _filled(rows, first)
        at = np.flatnonzero(on)
        return pa.table({"_lin": at + first, "label": label[at]})

    drawn = pieces.groupBy("stretch").applyInArrow(fill, "_lin long, label long")
    drawn = drawn.select(*[c.alias(n) for n, c in grid.coordinates(F.col("_lin")).items()], kept.alias(column))
    if image is not None:
        drawn = _off_runs(pieces, grid, image.select("x", "y", "z", column)).unionByName(drawn)
    return drawn.filter(F.col(column) != 0)


def _off_runs(pieces: DataFrame, grid: Grid, image: DataFrame) -> DataFrame:
    """The cells of image that no piece of a run covers."""

    def keep(key: tuple[pa.Scalar, ...], cells: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return cells.drop(["_lin", "stretch"])
        first = key[0].as_py() * DRAWN
        on, _ = _filled(rows, first)
        return cells.filter(pa.array(~on[cells.column("_lin").to_numpy() - first])).drop(["_lin", "stretch"])

    cells = image.withColumn("_lin", grid.lin()).withColumn("stretch", F.floor(F.col("_lin") / F.lit(DRAWN)))
    return cells.groupBy("stretch").cogroup(pieces.groupBy("stretch")).applyInArrow(keep, image.schema)


def erase(runs: DataFrame, grid: Grid, image: DataFrame, column: str = "label") -> DataFrame:
    """image without the cells along runs, which are never laid out as cells themselves."""
    return _off_runs(run_pieces(runs, grid).distinct(), grid, image.select("x", "y", "z", column)).filter(F.col(column) != 0)


def row_bounds(df: DataFrame, column: str = "v") -> DataFrame:
    """(y, z, start, end): half-open span of the foreground of each row that has any."""
    cells = foreground(df, column=column)
    return cells.groupBy("y", "z").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))


def estimate_provisional_labels(df: DataFrame, grid: Grid, column: str = "v") -> DataFrame:
    """One row: epl (x-runs of equal foreground values), first_row and last_row (y + sy * z; -1 if all is empty)."""
    per_row = cell_runs(foreground(df, column=column), grid).groupBy("y", "z").agg(F.countDistinct("run").alias("n"))
    at: Column = F.col("y").cast("long") + F.col("z").cast("long") * grid.sy
    none = F.lit(-1).cast("long")
    return per_row.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("epl"), F.coalesce(F.min(at), none).alias("first_row"), F.coalesce(F.max(at), none).alias("last_row"))

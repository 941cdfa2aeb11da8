"""Grids made from the driver's tables, over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid

LINEITEM_GRID = Grid(16, 10, 84, 3, "F")
EVENT_GRID = Grid(720, 64, 1, 2, "F")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_grid(spark: SparkSession, sf_dir: str, values: int = 5) -> tuple[DataFrame, Grid]:
    """Part by supplier by month of shipping; the value is 1 + the summed quantity modulo `values`."""
    x, y = (F.col("l_partkey") % 16).cast("int"), (F.col("l_suppkey") % 10).cast("int")
    z = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), z.alias("z"), "l_quantity")
    cells = rows.groupBy("x", "y", "z").agg((F.sum("l_quantity").cast("long") % values + 1).cast("int").alias("v"))
    return cells, LINEITEM_GRID


def event_grid(spark: SparkSession, sf_dir: str, values: int = 3) -> tuple[DataFrame, Grid]:
    """Hour by user; the value is 1 + the number of events modulo `values`."""
    x = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")) % 720
    rows = table(spark, sf_dir, "events").select(x.cast("int").alias("x"), (F.col("user_id") % 64).cast("int").alias("y"))
    cells = rows.groupBy("x", "y").agg((F.count(F.lit(1)) % values + 1).cast("int").alias("v"))
    return cells.select("x", "y", F.lit(0).alias("z"), "v"), EVENT_GRID


def embedding_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Position by vector; the value is the embedding's number there."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    cells = rows.select("x", F.col("vec_id").cast("int").alias("y"), F.lit(0).alias("z"), F.col("v").cast("double").alias("v"))
    high = cells.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    return cells, Grid((high.x or 0) + 1, (high.y or 0) + 1, 1, 2, "F")

"""Written tables in the shared checkpoint folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small tables are broadcast up to this many rows; a larger one goes through Spark's usual join choice.
BROADCAST_ROWS = 20_000


_kept: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and Spark runs on this machine alone, as in tests, a
    folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="gridspark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/gridspark/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the scratch folder and reads it again."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(_clear_at_exit, spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the written tables of this application; call it when their results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if spark.sparkContext._jsc is not None:
            clear_scratch(spark)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows stay within the bound; df should be a written table."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(rows + 1).count() <= rows else df

"""Arrays in files as cells, cells as arrays in files, and label tables in blocks.

`rawgrid` reads .npy files and headerless arrays by ranges of planes along the slowest axis, in parallel, without
loading the file: spark.read.format("rawgrid").option("path", ...).load(). The path must be one that every executor
can open, such as a shared file system. read_array() takes paths with a scheme as well, which Hadoop opens.
"""

from __future__ import annotations

import contextlib
import io
import math
import os
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gridspark.operators.grid import DimensionError, Grid

#: Cells that a read task takes about.
CELLS = 4_000_000
KINDS = {"b": "boolean", "i": "long", "u": "long", "f": "double"}
#: Bytes of a record of a file that Hadoop deals out, at most.
RECORD = 4 << 20
#: Cells of the flattened array that are written at once.
STRETCH = 1 << 20


def _kind(dtype: np.dtype) -> str:
    """The Spark type of an array's values; only decimals hold unsigned numbers of 64 bits."""
    return "decimal(20,0)" if dtype == np.uint64 else KINDS[dtype.kind]


def _values(values: np.ndarray) -> pa.Array:
    if values.dtype == np.uint64:
        return pa.array(values).cast(pa.decimal128(20, 0))
    return pa.array(values.astype({"b": bool, "f": np.float64}.get(values.dtype.kind, np.int64)))


def open_array(options: dict) -> tuple[np.ndarray, str]:
    """The file as a memory map, and its order. Headerless files need the options dtype, shape ('a,b,c') and order."""
    path = options["path"]
    if path.endswith(".npy"):
        array = np.load(path, mmap_mode="r")
        order = "F" if array.flags.f_contiguous and not array.flags.c_contiguous else "C"
    else:
        order = options.get("order", "F")
        array = np.memmap(path, np.dtype(options["dtype"]), "r", shape=tuple(map(int, options["shape"].split(","))), order=order)
    _check(array.dtype, array.ndim)
    return array, order


def _check(dtype: np.dtype, ndim: int) -> None:
    if ndim not in (1, 2, 3):
        raise DimensionError(f"only ranks 1 to 3 are supported: {ndim}")
    if dtype.kind not in KINDS:
        raise TypeError(f"type {dtype} is not supported")


class _Planes(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        array, order = open_array(self.options)
        axis = array.ndim - 1 if order == "F" else 0
        n = array.shape[axis]
        step = max(1, CELLS * n // max(array.size, 1))
        return [_Planes(a, min(a + step, n)) for a in range(0, n, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        array, order = open_array(self.options)
        axis = array.ndim - 1 if order == "F" else 0
        for p in range(partition.first, partition.last):
            plane = np.take(array, [p], axis=axis)
            at = np.argwhere(plane != 0).astype(np.int32)
            values = _values(plane[tuple(at.T)])
            at[:, axis] += p
            at = np.pad(at, ((0, 0), (0, 3 - array.ndim)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(at[:, i])) for i in range(3)] + [values], names=["x", "y", "z", "v"])


class _Written(WriterCommitMessage):
    """A task has written its stretches."""


class _Writer(DataSourceArrowWriter):
    """Writes rows (lin, stretch, v), which come sorted by stretch, into a file beside the final one. Every task writes its
    own stretches at their place, again the same if it is tried again; what no cell covers stays 0. The commit gives the
    file its length, header and name."""

    def __init__(self, options: dict):
        self.path, self.dtype, self.shape, self.order = options["path"], np.dtype(options["dtype"]), tuple(map(int, options["shape"].split(","))), options["order"]
        self.cells, self.stretch, self.made = int(np.prod(self.shape)), int(options["stretch"]), f"{self.path}.{options['token']}"
        self.header = self._header()

    def _header(self) -> bytes:
        if not self.path.endswith(".npy"):
            return b""
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": self.order == "F", "shape": self.shape})
        return out.getvalue()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        file = os.open(self.made, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            held, buffer = None, np.zeros(0, self.dtype)
            for batch in iterator:
                lin, stretch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                values = self._fitting(batch.column(2))
                if len(lin) and (lin.min() < 0 or lin.max() >= self.cells):
                    raise ValueError("a cell lies off the grid")
                starts = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1])) if len(lin) else []
                for a, b in zip(starts, [*starts[1:], len(lin)], strict=True):
                    if stretch[a] != held:
                        self._put(file, held, buffer)
                        held = int(stretch[a])
                        buffer = np.zeros(min(self.stretch, self.cells - held * self.stretch), self.dtype)
                    buffer[lin[a:b] - held * self.stretch] = values[a:b]
            self._put(file, held, buffer)
        finally:
            os.close(file)
        return _Written()

    def _put(self, file: int, stretch: int | None, buffer: np.ndarray) -> None:
        if stretch is None:
            return
        left, at = memoryview(buffer.tobytes()), len(self.header) + stretch * self.stretch * self.dtype.itemsize
        while left:
            n = os.pwrite(file, left, at)
            left, at = left[n:], at + n

    def _fitting(self, column: pa.Array) -> np.ndarray:
        if pa.types.is_decimal(column.type):
            return column.cast(pa.uint64() if self.dtype == np.uint64 else pa.int64()).to_numpy(zero_copy_only=False).astype(self.dtype)
        values = column.to_numpy(zero_copy_only=False)
        if self.dtype.kind in "iu" and len(values):
            bounds = np.iinfo(self.dtype)
            if int(values.min()) < bounds.min or int(values.max()) > bounds.max:
                raise ValueError(f"a value doesn't fit {self.dtype}")
        return values.astype(self.dtype)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with open(self.made, "r+b" if os.path.exists(self.made) else "w+b") as f:
            f.write(self.header)
            f.truncate(len(self.header) + self.cells * self.dtype.itemsize)
        os.replace(self.made, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.made)


class RawGrid(DataSource):
    """Foreground cells (x, y, z, v) of an array file; the sink of write_array()."""

    @classmethod
    def name(cls) -> str:
        return "rawgrid"

    def schema(self) -> str:
        array, _ = open_array(dict(self.options))
        return f"x int, y int, z int, v {_kind(array.dtype)}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _record_bytes(size: int, item: int) -> int:
    """The largest whole number of items, in bytes, that divides a file and isn't above RECORD."""
    items, best = size // item, 1
    for d in range(1, min(math.isqrt(items), RECORD // item) + 1):
        if items % d == 0:
            best = max(best, d, items // d if items // d <= RECORD // item else 1)
    return best * item


def _stored_array(spark: SparkSession, path: str, options: dict) -> tuple[int, int, np.dtype, tuple[int, ...], str]:
    """Length of the file, length of its header, type, shape and order, read through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getFileStatus(at).getLen()
    if not path.endswith(".npy"):
        return size, 0, np.dtype(options["dtype"]), tuple(map(int, options["shape"].split(","))), options.get("order", "F")
    stream = files.open(at)
    try:
        head = io.BytesIO(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, 4096))))
    finally:
        stream.close()
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    return size, head.tell(), dtype, shape, "F" if fortran else "C"


def read_stored_array(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, Grid]:
    """Cells of an array file that only Spark may be able to open, and its grid. Hadoop deals the file by ranges of bytes;
    records are whole items of RECORD bytes at most, of a length that divides the file."""
    size, header, dtype, shape, order = _stored_array(spark, path, options)
    _check(dtype, len(shape))
    grid = Grid(*shape, *(1,) * (3 - len(shape)), ndim=len(shape), order=order)
    if size - header != grid.cells * dtype.itemsize:
        raise ValueError(f"{path} has {size - header} bytes of data, not {grid.cells * dtype.itemsize}")
    schema = f"x int, y int, z int, v {_kind(dtype)}"
    if not grid.cells:
        return spark.createDataFrame([], schema), grid
    length = _record_bytes(size, dtype.itemsize)
    kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(length)})
    strides, sizes = grid.strides, (grid.sx, grid.sy, grid.sz)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                skipped = max(0, header - number * length)  # the header fills the first records or a part of one
                if skipped >= length:
                    continue
                values = np.frombuffer(data.as_buffer(), dtype, offset=skipped)
                at = np.flatnonzero(values)
                lin = at + (number * length + skipped - header) // dtype.itemsize
                places = [pa.array((lin // s % n).astype(np.int32)) for s, n in zip(strides, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([*places, _values(values[at])], names=["x", "y", "z", "v"])

    rows = spark.createDataFrame(records.map(lambda r: (r[0], bytes(r[1]))), "number long, data binary")
    return rows.mapInArrow(decode, schema), grid


def read_array(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, Grid]:
    """Cells of an array file and its grid; a path with a scheme is read through Spark's file systems."""
    if "://" in path:
        return read_stored_array(spark, path, **options)
    spark.dataSource.register(RawGrid)
    array, order = open_array({"path": path, **options})
    shape = array.shape + (1,) * (3 - array.ndim)
    return spark.read.format("rawgrid").options(path=path, **options).load(), Grid(*shape, ndim=array.ndim, order=order)


def write_array(cells: DataFrame, grid: Grid, path: str, dtype: str, column: str = "label") -> None:
    """Cells as one array file in the grid's memory order, .npy or headerless by the name's ending; an older file is
    replaced. Cells without a row, or null, are 0; of rows with equal coordinates one counts. A cell off the grid, or a value that the type
    can't hold, fails and leaves no file. The path must be one that the driver and every executor can open."""
    spark = cells.sparkSession
    spark.dataSource.register(RawGrid)
    sizes = zip("xyz", (grid.sx, grid.sy, grid.sz), strict=True)
    inside = reduce(and_, [F.col(n).between(0, size - 1) for n, size in sizes])
    lin = F.when(inside, grid.lin()).otherwise(F.lit(-1))
    rows = cells.filter(F.col(column).isNotNull()).select(lin.cast("long").alias("lin"), F.floor(lin / F.lit(STRETCH)).cast("long").alias("stretch"), F.col(column).alias("v"))
    shape = ",".join(map(str, (grid.sx, grid.sy, grid.sz)[: grid.ndim]))
    options = {"path": path, "dtype": dtype, "shape": shape, "order": grid.order, "stretch": str(STRETCH), "token": uuid.uuid4().hex}
    rows.repartition("stretch").sortWithinPartitions("stretch").write.format("rawgrid").options(**options).mode("overwrite").save()


def write_blocks(cells: DataFrame, path: str, planes: int = 64) -> None:
    """Cells as Parquet in one folder for each `planes` planes in z, so that a range of z reads only its folders."""
    cells.withColumn("z_block", F.floor(F.col("z") / planes)).write.partitionBy("z_block").option("compression", "zstd").mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, planes: int = 64) -> DataFrame:
    """Cells of write_blocks() with low <= z < high; only the folders that can hold them are read."""
    out = spark.read.parquet(path)
    if low is not None:
        out = out.filter((F.col("z_block") >= low // planes) & (F.col("z") >= low))
    if high is not None:
        out = out.filter((F.col("z_block") <= (high - 1) // planes) & (F.col("z") < high))
    return out.drop("z_block")

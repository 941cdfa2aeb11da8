import numpy as np
import pytest

from gridspark.operators.grid import DimensionError, Grid, all_cells, densify, from_numpy, to_numpy
from gridspark.operators.label import connected_components
from gridspark.sources import raw
from gridspark.streaming import slabs
from gridspark.streaming.slabs import SlabLabels
from tests import brute

RNG = np.random.default_rng(12)


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("shape", [(7, 5, 4), (7, 5), (9,)])
def test_npy_files(spark, tmp_path, order, shape):
    a = np.asarray(RNG.integers(0, 3, shape), order=order)
    np.save(tmp_path / "a.npy", a)
    df, grid = raw.read_array(spark, str(tmp_path / "a.npy"))
    assert (to_numpy(df, grid, "v") == a).all() and grid.ndim == len(shape)


def test_headerless_files_and_refusals(spark, tmp_path, monkeypatch):
    a = np.asfortranarray(RNG.random((4, 3, 5)) > 0.5)
    (tmp_path / "a.raw").write_bytes(a.tobytes(order="F"))
    monkeypatch.setattr(raw, "CELLS", 12)
    df, grid = raw.read_array(spark, str(tmp_path / "a.raw"), dtype="bool", shape="4,3,5", order="F")
    assert (to_numpy(df, grid, "v", bool) == a).all()
    assert (to_numpy(connected_components(df, grid, 26), grid) == brute.label(a, 26)).all()
    np.save(tmp_path / "b.npy", np.zeros((1, 1, 1, 1)))
    with pytest.raises(DimensionError):
        raw.read_array(spark, str(tmp_path / "b.npy"))
    with pytest.raises(TypeError):
        from_numpy(spark, np.array(["a"]))


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("name,shape,dtype", [("a.npy", (7, 5, 4), "int32"), ("a.npy", (7, 5), "uint64"), ("a.npy", (9,), "float32"), ("a.raw", (7, 5, 4), "uint8")])
def test_arrays_are_written_as_they_are_read(spark, tmp_path, monkeypatch, order, name, shape, dtype):
    monkeypatch.setattr(raw, "STRETCH", 16)
    a = np.asarray(RNG.integers(0, 3, shape), dtype=dtype, order=order)
    a[-1] = np.iinfo(dtype).max if a.dtype.kind in "iu" else 0.5
    df, grid = from_numpy(spark, a, order)
    path = str(tmp_path / name)
    raw.write_array(df.repartition(5), grid, path, dtype, column="v")
    raw.write_array(df.repartition(3), grid, path, dtype, column="v")  # replaces the file
    options = {} if name.endswith("npy") else {"dtype": dtype, "shape": ",".join(map(str, shape)), "order": order}
    got, _ = raw.open_array({"path": path, **options})
    assert got.dtype == a.dtype and (got == a).all()
    back, again = raw.read_array(spark, path, **options)
    assert again.ndim == grid.ndim and (to_numpy(back, again, "v", a.dtype) == a).all()
    assert [f.name for f in tmp_path.iterdir()] == [name]


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("shape,dtype", [((7, 5, 4), "int32"), ((11, 13), "uint64"), ((9,), "float32"), ((64, 64, 3), "uint8"), ((0, 3), "int64")])
def test_arrays_in_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch, order, shape, dtype):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.arrays.link./in", f"file://{tmp_path.parent}")
    monkeypatch.setattr(raw, "RECORD", 64)
    a = np.asarray(RNG.integers(0, 3, shape), dtype=dtype, order=order)
    if dtype == "uint64":
        a[-1] = 2**64 - 1
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "a.raw").write_bytes(a.tobytes(order=order))
    store = f"viewfs://arrays/in/{tmp_path.name}"
    for name, options in (("a.npy", {}), ("a.raw", {"dtype": dtype, "shape": ",".join(map(str, shape)), "order": order})):
        df, grid = raw.read_array(spark, f"{store}/{name}", **options)
        assert grid.ndim == len(shape) and (to_numpy(df, grid, "v", dtype) == a).all()
    with pytest.raises(ValueError, match="bytes of data"):
        raw.read_array(spark, f"{store}/a.raw", dtype=dtype, shape="100,100", order=order)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    df, grid = from_numpy(spark, np.arange(600).reshape(20, 30))
    for bad in (df, df.withColumn("v", df.v % 2).withColumn("x", df.x + 10)):  # too large for the type; off the grid
        with pytest.raises(Exception, match="(?i)fit|grid"):
            raw.write_array(bad, grid, str(tmp_path / "a.npy"), "uint8", column="v")
        assert not list(tmp_path.iterdir())


def test_large_unsigned_values(spark, tmp_path):
    a = np.array([[2**64 - 1, 2**64 - 2, 2**63], [5, 1, 2**63 - 1]], np.uint64)
    np.save(tmp_path / "a.npy", a)
    df, grid = raw.read_array(spark, str(tmp_path / "a.npy"))
    assert {int(r.v) for r in df.collect()} == set(map(int, a.ravel()))
    got = to_numpy(connected_components(df, grid, 4, delta=1), grid)
    assert got.tolist() == [[1, 1, 2], [3, 4, 2]]


def test_numpy_types(spark):
    for kind in ("int8", "uint8", "int64", "uint64", "float32", "float64", "bool"):
        a = np.array([[1, 0, 1], [1, 1, 0]], dtype=kind)
        df, grid = from_numpy(spark, a)
        assert (to_numpy(connected_components(df, grid, 4), grid) == brute.label(a, 4, order="C")).all()


def test_blocks(spark, tmp_path):
    df, _ = from_numpy(spark, RNG.integers(1, 3, (3, 3, 20)))
    raw.write_blocks(df, str(tmp_path / "b"), 8)
    got = raw.read_blocks(spark, str(tmp_path / "b"), 7, 17, 8)
    assert {r.z for r in got.collect()} == set(range(7, 17)) and got.columns == df.columns
    assert raw.read_blocks(spark, str(tmp_path / "b")).count() == df.count()


def test_dense_grid(spark):
    grid = Grid(3, 2, 2, 3, "C")
    cells = {tuple(r) for r in all_cells(spark, grid).collect()}
    assert cells == {(x, y, z) for x in range(3) for y in range(2) for z in range(2)}
    df = spark.createDataFrame([(1, 1, 0, 7)], "x int, y int, z int, v int")
    assert sorted(r.v for r in densify(df, grid).collect()) == [0] * 11 + [7]


@pytest.mark.parametrize("connectivity", [6, 26])
def test_stream_of_slabs(spark, tmp_path, connectivity):
    a = RNG.integers(0, 3, (6, 5, 8))
    df, grid = from_numpy(spark, a, "F")
    cells = str(tmp_path / "in")
    for i, part in enumerate(("z < 3", "z >= 5", "z = 3 and x < 3", "z = 4 or (z = 3 and x >= 3)")):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{cells}/{i}")
    volume = SlabLabels(spark, str(tmp_path / "out"), grid, connectivity)
    assert volume.labels() is None
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{cells}/*")
    query = volume.writer(stream).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert (to_numpy(volume.labels(), grid) == brute.label(a, connectivity)).all()
    again = SlabLabels(spark, str(tmp_path / "out"), grid, connectivity)  # after a restart
    assert (to_numpy(again.labels(), grid) == brute.label(a, connectivity)).all()
    volume.add(df.filter("z < 3"), 0)  # a batch that comes again changes nothing
    assert (to_numpy(volume.labels(), grid) == brute.label(a, connectivity)).all()


def test_labels_after_every_batch(spark, tmp_path, monkeypatch):
    a = RNG.integers(0, 3, (6, 5, 9))
    a[2, 2] = 1  # goes through all batches
    df, grid = from_numpy(spark, a, "F")
    volume = SlabLabels(spark, str(tmp_path / "out"), grid, 6)
    contracted = []
    solve = slabs.connected_components
    monkeypatch.setattr(slabs, "connected_components", lambda edges, written: (contracted.append(edges.count()), solve(edges, written))[1])
    for i, low in enumerate((3, 0, 6)):
        volume.add(df.filter(f"z >= {low} and z < {low + 3}"), i)
        seen = np.zeros_like(a)
        for z in (3, 0, 6)[: i + 1]:
            seen[:, :, z : z + 3] = a[:, :, z : z + 3]
        assert (to_numpy(volume.labels(), grid) == brute.label(seen, 6)).all()
    held = volume._read("links").count()
    assert sum(contracted) <= held and volume.equivalences().count() > 0
    n = len(contracted)
    volume.labels()
    assert len(contracted) == n  # nothing came, nothing is solved


def test_components_that_are_finished(spark, tmp_path):
    a = RNG.integers(0, 4, (6, 5, 9))
    df, grid = from_numpy(spark, a, "F")
    volume = SlabLabels(spark, str(tmp_path / "out"), grid, 6)
    assert volume.finished(3) is None
    want = brute.label(a, 6)
    for i in range(3):
        volume.add(df.filter(f"z >= {3 * i} and z < {3 * i + 3}"), i)
        below = 3 * i + 3
        first = {k: min(int(x + 6 * (y + 5 * z)) for x, y, z in np.argwhere(want == k)) for k in range(1, want.max() + 1)}
        done = {k for k in first if np.argwhere(want == k)[:, 2].max() < below - 1}
        got = {(r.first, r.x, r.y, r.z) for r in volume.finished(below).collect()}
        assert got == {(first[want[tuple(p)]], *map(int, p)) for k in done for p in np.argwhere(want == k)}
    assert len(done) > 3

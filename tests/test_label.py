import numpy as np
import pytest

from gridspark.operators import label
from gridspark.operators.grid import DimensionError, Grid, from_numpy, to_numpy
from tests import brute


def run(spark, array, connectivity=26, order="F", **mode):
    df, grid = from_numpy(spark, array, order)
    return to_numpy(label.connected_components(df, grid, connectivity, **mode), grid)


RNG = np.random.default_rng(5)


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_random_3d(spark, connectivity):
    a = RNG.integers(0, 4, (9, 7, 6))
    assert (run(spark, a, connectivity) == brute.label(a, connectivity)).all()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_random_2d_in_both_orders(spark, connectivity):
    a = RNG.integers(0, 3, (13, 11))
    for order in "CF":
        assert (run(spark, a, connectivity, order) == brute.label(a, connectivity, order=order)).all()


@pytest.mark.parametrize("connectivity,ndim", [(4, 2), (8, 2), (6, 3)])
def test_periodic(spark, connectivity, ndim):
    a = RNG.integers(0, 3, (7, 6, 5)[:ndim])
    assert (run(spark, a, connectivity, periodic_boundary=True) == brute.label(a, connectivity, periodic=True)).all()


@pytest.mark.parametrize("connectivity,ndim", [(4, 2), (8, 2), (6, 3)])
def test_periodic_binary(spark, connectivity, ndim):
    a = RNG.integers(0, 2, (7, 6, 5)[:ndim]) * RNG.integers(1, 4, (7, 6, 5)[:ndim])
    assert (run(spark, a, connectivity, periodic_boundary=True, binary_image=True) == brute.label(a, connectivity, periodic=True, binary=True)).all()


@pytest.mark.parametrize("connectivity,ndim", [(8, 2), (26, 3)])
def test_continuous(spark, connectivity, ndim):
    a = RNG.integers(0, 60, (9, 8, 5)[:ndim]).astype(np.float64)
    assert (run(spark, a, connectivity, delta=7) == brute.label(a, connectivity, delta=7)).all()


def test_continuous_two_by_two(spark):
    a = np.array([[1, 2], [3, 4]])
    assert (run(spark, a, 8, delta=1) > 0).all()
    assert run(spark, a, 4, "C", delta=1).tolist() == [[1, 1], [2, 2]]


def test_binary_takes_any_nonzero_value(spark):
    a = RNG.integers(-2, 3, (8, 8, 4))
    assert (run(spark, a, 26, binary_image=True) == brute.label(a != 0, 26)).all()
    assert run(spark, np.array([[1, 2]]), 4, binary_image=True).max() == 1
    assert (run(spark, a > 0, 6) == brute.label(a > 0, 6)).all()


def test_nan_is_alone_and_minus_zero_is_background(spark):
    a = np.array([[np.nan, np.nan, 1.0, 1.0, -0.0]])
    assert len(np.unique(run(spark, a, 8)[a.nonzero()])) == 3
    assert run(spark, a, 8)[0, 4] == 0


def test_line_square_and_one_dimension(spark):
    assert run(spark, np.ones((1, 1, 4), int)).max() == 1
    square = np.kron([[8, 9], [10, 11]], np.ones((8, 8), int))
    assert (run(spark, square, 8, "C") == np.kron([[1, 2], [3, 4]], np.ones((8, 8), int))).all()
    assert (run(spark, square, 8, "F") == np.kron([[1, 3], [2, 4]], np.ones((8, 8), int))).all()
    assert run(spark, np.array([1, 1, 0, 1, 2])).tolist() == [1, 1, 0, 2, 3]


def test_empty_and_count(spark):
    df, grid = from_numpy(spark, np.zeros((4, 4, 4), int))
    out, n = label.connected_components(df, grid, return_N=True)
    assert (out.count(), n) == (0, 0)
    df, grid = from_numpy(spark, np.eye(4, dtype=int))
    assert label.connected_components(df, grid, 4, return_N=True)[1] == 4


def test_refusals(spark):
    df, grid = from_numpy(spark, np.ones((2, 2, 2), int))
    for bad in ({"connectivity": 8}, {"connectivity": 7}, {"periodic_boundary": True}, {"delta": -1}, {"out_dtype": "int3"}):
        with pytest.raises(ValueError):
            label.connected_components(df, grid, **bad)
    with pytest.raises(DimensionError):
        Grid(2, 2, 2, 4)
    with pytest.raises(TypeError):
        label.connected_components(spark.createDataFrame([(0, 0, 0, "a")], "x int, y int, z int, v string"), grid)


def test_out_dtype_must_hold_the_labels(spark):
    df, grid = from_numpy(spark, np.ones((2, 2), int))
    assert label.connected_components(df, grid, 4, out_dtype="uint16").count() == 4


def test_stack_equals_the_whole(spark):
    a = RNG.integers(0, 3, (6, 5, 8))
    df, grid = from_numpy(spark, a, "F")
    slabs = [(df.filter(f"z >= {z} and z < {z + 3}").withColumn("z", df.z - z), min(3, 8 - z)) for z in (0, 3, 6)]
    out, n = label.connected_components_stack(iter(slabs), grid, 26, return_N=True)
    assert (to_numpy(out, grid) == brute.label(a, 26)).all() and n == brute.label(a, 26).max()
    assert label.connected_components_stack(iter([]), grid, return_N=True) == (None, 0)

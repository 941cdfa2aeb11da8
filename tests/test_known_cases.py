"""Cases whose answer is known without a computation."""

import numpy as np
import pytest

from gridspark.operators import bits, label, stats
from gridspark.operators.grid import Grid, from_numpy, to_numpy


def labels(spark, array, connectivity, order="F", **mode):
    df, grid = from_numpy(spark, np.asarray(array), order)
    return to_numpy(label.connected_components(df, grid, connectivity, **mode), grid)


def count(spark, array, connectivity, **mode):
    df, grid = from_numpy(spark, np.asarray(array), "F")
    return label.connected_components(df, grid, connectivity, return_N=True, **mode)[1]


#: Diagonal chains and squares that touch at corners only; letters are the components of eight neighbours.
DIAGONALS = ["..a.a............", "b..a..c.dd.......", ".b..a...dd.......", "b.b...dd..dd.....", "......dd..dd.....", "..e.f....d.......", ".e...f..d........"]


@pytest.mark.parametrize("connectivity", [8, 18, 26])
def test_diagonals_join_corners(spark, connectivity):
    picture = np.array([[" .abcdef".index(c) - 1 for c in row] for row in DIAGONALS])
    assert (labels(spark, (picture > 0).astype(int), connectivity, "C") == picture).all()


@pytest.mark.parametrize("connectivity", [4, 6])
def test_diagonals_part_without_corners(spark, connectivity):
    got = labels(spark, [[int(c != ".") for c in row] for row in DIAGONALS], connectivity, "C")
    assert got.max() == 18 and [got[0, 2], got[0, 4], got[1, 0], got[3, 7], got[6, 8]] == [1, 2, 3, 11, 18]
    assert (got[1:3, 8:10] == 6).all() and (got[3:5, 10:12] == 12).all()


@pytest.mark.parametrize("connectivity", [4, 6, 8, 18, 26])
def test_cross_with_an_intruder(spark, connectivity):
    a = np.kron([[1, 1], [1, 2]], np.ones((2, 2), int))
    a[2, 2] = 1
    a = np.insert(np.insert(a, 2, 0, axis=0), 2, 0, axis=1)
    rows = np.insert(np.insert(np.array([[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 5], [3, 3, 5, 5]]), 2, 0, axis=0), 2, 0, axis=1)
    assert (labels(spark, a, connectivity, "C") == rows).all()
    columns = np.array([0, 1, 3, 2, 4, 5])[rows]
    assert (labels(spark, a, connectivity, "F") == columns).all()


def test_cross_through_a_cube(spark):
    plane = np.zeros((7, 7), int)
    plane[:3, :3], plane[:3, 4:], plane[4:, :3], plane[4:, 4:] = 1, 2, 3, 4
    cube = np.repeat(plane[None], 7, axis=0)
    for values in (cube > 0, np.where(cube == 4, 2, cube > 0)):
        assert (labels(spark, values.astype(int), 26, "C") == cube).all()
        assert (labels(spark, values.astype(int), 26, "F") == np.array([0, 1, 3, 2, 4])[cube]).all()


@pytest.mark.parametrize("connectivity,step,n", [(6, "sum", 1688), (26, "eighth", 512)])
def test_lattices_have_as_many_components_as_cells(spark, connectivity, step, n):
    x, y, z = np.indices((15, 15, 15))
    cells = {
        "sum": (x + y + z) % 2 == 0,  # no two share a face
        "eighth": (x % 2 == 0) & (y % 2 == 0) & (z % 2 == 0),  # none touch at all
    }[step]
    assert cells.sum() == n and count(spark, cells, connectivity) == n
    assert count(spark, cells, 26) == (1 if step == "sum" else n)


def test_flat_lattice(spark):
    cells = np.zeros((31, 30), bool)
    cells[::2, ::2] = True
    assert count(spark, cells, 8) == 16 * 15


@pytest.mark.parametrize("shape", [(50, 66000), (66000, 60)])
def test_statistics_of_wide_grids(spark, shape):
    at = [(x, y, 0, 1 + (x >= 40)) for low in (10, 40) for x in range(low, low + 10) for y in range(low, low + 10)]
    df = spark.createDataFrame(at, "x int, y int, z int, label long")
    got = {r.label: r for r in stats.statistics(df, Grid(*shape, ndim=2)).collect()}
    assert [got[k].voxel_counts for k in range(3)] == [shape[0] * shape[1] - 200, 100, 100]
    assert (got[2].xmin, got[2].xmax, got[2].ymin, got[2].ymax, got[1].cx, got[1].cy) == (40, 50, 40, 50, 14.5, 14.5)
    assert (got[0].xmin, got[0].xmax, got[0].ymax) == (0, *shape)


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("order", ["C", "F"])
def test_continuous_blocks(spark, connectivity, order):
    noise = np.random.default_rng(4).integers(0, 5, (24, 24))
    image = np.zeros((96, 64), int)
    image[8:32, 16:40], image[50:74, 16:40] = 50 + noise, 70 + noise
    assert labels(spark, image, connectivity, order).max() > 200
    assert labels(spark, image, connectivity, order, delta=1).max() > 3
    got = labels(spark, image.astype(np.float32), connectivity, order, delta=5)
    assert set(np.unique(got[8:32, 16:40])) == {1} and set(np.unique(got[50:74, 16:40])) == {2} and got.max() == 2


def spots(shape, *at):
    a = np.zeros(shape, int)
    for p in at:
        a[p] = 1
    return a


@pytest.mark.parametrize("connectivity,shape", [(4, (10, 10)), (8, (10, 10)), (6, (10, 10, 10))])
def test_opposite_borders_meet(spark, connectivity, shape):
    for axis in range(len(shape)):
        a = np.zeros(shape, int)
        np.moveaxis(a, axis, 0)[[0, -1]] = 1
        assert count(spark, a, connectivity) == 2 and count(spark, a, connectivity, periodic_boundary=True) == 1
    a = np.zeros(shape, int)
    a[[1, -2]] = 1
    assert count(spark, a, connectivity, periodic_boundary=True) == 2


def test_corners_meet_across_borders(spark):
    frame = np.zeros((10, 10), int)
    frame[:, [0, -1]] = 1
    frame[np.ix_([0, -1], [0, -1])] = 2
    assert count(spark, frame, 8, periodic_boundary=True) == 2
    frame[-1, 0] = frame[0, -1] = 3
    assert count(spark, frame, 8, periodic_boundary=True) == 3
    for second, n in (((2, 0), 1), ((1, 0), 2)):
        assert count(spark, spots((4, 4), second, (3, 3)), 8, periodic_boundary=True) == n
    assert count(spark, spots((4, 4), (3, 0), (2, 3)), 8, periodic_boundary=True) == 1


def colours(spark, field, connectivity, **mode):
    df, grid = from_numpy(spark, np.asarray(field), "F", background=True)
    return to_numpy(bits.color_connectivity_graph(df, grid, connectivity, column="v", **mode), grid)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_colours_of_small_fields(spark, connectivity):
    all_ways, x_only, y_only = 0b1111, 0b0011, 0b1100
    cases = [
        (np.full((2, 1), all_ways), [[1], [1]]),
        (np.full((2, 1), y_only), [[1], [2]]),
        (np.full((1, 2), y_only), [[1, 1]]),
        (np.full((1, 2), x_only), [[1, 2]]),
        (np.zeros((2, 2), int), [[1, 3], [2, 4]]),
        ([[0b1110, all_ways], [0b1101, all_ways]], [[1, 1], [1, 1]]),
        ([[0b1110, all_ways], [0b1101, 0b0111]], [[1, 1], [2, 1]]),
        ([[0b1010, 0b0111], [0b1101, 0b0111]], [[1, 3], [2, 3]]),
    ]
    for field, want in cases:
        assert colours(spark, field, connectivity).tolist() == want
    nothing = spark.createDataFrame([], "x int, y int, z int, bits int")
    assert bits.color_connectivity_graph(nothing, Grid(1, 1, 1, 2), connectivity).count() == 0


def test_colours_along_diagonals_in_both_encodings(spark):
    assert colours(spark, [[1 << 4, 1 << 6], [1 << 5, 1 << 7]], 8).tolist() == [[1, 2], [2, 1]]
    assert colours(spark, [[1 << 6, 1 << 8], [1 << 7, 1 << 9]], 8, wide=True).tolist() == [[1, 2], [2, 1]]


@pytest.mark.parametrize("connectivity", [6, 26])
def test_colours_of_eight_rooms(spark, connectivity):
    ways = 6 if connectivity == 6 else 26
    field = np.full((10, 10, 10), (1 << ways) - 1)
    x, y, z = np.indices(field.shape) // 5
    for axis in range(3):
        side = np.moveaxis(field, axis, 0)
        side[4] &= ~((1 << 2 * axis) | (((1 << 26) - 1) ^ 0b111111))  # no way through the walls, corners included
        side[5] &= ~((2 << 2 * axis) | (((1 << 26) - 1) ^ 0b111111))
    assert (colours(spark, field, connectivity) == 1 + x + 2 * y + 4 * z).all()
    if connectivity == 26:
        field[4:6, 4:6, 4:6] = ((1 << 26) - 1) ^ 0b111111  # the corners of all rooms meet in the middle
        assert (colours(spark, field, connectivity) == 1).all()

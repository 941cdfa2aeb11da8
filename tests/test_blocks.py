"""Blocks much smaller than the grid, so that every kind of border between blocks occurs."""

import numpy as np
import pytest

from gridspark.operators import bits, contacts, halo, label, runs, seams, stats
from gridspark.operators.grid import Grid, from_numpy, to_numpy
from tests import brute

RNG = np.random.default_rng(21)


@pytest.fixture(autouse=True)
def little_blocks(monkeypatch):
    monkeypatch.setattr(halo, "SIDES", {1: (3, 1, 1), 2: (3, 2, 1), 3: (3, 2, 2)})
    monkeypatch.setattr(seams, "SIDES", {1: (3, 1, 1), 2: (3, 2, 1), 3: (3, 2, 2)})


@pytest.mark.parametrize("connectivity,shape", [(4, (17,)), (8, (8, 7)), (6, (7, 5, 4)), (18, (7, 5, 4)), (26, (7, 5, 4))])
def test_continuous_labels(spark, connectivity, shape):
    a = RNG.integers(0, 7, shape)
    df, grid = from_numpy(spark, a, "F")
    assert (to_numpy(label.connected_components(df, grid, connectivity, delta=1), grid) == brute.label(a, connectivity, delta=1)).all()


def test_differences_of_extreme_values_do_not_wrap(spark):
    a = np.array([[np.iinfo(np.int64).min, 1], [np.iinfo(np.int64).max, 2]]).T
    df, grid = from_numpy(spark, a, "F")
    assert to_numpy(label.connected_components(df, grid, 4, delta=1), grid).tolist() == [[1, 3], [2, 2]]


@pytest.mark.parametrize("order", ["F", "C"])
@pytest.mark.parametrize("connectivity,shape", [(4, (17,)), (4, (9, 8)), (8, (9, 8)), (6, (7, 5, 4)), (18, (7, 5, 4)), (26, (7, 5, 4))])
def test_labels_across_seams(spark, connectivity, shape, order):
    a = RNG.integers(0, 3, shape)
    df, grid = from_numpy(spark, a, order)
    assert (to_numpy(label.connected_components(df, grid, connectivity), grid) == brute.label(a, connectivity, order=order)).all()
    got = to_numpy(label.connected_components(df, grid, connectivity, binary_image=True), grid)
    assert (got == brute.label(a, connectivity, binary=True, order=order)).all()


@pytest.mark.parametrize("binary", [False, True])
@pytest.mark.parametrize("connectivity,shape", [(4, (1, 9)), (4, (9, 8)), (8, (9, 8)), (8, (2, 7)), (6, (7, 5, 4)), (6, (7, 1, 2)), (6, (11,))])
def test_labels_across_seams_and_borders(spark, connectivity, shape, binary):
    a = RNG.integers(0, 3, shape)
    df, grid = from_numpy(spark, a, "F")
    got = label.connected_components(df, grid, connectivity, periodic_boundary=True, binary_image=binary)
    assert (to_numpy(got, grid) == brute.label(a, connectivity, periodic=True, binary=binary)).all()


def test_a_component_through_every_block(spark):
    a = np.zeros((9, 8, 6), int)  # a snake that crosses seams again and again, and its mirror image
    a[::2] = 1
    for k in range(1, 9, 2):
        a[k, 0 if k % 4 == 1 else 7, 0 if k % 8 < 4 else 5] = 1
    df, grid = from_numpy(spark, np.stack([a[..., 0], a[..., 1] * 2, a[..., 5]], 2), "F")
    full = np.stack([a[..., 0], a[..., 1] * 2, a[..., 5]], 2)
    assert (to_numpy(label.connected_components(df, grid, 6), grid) == brute.label(full, 6)).all()
    df, grid = from_numpy(spark, a, "F")
    assert (to_numpy(label.connected_components(df, grid, 6), grid) == 1).sum() == (a > 0).sum()


def test_not_a_number_is_alone_in_blocks(spark):
    a = RNG.choice([np.nan, 1.0, 2.5, 0.0], (8, 7))
    df, grid = from_numpy(spark, a, "F")
    got = to_numpy(label.connected_components(df, grid, 8), grid)
    alone = got[np.isnan(a)]
    assert len(set(alone.tolist())) == alone.size and not set(alone) & set(got[~np.isnan(a)])
    want = brute.label(np.nan_to_num(a), 8)
    pairs = set(zip(got[~np.isnan(a)].tolist(), want[~np.isnan(a)].tolist()))
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_repeated_cells_and_cells_off_the_grid(spark):
    rows = [(0, 0, 0, 1), (0, 0, 0, 1), (1, 0, 0, 1), (3, 0, 0, 2), (3, 0, 0, 2), (-1, 0, 0, 1), (0, 9, 0, 1)]
    df = spark.createDataFrame(rows, "x int, y int, z int, v int")
    got = label.connected_components(df, Grid(5, 5, 1, 2), 8)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 0, 1), (0, 0, 0, 1), (1, 0, 0, 1), (3, 0, 0, 2), (3, 0, 0, 2)]


@pytest.mark.parametrize("connectivity,shape", [(8, (8, 7)), (6, (7, 5, 4)), (26, (7, 5, 4))])
def test_contacts(spark, connectivity, shape):
    a = RNG.integers(0, 5, shape)
    df, grid = from_numpy(spark, a, "F")
    df = df.withColumnRenamed("v", "label")
    want = brute.pairs(a, connectivity, (1.5, 10, 4))
    got = {(r.label_1, r.label_2): r.value for r in contacts.contacts(df, grid, connectivity, anisotropy=(1.5, 10, 4)).collect()}
    assert got == {k: pytest.approx(v[0]) for k, v in want.items()}
    got = {(r.label_1, r.label_2): r.value for r in contacts.contacts(df, grid, connectivity, surface_area=False).collect()}
    assert got == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("connectivity,shape", [(4, (8, 7)), (8, (8, 7)), (6, (7, 5, 4)), (18, (7, 5, 4)), (26, (7, 5, 4))])
def test_connectivity_bits(spark, connectivity, shape):
    a = RNG.integers(0, 3, shape)
    a[: shape[0] // 2] *= RNG.random((shape[0] // 2, *shape[1:])) > 0.8  # blocks without a cell
    df, grid = from_numpy(spark, a, "F")
    want = np.zeros(shape, int)
    order = bits._encoding(connectivity, grid)
    for o in bits.offsets(connectivity, len(shape)):
        for at in np.ndindex(shape):
            to = tuple(np.add(at, o[: len(shape)]))
            off = any(t < 0 or t >= s for t, s in zip(to, shape))
            want[at] |= (off or a[to] == a[at]) << order.index(o)
    got = bits.voxel_connectivity_graph(df, grid, connectivity)
    assert got.count() == a.size and (to_numpy(got, grid, "bits") == want).all()


def test_colouring(spark):
    a = RNG.integers(0, 2, (7, 5, 4))
    df, grid = from_numpy(spark, a, "F")
    got = bits.color_connectivity_graph(bits.voxel_connectivity_graph(df, grid, 26), grid, 26)
    assert (to_numpy(got, grid) == brute.label(a + 1, 26)).all()


def test_rows_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(runs, "ROW_STRETCH", 4)
    a = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 0, 2, 2, 2, 3, 3, 3, 3, 0, 0, 0, 0, 3])
    a = np.stack([a, a[::-1], RNG.integers(0, 2, len(a))], 1)
    df, grid = from_numpy(spark, a, "F")
    got = to_numpy(runs.cell_runs(df, grid), grid, "run")
    monkeypatch.setattr(runs, "ROW_STRETCH", 1 << 18)
    assert (got == to_numpy(runs.cell_runs(df, grid), grid, "run")).all()
    for delta in (0, 1):
        want = brute.label(a, 4, delta)
        monkeypatch.setattr(runs, "ROW_STRETCH", 4)
        assert (to_numpy(label.connected_components(df, grid, 4, delta), grid) == want).all()


def test_one_giant_label_in_fragments(spark, monkeypatch):
    monkeypatch.setattr(runs, "FLAT_STRETCH", 8)
    a = (RNG.random(200) > 0.2).astype(int)
    a[40:75] = 1
    df, grid = from_numpy(spark, a, "F")
    edge = np.flatnonzero(np.diff(np.r_[0, a, 0]))
    got = {tuple(r) for r in runs.flat_runs(df.withColumnRenamed("v", "label"), grid).select("start", "end").collect()}
    assert got == set(zip(edge[::2].tolist(), edge[1::2].tolist()))


def test_background_of_a_full_and_of_an_empty_grid(spark):
    df, grid = from_numpy(spark, np.ones((3, 2, 2), int), "F")
    full = {r.label: r for r in stats.statistics(df, grid, "v").collect()}
    assert full[0].voxel_counts == 0 and full[0].xmin is None and np.isnan(full[0].cx) and full[1].voxel_counts == 12
    none = stats.statistics(df.filter("v = 0"), grid, "v").collect()
    assert [(r.label, r.voxel_counts, r.xmin, r.xmax, r.zmax, r.cx) for r in none] == [(0, 12, 0, 3, 2, 1.0)]

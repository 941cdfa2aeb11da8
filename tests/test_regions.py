import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import bits, contacts, extract, prune, runs, stats
from gridspark.operators.grid import Grid, from_numpy, to_numpy
from tests import brute

RNG = np.random.default_rng(8)


def as_labels(spark, array, order="F"):
    df, grid = from_numpy(spark, array, order)
    return df.withColumnRenamed("v", "label"), grid


def test_statistics(spark):
    a = RNG.integers(0, 3, (6, 5, 4))
    a[a == 2] = 4
    df, grid = as_labels(spark, a)
    got = {r.label: r for r in stats.statistics(df, grid).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k in (0, 1, 4):
        at = np.argwhere(a == k)
        r = got[k]
        assert r.voxel_counts == len(at)
        assert [(r.xmin, r.xmax), (r.ymin, r.ymax), (r.zmin, r.zmax)] == [(lo, hi + 1) for lo, hi in zip(at.min(0), at.max(0))]
        assert np.allclose((r.cx, r.cy, r.cz), at.mean(0))
    assert (got[2].voxel_counts, got[2].xmin) == (0, None) and np.isnan(got[2].cx)
    assert stats.statistics(df, grid, no_slice_conversion=True).filter("label = 1").first().xmax == np.argwhere(a == 1)[:, 0].max()
    with pytest.raises(ValueError):
        stats.statistics(as_labels(spark, np.array([[-1, 1]]))[0], grid)


def test_dust(spark):
    a = RNG.integers(0, 3, (8, 8, 4))
    lab = brute.label(a, 6)
    size = np.bincount(lab.ravel())[lab] * (lab > 0)
    df, grid = from_numpy(spark, a, "F")
    assert (to_numpy(prune.dust(df, grid, 4, 6), grid, "v") == a * (size >= 4)).all()
    out, n = prune.dust(df, grid, (2, 4), 6, invert=True, return_N=True)
    keep = (size > 0) & ~((size >= 2) & (size < 4))
    assert (to_numpy(out, grid, "v") == a * keep).all() and n == len(np.unique(lab[keep]))
    pre, _ = from_numpy(spark, lab, "F")
    assert (to_numpy(prune.dust(pre, grid, 4, precomputed_ccl=True), grid, "v") == lab * (size >= 4)).all()


@pytest.mark.parametrize("k", [0, 1, 5, 10_000])
def test_largest_k(spark, k):
    a = RNG.integers(0, 3, (8, 6, 4))
    df, grid = from_numpy(spark, a, "F")
    out, n = prune.largest_k(df, grid, k, 6, return_N=True)
    lab = brute.label(a, 6)
    got = to_numpy(out, grid)
    if k >= lab.max():
        assert (got == lab).all() and n == lab.max()
        return
    sizes = np.bincount(lab.ravel())[1:]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))[:k]
    want = np.zeros_like(lab)
    for new, i in enumerate(sorted(order, key=lambda i: (sizes[i], i)), 1):
        want[lab == i + 1] = new
    assert (got == want).all() and n == k


@pytest.mark.parametrize("connectivity,ndim", [(4, 2), (8, 2), (6, 3), (18, 3), (26, 3)])
def test_contacts(spark, connectivity, ndim):
    a = RNG.integers(0, 5, (6, 5, 4)[:ndim])
    df, grid = as_labels(spark, a)
    want = brute.pairs(a, connectivity, (1.5, 10, 4))
    area = {(r.label_1, r.label_2): r.value for r in contacts.contacts(df, grid, connectivity, anisotropy=(1.5, 10, 4)).collect()}
    assert area == {k: pytest.approx(v[0]) for k, v in want.items()}
    count = {(r.label_1, r.label_2): r.value for r in contacts.contacts(df, grid, connectivity, surface_area=False).collect()}
    assert count == {k: v[1] for k, v in want.items()}
    assert {tuple(r) for r in contacts.region_graph(df, grid, connectivity).collect()} == set(want)


def test_contact_across_a_corner_has_no_area(spark):
    a = np.zeros((2, 2, 2), int)
    a[0, 0, 0], a[1, 1, 1] = 1, 5
    df, grid = as_labels(spark, a)
    assert [tuple(r) for r in contacts.contacts(df, grid).collect()] == [(1, 5, 0.0)]


def test_connectivity_bits(spark):
    a = np.ones((3, 3), int)
    a[1, 1] = 0
    df, grid = from_numpy(spark, a, "F")
    got = to_numpy(bits.voxel_connectivity_graph(df, grid, 8), grid, "bits")
    assert got[1, 1] == 0 and got[0, 0] == 0xFF - 16 and got[0, 1] == 0xFF - 1 and got[2, 2] == 0xFF - 128
    assert to_numpy(bits.voxel_connectivity_graph(df, grid, 4), grid, "bits")[0, 0] == 0x0F
    cube = np.ones((3, 3, 3), int)
    cube[1, 1, 1] = 0
    df, grid = from_numpy(spark, cube, "F")
    got = to_numpy(bits.voxel_connectivity_graph(df, grid, 26), grid, "bits")
    assert got[1, 1, 1] == 0 and got[0, 0, 0] == (1 << 26) - 1 - (1 << 18)
    assert to_numpy(bits.voxel_connectivity_graph(df, grid, 6), grid, "bits")[0, 0, 0] == 0x3F
    with pytest.raises(TypeError):
        bits.voxel_connectivity_graph(df.withColumn("v", F.lit(1.5)), grid)


@pytest.mark.parametrize("connectivity,ndim", [(4, 2), (8, 2), (26, 2), (6, 3), (26, 3)])
def test_colouring_a_field_gives_the_components_of_all_cells(spark, connectivity, ndim):
    a = RNG.integers(0, 2, (6, 5, 4)[:ndim])
    df, grid = from_numpy(spark, a, "F")
    out, n = bits.color_connectivity_graph(bits.voxel_connectivity_graph(df, grid, connectivity), grid, connectivity, return_N=True)
    want = brute.label(a + 1, connectivity)
    assert (to_numpy(out, grid) == want).all() and n == want.max()
    with pytest.raises(ValueError):
        bits.color_connectivity_graph(df, grid, 18)


def test_runs_draw_and_erase(spark):
    a = RNG.integers(0, 3, (5, 4, 3))
    df, grid = as_labels(spark, a)
    flat = a.ravel(order="F")
    want = set()
    for i, v in enumerate(flat):
        if v and (i == 0 or flat[i - 1] != v):
            j = i
            while j < len(flat) and flat[j] == v:
                j += 1
            want.add((int(v), i, j))
    found = runs.flat_runs(df, grid)
    assert {tuple(r) for r in found.select("label", "start", "end").collect()} == want
    assert (to_numpy(runs.draw(found, grid), grid) == a).all()
    assert (to_numpy(runs.erase(found.filter("label = 1"), grid, df), grid) == a * (a != 1)).all()
    with pytest.raises(ValueError):
        runs.draw(spark.createDataFrame([(1, 5, 1000)], "label long, start long, `end` long"), grid)


def test_estimate_and_row_bounds(spark):
    a = np.zeros((7, 5, 4), int)
    a[1:6, 2, 3] = [1, 1, 0, 2, 2]
    df, grid = from_numpy(spark, a, "F")
    assert tuple(runs.estimate_provisional_labels(df, grid).first()) == (2, 2 + 5 * 3, 2 + 5 * 3)
    assert tuple(runs.row_bounds(df).first()) == (2, 3, 1, 6)
    empty, grid = from_numpy(spark, a * 0, "F")
    assert tuple(runs.estimate_provisional_labels(empty, grid).first()) == (0, -1, -1)


def test_each(spark):
    a = RNG.integers(0, 4, (5, 4))
    df, grid = as_labels(spark, a)
    images = extract.Each(df, binary=True)
    assert len(images) == len(np.unique(a[a > 0]))
    for k, cells in images:
        assert (to_numpy(cells, grid, "value") == (a == k)).all()


def test_overlapping_runs_and_runs_over_many_stretches(spark):
    grid = Grid(1000, 1000, 400, 3, "F")
    made = [(3, 10, 20), (5, 15, 18), (5, 15, 18), (1, 0, 12), (0, 19, 30), (2, 65530, 65540), (4, 7, 7), (6, 399_999_990, 400_000_000)]
    df = spark.createDataFrame(made, "label long, start long, `end` long")
    want = {}
    for name, start, end in sorted(made):
        want |= {i: name for i in range(start, end)}
    got = {r.lin: r.label for r in runs.draw(df, grid).select(grid.lin().alias("lin"), "label").collect()}
    assert got == {i: v for i, v in want.items() if v}
    image = spark.createDataFrame([(x, 0, 0, 9) for x in range(0, 40, 3)] + [(0, 1, 0, 9)], "x int, y int, z int, label int")
    kept = {r.x for r in runs.erase(df, grid, image).filter("y = 0").collect()}
    assert kept == {x for x in range(0, 40, 3) if x not in want}
    over = {(r.x, r.y): r.label for r in runs.draw(df, grid, image, value=7).filter("y < 2").collect()}
    assert over[0, 1] == 9 and over[12, 0] == 7 and over[33, 0] == 9 and over[19, 0] == 7


def test_a_run_of_billions_of_cells(spark):
    grid = Grid(2_000_000, 2_000, 2, 3, "F")
    one = spark.createDataFrame([(1, 5, 8_000_000_000 - 3)], "label long, start long, `end` long")
    pieces = runs.run_pieces(one, grid)
    assert pieces.selectExpr("sum(end - start)", "count(*)").first() == (8_000_000_000 - 8, -(-8_000_000_000 // runs.DRAWN))
    image = spark.createDataFrame([(x, 0, 0, 1) for x in range(8)] + [(1_999_999, 1_999, 1, 1)], "x int, y int, z int, label int")
    assert sorted((r.x, r.z) for r in runs.erase(one.selectExpr("label", "start", "start + 2 as end"), grid, image).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (7, 0), (1_999_999, 1)]
    assert runs.draw(one.selectExpr("label", "start", "20000000 as end"), grid).count() == 20_000_000 - 5


def test_images_of_all_labels(spark):
    a = RNG.integers(0, 40, (9, 8, 7))
    a[:, :, :3] = np.where(a[:, :, :3] > 9, 5, a[:, :, :3])  # a label that fills several files
    df, grid = as_labels(spark, a)
    index = extract.ComponentIndex(df.repartition(4))
    sizes = {r.label: (r.voxel_counts, r.xmin, r.zmax) for r in index.labels().collect()}
    assert sizes == {k: (int((a == k).sum()), np.argwhere(a == k)[:, 0].min(), np.argwhere(a == k)[:, 2].max()) for k in np.unique(a[a > 0])}
    seen = []
    for k, corner, mask in index.arrays():
        at = np.argwhere(a == k)
        assert corner == tuple(at.min(axis=0)) and (np.argwhere(mask) + corner == at).all()
        seen.append(k)
    assert seen == sorted(sizes)
    assert (to_numpy(index.image(5).withColumn("value", F.lit(1)), grid, "value") == (a == 5)).all()
    assert index.image(99).count() == 0
    assert len(extract.Each(df.filter("label = 0"))) == 0 and list(extract.ComponentIndex(df.filter("label = 0")).arrays()) == []


def test_pruning_keeps_values_and_joins_no_cells_with_cells(spark):
    a = RNG.integers(0, 4, (7, 6, 5))
    df, grid = from_numpy(spark, a, "F")
    lab = brute.label(a > 0, 6)
    size = np.bincount(lab.ravel())[lab] * (lab > 0)
    out = prune.dust(df, grid, 3, 6, binary_image=True)
    assert (to_numpy(out, grid, "v") == a * (size >= 3)).all()
    assert "hashpartitioning(x" not in out._jdf.queryExecution().executedPlan().toString()
    flags = df.withColumn("v", F.col("v") > 1)
    lab = brute.label(a > 1, 6)
    size = np.bincount(lab.ravel())[lab] * (lab > 0)
    assert (to_numpy(prune.dust(flags, grid, 3, 6), grid, "v", bool) == (size >= 3)).all()

import numpy as np
import pytest

from gridspark.operators.grid import Grid, from_numpy
from gridspark.streaming.frontier import FrontierLabels
from tests import brute

RNG = np.random.default_rng(31)


def components(a, connectivity, binary=False):
    """First cell (as a linear index in order F) to the cells of each component."""
    labels = brute.label(a, connectivity, binary=binary)
    sx, sy, _ = a.shape
    cells = [np.argwhere(labels == k) for k in range(1, labels.max() + 1)]
    return {min(int(x + sx * (y + sy * z)) for x, y, z in at): {tuple(map(int, p)) for p in at} for at in cells}


def finished(volume, after=None):
    out = {}
    for r in volume.finished(after).collect():
        out.setdefault(r.first, set()).add((r.x, r.y, r.z))
    return out


def told(volume, after=None):
    return {r.first: r.voxel_counts for r in volume.statistics(after).collect()}


@pytest.mark.parametrize("connectivity,binary", [(6, False), (18, True)])
def test_components_are_given_out_once_they_end(spark, tmp_path, connectivity, binary):
    a = RNG.integers(0, 5, (6, 5, 9)) * (RNG.random((6, 5, 9)) > (0.8 if binary else 0.1))
    df, grid = from_numpy(spark, a, "F")
    volume = FrontierLabels(spark, str(tmp_path / "v"), grid, connectivity, binary)
    assert finished(volume) == {} and told(volume) == {}
    want, seen = components(a, connectivity, binary), {}
    for i, (low, high) in enumerate([(0, 2), (3, 3), (4, 8)]):
        volume.add(df.filter(f"z between {low} and {high}"), i)
        top = df.filter(f"z <= {high}").agg({"z": "max"}).first()[0]
        ended = {k: v for k, v in want.items() if max(z for *_, z in v) < top}
        new = told(volume, i - 1)
        assert not set(new) & set(seen)  # each once
        seen |= new
        assert seen == {k: len(v) for k, v in ended.items()} == told(volume)
        plane = df.filter(f"z = {top}").count()
        assert spark.read.parquet(f"{tmp_path}/v/state/v={i}/open").count() <= plane == spark.read.parquet(f"{tmp_path}/v/state/v={i}/plane").count()
    assert finished(volume) == ended and finished(volume, 1) == {k: want[k] for k in new}
    volume.finish(3)
    assert finished(volume) == want
    assert spark.read.parquet(f"{tmp_path}/v/state/v=3/open").isEmpty()
    for r in volume.statistics().collect():
        at = np.array(sorted(want[r.first]))
        assert [r.xmin, r.xmax, r.ymin, r.ymax, r.zmin, r.zmax] == [int(v) for n in range(3) for v in (at[:, n].min(), at[:, n].max())]
        assert np.allclose([r.cx, r.cy, r.cz], at.mean(axis=0), rtol=1e-12)


def test_names_that_merge_more_than_once(spark, tmp_path):
    a = np.zeros((9, 1, 8), int)
    a[::2, 0, 0:2] = 1  # five teeth
    a[0:3, 0, 2], a[4:7, 0, 2], a[8, 0, 2] = 1, 1, 1  # two pairs meet in the third plane
    a[[0, 4, 8], 0, 3:5] = 1
    a[:, 0, 5] = 1  # all meet
    df, grid = from_numpy(spark, a, "F")
    volume = FrontierLabels(spark, str(tmp_path / "v"), grid, 6)
    for z in range(6):
        volume.add(df.filter(f"z = {z}"), z)
        assert told(volume) == {}
    assert volume._read("merged").count() == 4
    volume.add(spark.createDataFrame([(0, 0, 6, 0)], df.schema), 6)  # a plane of background ends them
    assert finished(volume) == components(a, 6) and list(told(volume)) == [0]


def test_batches_that_come_again_and_planes_out_of_order(spark, tmp_path):
    a = RNG.integers(0, 3, (4, 4, 8))
    df, grid = from_numpy(spark, a, "F")
    volume = FrontierLabels(spark, str(tmp_path / "v"), grid, 6)
    slabs = [df.filter(f"z between {2 * i} and {2 * i + 1}") for i in range(4)]
    for i in (0, 1, 1, 2, 2):  # as after a commit that failed
        volume.add(slabs[i], i)
    assert len(volume._folders("state")) <= 2
    with pytest.raises(ValueError, match="above"):
        volume.add(slabs[1], 3)
    volume.add(df.limit(0), 3)
    again = FrontierLabels(spark, str(tmp_path / "v"), grid, 6)  # after a restart
    again.add(slabs[3], 4)
    again.finish(5)
    assert finished(again) == components(a, 6)


def test_a_batch_that_failed_halfway_gives_out_nothing(spark, tmp_path, monkeypatch):
    a = RNG.integers(0, 3, (4, 4, 6))
    df, grid = from_numpy(spark, a, "F")
    volume = FrontierLabels(spark, str(tmp_path / "v"), grid, 6)
    volume.add(df.filter("z < 2"), 0)
    before = told(volume), finished(volume)
    create = spark.createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            volume.add(df.filter("z >= 2"), 1)
    assert spark.createDataFrame == create
    assert (told(volume), finished(volume)) == before
    volume.add(df.filter("z >= 2"), 1)
    volume.finish(2)
    assert finished(volume) == components(a, 6)


def test_a_stream_of_slabs(spark, tmp_path):
    a = RNG.integers(0, 3, (5, 4, 6))
    df, grid = from_numpy(spark, a, "F")
    volume = FrontierLabels(spark, str(tmp_path / "v"), grid, 26)
    for z in (0, 2, 4):
        df.filter(f"z between {z} and {z + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = volume.writer(stream).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    volume.finish(1 << 40)
    assert finished(volume) == components(a, 26)


def test_grids_in_other_orders_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        FrontierLabels(spark, str(tmp_path), Grid(2, 2, 2, 3, "C"))

"""A query for each grid operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import bits, contacts, extract, label, prune, runs, stats
from gridspark.operators.grid import Grid, densify
from gridspark.operators.neighborhood import BITS_2D, BITS_3D, half_offsets, offsets, row_offsets
from gridspark.plans.scratch import scratch_folder, written
from gridspark.sources import raw
from gridspark.sources.fixtures import EVENT_GRID, LINEITEM_GRID, embedding_grid, event_grid, lineitem_grid
from gridspark.streaming.frontier import FrontierLabels
from gridspark.streaming.slabs import SlabLabels

Query = Callable[[SparkSession, str], DataFrame]

_LINEITEM = """SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 10 AS INT) AS y, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS z,
 CAST(1 + CAST(sum(l_quantity) AS BIGINT) % {n} AS INT) AS v FROM lineitem GROUP BY 1, 2, 3"""
_EVENTS = """SELECT CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) % 720 AS INT) AS x, CAST(user_id % 64 AS INT) AS y, 0 AS z,
 CAST(1 + count(*) % {n} AS INT) AS v FROM events GROUP BY 1, 2"""


def _source(name: str) -> tuple[Callable[[SparkSession, str], tuple[DataFrame, Grid]], str, Grid]:
    kind, n = name.split(":")
    if kind == "lineitem":
        return (lambda s, d: lineitem_grid(s, d, int(n))), _LINEITEM.format(n=n), LINEITEM_GRID
    return (lambda s, d: event_grid(s, d, int(n))), _EVENTS.format(n=n), EVENT_GRID


def _lin(grid: Grid, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return " + ".join(f"CAST({a}{n} AS BIGINT) * {s}" for n, s in zip("xyz", grid.strides, strict=True))


def _values(steps: list[tuple]) -> str:
    return "(VALUES " + ", ".join(str(s) for s in steps) + ")"


def _labels_sql(cells: str, grid: Grid, connectivity: int, delta: int = 0, binary: bool = False, periodic: bool = False) -> str:
    """WITH clause that ends in `lab (x, y, z, v, label)`: the smallest index spreads along edges until it rests."""
    match = "TRUE" if binary else f"abs(a.v - b.v) <= {delta}" if delta else "a.v = b.v"
    at = [f"((a.{n} + o.d{n}) % {s} + {s}) % {s}" if periodic else f"a.{n} + o.d{n}" for n, s in zip("xyz", (grid.sx, grid.sy, grid.sz), strict=True)]
    return f"""WITH RECURSIVE cells AS (SELECT x, y, z, v, {_lin(grid)} AS id FROM ({cells})),
o AS (SELECT * FROM {_values(offsets(connectivity, grid.ndim))} t(dx, dy, dz)),
edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM cells a, o, cells b WHERE b.x = {at[0]} AND b.y = {at[1]} AND b.z = {at[2]} AND {match} AND a.id <> b.id),
spread(id, low) USING KEY (id) AS (SELECT id, id FROM cells UNION
 SELECT e.b, min(s.low) FROM spread s JOIN edges e ON e.a = s.id JOIN recurring.spread r ON r.id = e.b WHERE s.low < r.low GROUP BY e.b),
lab AS (SELECT c.x, c.y, c.z, c.v, dense_rank() OVER (ORDER BY s.low) AS label FROM cells c JOIN spread s USING (id))
"""


def _run_labels_sql(cells: str, grid: Grid, connectivity: int) -> str:
    """As _labels_sql(), for equal values and with runs along x as nodes: far fewer steps where regions are large."""
    steps = [(sign * dy, sign * dz, s) for (dy, dz), s in row_offsets(connectivity, grid.ndim).items() for sign in (1, -1)]
    return f"""WITH RECURSIVE cells AS ({cells}),
marked AS (SELECT *, {_lin(grid)} AS lin, x - row_number() OVER (PARTITION BY v, y, z ORDER BY x) AS island FROM cells),
runs AS MATERIALIZED (SELECT v, y, z, island, min(x) AS x1, max(x) AS x2, min(lin) AS id FROM marked GROUP BY v, y, z, island),
o AS (SELECT * FROM {_values(steps)} t(dy, dz, s)),
edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM runs a, o, runs b WHERE b.y = a.y + o.dy AND b.z = a.z + o.dz AND b.v = a.v AND a.x1 <= b.x2 + o.s AND b.x1 <= a.x2 + o.s),
spread(id, low) USING KEY (id) AS (SELECT id, id FROM runs UNION
 SELECT e.b, min(s.low) FROM spread s JOIN edges e ON e.a = s.id JOIN recurring.spread r ON r.id = e.b WHERE s.low < r.low GROUP BY e.b),
lab AS (SELECT c.x, c.y, c.z, c.v, dense_rank() OVER (ORDER BY s.low) AS label FROM marked c JOIN runs r USING (v, y, z, island) JOIN spread s ON s.id = r.id)
"""


def _ccl(source: str, connectivity: int, order: str = "F", **mode) -> tuple[Query, str]:
    read, sql, grid = _source(source)
    grid = replace(grid, order=order)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells, _ = read(spark, sf_dir)
        return label.connected_components(cells, grid, connectivity, delta=mode.get("delta", 0), periodic_boundary=mode.get("periodic", False), binary_image=mode.get("binary", False))

    labels = _labels_sql(sql, grid, connectivity, **mode) if mode else _run_labels_sql(sql, grid, connectivity)
    return query, labels + "SELECT x, y, z, label FROM lab"


def _on_labels(source: str, connectivity: int, run: Callable[[DataFrame, Grid], DataFrame], select: str, **mode) -> tuple[Query, str]:
    """A query that takes the cells, and SQL over `lab`."""
    read, sql, grid = _source(source)
    return (lambda s, d: run(read(s, d)[0], grid)), _labels_sql(sql, grid, connectivity, **mode) + select


def _on_cells(source: str, run: Callable[[DataFrame, Grid], DataFrame], select: Callable[[Grid], str]) -> tuple[Query, str]:
    read, sql, grid = _source(source)
    return (lambda s, d: run(read(s, d)[0], grid)), f"WITH cells AS ({sql}) " + select(grid)


_DENSE = "dense AS (SELECT CAST(i % {sx} AS INT) AS x, CAST(i // {sx} % {sy} AS INT) AS y, CAST(i // {sxy} % {sz} AS INT) AS z FROM range({n}) r(i)), full_ AS (SELECT x, y, z, coalesce(v, 0) AS v FROM dense LEFT JOIN cells USING (x, y, z))"


def _dense(grid: Grid) -> str:
    return _DENSE.format(sx=grid.sx, sy=grid.sy, sxy=grid.sx * grid.sy, sz=grid.sz, n=grid.cells)


def _stats_sql(source: str, label_: str = "v", half_open: bool = True) -> str:
    more = " + 1" if half_open else ""
    boxes = ", ".join(f"CAST(min({n}) AS INT) AS {n}min, CAST(max({n}){more} AS INT) AS {n}max" for n in "xyz")
    means = ", ".join(f"avg(CAST({n} AS DOUBLE)) AS c{n}" for n in "xyz")
    return f"SELECT CAST({label_} AS BIGINT) AS label, count(*) AS voxel_counts, {boxes}, {means} FROM {source} GROUP BY 1"


def _contacts_sql(grid: Grid, connectivity: int, value: str, weights: tuple[float, float, float] = (1, 1, 1)) -> str:
    wx, wy, wz = weights

    def area(o: tuple[int, int, int]) -> float:
        if sum(map(abs, o)) > 1:
            return 0.0
        return float((wy if o[0] else wx) if grid.ndim < 3 else (wy * wz if o[0] else wx * wz if o[1] else wx * wy))

    steps = _values([(*o, area(o)) for o in half_offsets(connectivity, grid.ndim)])
    return f"""SELECT CAST(least(a.v, b.v) AS BIGINT) AS label_1, CAST(greatest(a.v, b.v) AS BIGINT) AS label_2{value}
FROM cells a, (SELECT * FROM {steps} t(dx, dy, dz, area)) o, cells b
WHERE b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz AND a.v <> b.v GROUP BY 1, 2"""


def _bits_sql(grid: Grid, connectivity: int) -> str:
    order = BITS_2D if connectivity in (4, 8) and grid.ndim < 3 else BITS_3D
    reach = set(offsets(connectivity, 2 if connectivity in (4, 8) else 3))
    steps = [(*o, 1 << i) for i, o in enumerate(order) if o in reach]
    return f""", {_dense(grid)}, o AS (SELECT * FROM {_values(steps)} t(dx, dy, dz, b))
SELECT a.x, a.y, a.z, CAST(sum(CASE WHEN n.v IS NULL OR n.v = a.v THEN o.b ELSE 0 END) AS INT) AS bits
FROM full_ a CROSS JOIN o LEFT JOIN full_ n ON n.x = a.x + o.dx AND n.y = a.y + o.dy AND n.z = a.z + o.dz GROUP BY ALL"""


def _runs_sql(grid: Grid, column: str = "v") -> str:
    return f"""SELECT CAST({column} AS BIGINT) AS label, min(lin) AS start, max(lin) + 1 AS "end" FROM
(SELECT *, lin - row_number() OVER (PARTITION BY {column} ORDER BY lin) AS island FROM (SELECT *, {_lin(grid)} AS lin FROM cells)) GROUP BY {column}, island"""


def _drawn(cells: DataFrame, grid: Grid) -> DataFrame:
    flat = runs.flat_runs(cells.withColumnRenamed("v", "label"), grid)
    return runs.draw(flat.filter("label <= 2"), grid, cells.withColumnRenamed("v", "label"), 9).select("x", "y", "z", F.col("label").cast("int").alias("v"))


def _overlapping(cells: DataFrame, grid: Grid) -> DataFrame:
    """A run of seven cells from each cell on, those of larger labels over the others."""
    at = grid.lin()
    return runs.draw(cells.select(F.col("v").alias("label"), at.alias("start"), F.least(at + 7, F.lit(grid.cells)).alias("end")), grid)


def _overlapping_sql(grid: Grid) -> str:
    x, y, z = (f"CAST(place // {s} % {size} AS INT) AS {n}" for n, s, size in zip("xyz", grid.strides, (grid.sx, grid.sy, grid.sz), strict=True))
    return f"SELECT {x}, {y}, {z}, CAST(max(v) AS BIGINT) AS label FROM (SELECT v, unnest(range({_lin(grid)}, least({_lin(grid)} + 7, {grid.cells}))) AS place FROM cells) GROUP BY place"


def _erased(cells: DataFrame, grid: Grid) -> DataFrame:
    image = cells.withColumnRenamed("v", "label")
    return runs.erase(runs.flat_runs(image, grid).filter("label = 1"), grid, image).withColumnRenamed("label", "v")


def _stacked(connectivity: int) -> tuple[Query, str]:
    def run(cells: DataFrame, grid: Grid) -> DataFrame:
        slabs = []
        for at in range(0, grid.sz, 21):
            slabs.append((cells.filter(f"z >= {at} and z < {at + 21}").withColumn("z", F.col("z") - at), 21))
        return label.connected_components_stack(slabs, grid, connectivity)

    return _on_labels("lineitem:5", connectivity, run, "SELECT x, y, z, label FROM lab")


def _stored(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells written as one array file in the shared folder, and read again by ranges of bytes."""
    path = f"{scratch_folder(cells.sparkSession).removeprefix('file://')}-{uuid.uuid4().hex}.npy"
    raw.write_array(cells, grid, path, "int32", column="v")
    return raw.read_array(cells.sparkSession, f"file://{path}")[0]


def _streamed(connectivity: int) -> tuple[Query, str]:
    """Labels of cells that arrive as a stream of files."""
    read, sql, grid = _source("lineitem:5")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells, folder = read(spark, sf_dir)[0], f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
        cells.repartitionByRange(4, "z").write.parquet(f"{folder}/cells")
        volume = SlabLabels(spark, f"{folder}/volume", grid, connectivity)
        stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/cells")
        volume.writer(stream).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return volume.labels()

    return query, _run_labels_sql(sql, grid, connectivity) + "SELECT x, y, z, label FROM lab"


def _closed(cells: DataFrame, grid: Grid, depth: int = 21) -> FrontierLabels:
    """The components of the cells, given out as slabs of some planes come in."""
    volume = FrontierLabels(cells.sparkSession, f"{scratch_folder(cells.sparkSession)}/frontier-{uuid.uuid4().hex}", grid, 6)
    batches = range(-(-grid.sz // depth))
    for i in batches:
        volume.add(cells.filter(F.col("z").between(depth * i, depth * i + depth - 1)), i)
    volume.finish(len(batches))
    return volume


def _closed_statistics(cells: DataFrame, grid: Grid) -> DataFrame:
    found = written(_closed(cells, grid).statistics(), "closed")
    return found.join(label.dense_labels(found, "first"), "first").drop("first")


def _closed_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    volume = _closed(cells, grid)
    return volume.finished().join(label.dense_labels(volume.statistics(), "first"), "first").drop("first")


def _returned_count(cells: DataFrame, grid: Grid) -> DataFrame:
    n = label.connected_components(cells, grid, 18, return_N=True)[1]
    return cells.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"))


def _absent(cells: DataFrame, grid: Grid) -> DataFrame:
    """Statistics where two of three labels don't occur."""
    out = stats.statistics(cells.select("x", "y", "z", (F.col("v") * 3).alias("label")), grid, no_slice_conversion=True)
    return out.select("label", "voxel_counts", *[F.coalesce(n, F.lit(-1)).alias(n) for n in stats.BOXES], F.isnan("cx").alias("absent"))


def _absent_sql(grid: Grid) -> str:
    boxes = ", ".join(f"coalesce({n}, -1) AS {n}" for n in stats.BOXES)
    return f"""SELECT * FROM (WITH {_dense(grid)}, found AS ({_stats_sql("full_", "v * 3", False)}), every AS (SELECT i AS label FROM range((SELECT max(label) + 1 FROM found)) r(i))
SELECT every.label, coalesce(voxel_counts, 0) AS voxel_counts, {boxes}, found.label IS NULL AS absent FROM every LEFT JOIN found ON found.label = every.label)"""


def _count(source: str, connectivity: int) -> tuple[Query, str]:
    def run(cells: DataFrame, grid: Grid) -> DataFrame:
        return label.connected_components(cells, grid, connectivity).agg(F.coalesce(F.max("label"), F.lit(0)).alias("n"))

    return _on_labels(source, connectivity, run, "SELECT coalesce(max(label), 0) AS n FROM lab")


def _statistics(cells: DataFrame, grid: Grid) -> DataFrame:
    return stats.label_statistics(label.connected_components(cells, grid, 6 if grid.ndim == 3 else 8))


def _background(cells: DataFrame, grid: Grid) -> DataFrame:
    return stats.statistics(cells.withColumnRenamed("v", "label"), grid)


def _colored(source: str, connectivity: int, field: int, wide: bool | None = None) -> tuple[Query, str]:
    """Components of the field of `field` connectivity; in SQL, labels of all cells, background included."""
    read, sql, grid = _source(source)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bits.color_connectivity_graph(bits.voxel_connectivity_graph(read(spark, sf_dir)[0], grid, field), grid, connectivity, wide=wide)

    dense = f"WITH cells AS ({sql}), {_dense(grid)} SELECT x, y, z, v FROM full_"
    return query, _run_labels_sql(dense, grid, connectivity) + "SELECT x, y, z, label FROM lab"


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    out["grid3d"] = _on_cells("lineitem:5", lambda c, g: c, lambda g: "SELECT * FROM cells")
    out["grid_dense"] = _on_cells("lineitem:5", lambda c, g: densify(c, g), lambda g: f"SELECT * FROM (WITH {_dense(g)} SELECT * FROM full_)")
    out["grid_runs"] = _on_cells(
        "lineitem:5",
        lambda c, g: runs.x_runs(c, g).select("v", "y", "z", "x1", "x2"),
        lambda g: "SELECT v, y, z, min(x) AS x1, max(x) AS x2 FROM (SELECT *, x - row_number() OVER (PARTITION BY v, y, z ORDER BY x) AS island FROM cells) GROUP BY v, y, z, island",
    )
    out["estimate_labels"] = _on_cells(
        "lineitem:5",
        lambda c, g: runs.estimate_provisional_labels(c, g),
        lambda g: f"SELECT count(*) FILTER (WHERE before IS DISTINCT FROM v OR gap > 1) AS epl, min(y + {g.sy} * CAST(z AS BIGINT)) AS first_row, max(y + {g.sy} * CAST(z AS BIGINT)) AS last_row FROM (SELECT *, lag(v) OVER w AS before, x - lag(x) OVER w AS gap FROM cells WINDOW w AS (PARTITION BY y, z ORDER BY x))",
    )
    out["foreground_index"] = _on_cells("event:3", lambda c, g: runs.row_bounds(c).withColumnRenamed("end", "stop"), lambda g: "SELECT y, z, min(x) AS start, CAST(max(x) + 1 AS INT) AS stop FROM cells GROUP BY y, z")
    for c in (6, 18, 26):
        out[f"ccl_{c}"] = _ccl("lineitem:5", c)
        out[f"ccl_binary_{c}"] = _ccl("lineitem:5", c, binary=True)
    out["ccl_6_rows_first"] = _ccl("lineitem:5", 6, order="C")
    for c in (4, 8):
        out[f"ccl_{c}"] = _ccl("event:3", c)
        out[f"ccl_binary_{c}"] = _ccl("event:3", c, binary=True)
        out[f"ccl_periodic_{c}"] = _ccl("event:3", c, periodic=True)
        out[f"ccl_continuous_{c}"] = _ccl("event:9", c, delta=1)
    out["ccl_periodic_6"] = _ccl("lineitem:5", 6, periodic=True)
    out["ccl_periodic_binary_6"] = _ccl("lineitem:5", 6, periodic=True, binary=True)
    for c in (6, 18, 26):
        out[f"ccl_continuous_{c}"] = _ccl("lineitem:9", c, delta=1)
    out["ccl_continuous_float"] = (lambda s, d: label.connected_components(*embedding_grid(s, d), 4, delta=0.02)), None
    out["component_count"] = _count("lineitem:5", 26)
    out["returned_count"] = _on_labels("lineitem:5", 18, _returned_count, "SELECT coalesce(max(label), 0) AS n FROM lab")
    out["statistics_3d"] = _on_labels("lineitem:5", 6, _statistics, _stats_sql("lab", "label", False))
    out["statistics_2d"] = _on_labels("event:3", 8, _statistics, _stats_sql("lab", "label", False))
    out["statistics_background"] = _on_cells("lineitem:5", _background, lambda g: f"SELECT * FROM (WITH {_dense(g)} {_stats_sql('full_')})")
    out["statistics_absent"] = _on_cells("event:3", _absent, _absent_sql)
    sizes = ", sizes AS (SELECT label, count(*) AS n FROM lab GROUP BY label) "
    kept = "SELECT x, y, z, v FROM lab WHERE label IN (SELECT label FROM sizes WHERE {})"
    out["dust_min"] = _on_labels("lineitem:5", 6, lambda c, g: prune.dust(c, g, 4, 6), sizes + kept.format("n >= 4"))
    out["dust_range"] = _on_labels("lineitem:5", 6, lambda c, g: prune.dust(c, g, (2, 5), 6), sizes + kept.format("n >= 2 AND n < 5"))
    out["dust_invert"] = _on_labels("lineitem:5", 6, lambda c, g: prune.dust(c, g, (2, 5), 6, invert=True), sizes + kept.format("NOT (n >= 2 AND n < 5)"))
    out["dust_precomputed"] = _on_cells(
        "event:3",
        lambda c, g: prune.dust(c, g, (1000, 4000), 8, precomputed_ccl=True),
        lambda g: "SELECT * FROM cells WHERE v IN (SELECT v FROM cells GROUP BY v HAVING count(*) >= 1000 AND count(*) < 4000)",
    )
    top = ", sizes AS (SELECT label, count(*) AS n FROM lab GROUP BY label), top AS (SELECT label AS old, row_number() OVER (ORDER BY n, label) AS label FROM (SELECT * FROM sizes ORDER BY n DESC, label LIMIT {})) SELECT x, y, z, top.label AS label FROM lab JOIN top ON lab.label = top.old"
    as_labels = lambda c: c.withColumnRenamed("v", "label")
    out["largest_k"] = _on_labels("lineitem:5", 6, lambda c, g: prune.largest_k(c, g, 10, 6), top.format(10))
    out["largest_all"] = _on_labels("lineitem:5", 6, lambda c, g: prune.largest_k(c, g, 1_000_000, 6), "SELECT x, y, z, label FROM lab")
    out["largest_none"] = _on_labels("lineitem:5", 6, lambda c, g: prune.largest_k(c, g, 0, 6), "SELECT x, y, z, label FROM lab WHERE FALSE")
    out["each_binary"] = _on_cells("event:3", lambda c, g: extract.each(as_labels(c), binary=True), lambda g: "SELECT CAST(v AS BIGINT) AS label, x, y, z, TRUE AS value FROM cells")
    out["largest_1"] = _on_labels("event:3", 8, lambda c, g: prune.largest_k(c, g, 1, 8), top.format(1))
    out["contacts_area"] = _on_cells("lineitem:5", lambda c, g: contacts.contacts(as_labels(c), g), lambda g: _contacts_sql(g, 26, ", sum(o.area) AS value").replace("o.area", "CAST(o.area AS DOUBLE)"))
    out["contacts_count"] = _on_cells("lineitem:5", lambda c, g: contacts.contacts(as_labels(c), g, 18, surface_area=False), lambda g: _contacts_sql(g, 18, ", CAST(count(*) AS DOUBLE) AS value"))
    out["contacts_anisotropic"] = _on_cells(
        "lineitem:5",
        lambda c, g: contacts.contacts(as_labels(c), g, 6, anisotropy=(4, 4, 40)),
        lambda g: _contacts_sql(g, 6, ", sum(CAST(o.area AS DOUBLE)) AS value", (4, 4, 40)),
    )
    out["contacts_2d"] = _on_cells("event:3", lambda c, g: contacts.contacts(as_labels(c), g, 8, anisotropy=(2, 3)), lambda g: _contacts_sql(g, 8, ", sum(CAST(o.area AS DOUBLE)) AS value", (2, 3, 1)))
    out["region_graph"] = _on_cells("lineitem:9", lambda c, g: contacts.region_graph(as_labels(c), g), lambda g: _contacts_sql(g, 26, ""))
    for c in (4, 8):
        out[f"vcg_{c}"] = _on_cells("event:3", lambda t, g, c=c: bits.voxel_connectivity_graph(t, g, c), lambda g, c=c: f"SELECT * FROM (WITH {_bits_sql(g, c)[2:]})")
    for c in (6, 18, 26):
        out[f"vcg_{c}"] = _on_cells("lineitem:5", lambda t, g, c=c: bits.voxel_connectivity_graph(t, g, c), lambda g, c=c: f"SELECT * FROM (WITH {_bits_sql(g, c)[2:]})")
    out["vcg_estimate"] = _on_cells(
        "lineitem:5",
        lambda c, g: bits.estimate_graph_labels(bits.voxel_connectivity_graph(c, g, 6), g),
        lambda g: f"SELECT {g.sy * g.sz} + count(*) AS epl FROM (WITH {_dense(g)} SELECT v, lag(v) OVER (PARTITION BY y, z ORDER BY x) AS before FROM full_) WHERE before <> v",
    )
    out["color_4"] = _colored("event:3", 4, 4)
    out["color_8"] = _colored("event:3", 8, 8)
    out["color_8_wide"] = _colored("event:3", 8, 26, wide=True)
    out["color_6"] = _colored("lineitem:5", 6, 6)
    out["color_26"] = _colored("lineitem:5", 26, 26)
    out["runs_flat"] = _on_cells("lineitem:5", lambda c, g: runs.flat_runs(as_labels(c), g).withColumnRenamed("end", "stop"), lambda g: _runs_sql(g).replace('"end"', "stop"))
    out["each_label"] = _on_cells("lineitem:5", lambda c, g: extract.each(as_labels(c)), lambda g: "SELECT CAST(v AS BIGINT) AS label, x, y, z, CAST(v AS BIGINT) AS value FROM cells")
    boxes = ", ".join(f"CAST({f}({n}) AS INT) AS {n}{f}" for n in "xyz" for f in ("min", "max"))
    out["each_index"] = _on_cells("lineitem:5", lambda c, g: extract.ComponentIndex(as_labels(c)).labels(), lambda g: f"SELECT CAST(v AS BIGINT) AS label, count(*) AS voxel_counts, {boxes} FROM cells GROUP BY v")
    out["each_image"] = _on_cells("event:3", lambda c, g: extract.ComponentIndex(as_labels(c)).image(2), lambda g: "SELECT x, y, z FROM cells WHERE v = 2")
    out["stored_array"] = _on_cells("lineitem:5", _stored, lambda g: "SELECT x, y, z, CAST(v AS BIGINT) AS v FROM cells")
    out["draw_overlaps"] = _on_cells("lineitem:5", _overlapping, _overlapping_sql)
    out["draw_runs"] = _on_cells("lineitem:5", _drawn, lambda g: "SELECT x, y, z, CAST(CASE WHEN v <= 2 THEN 9 ELSE v END AS INT) AS v FROM cells")
    out["erase_runs"] = _on_cells("lineitem:5", _erased, lambda g: "SELECT * FROM cells WHERE v <> 1")
    out["stack_6"] = _stacked(6)
    out["stack_26"] = _stacked(26)
    out["stream_18"] = _streamed(18)
    out["stream_closed"] = _on_labels("lineitem:5", 6, _closed_statistics, _stats_sql("lab", "label", False))
    out["stream_finished"] = _on_labels("lineitem:5", 6, _closed_cells, "SELECT x, y, z, label FROM lab")
    return out


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}

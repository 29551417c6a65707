"""Queries of rays, tracing and shadows (R)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import levels, rays, stacked, tiles, trace
from ..storage import scratch_path, whole_batches, written
from . import terrain
from .registry import query, r3, r3_sql, table
from .terrain import CELLS_SQL, GRID

K = rays.CURVATURE
#: One small view for each supplier, above the ground and looking down.
WIDTH, HEIGHT, RANGE = 12, 6, 300.0
EL0, EL1 = math.radians(-5), math.radians(-85)


def views(spark, sf):
    n = terrain.side(spark, sf)
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("view_id"), (2600000.0 + (key * 37 % (n - 2)) * 10 + 3.7).alias("x"), (1200000.0 - (key * 53 % (n - 2)) * 10 - 4.3).alias("y"),
        (2150.0 + (key % 5) * 20).alias("z"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(0.05).alias("az0"), F.lit(0.05 + 2 * math.pi).alias("az1"),
        F.lit(EL0).alias("el0"), F.lit(EL1).alias("el1"), F.lit(RANGE).alias("tmax"))


VIEWS_SQL = """vw AS (SELECT s_suppkey AS view_id, 2600000.0::DOUBLE + (s_suppkey * 37 % (n - 2)) * 10 + 3.7::DOUBLE AS x,
  1200000.0::DOUBLE - (s_suppkey * 53 % (n - 2)) * 10 - 4.3::DOUBLE AS y, 2150.0::DOUBLE + (s_suppkey % 5) * 20 AS z FROM supplier, g)"""
RAYS_SQL = VIEWS_SQL + f""",
ry AS MATERIALIZED (SELECT view_id, px, py, x, y, z, sin(0.05 + (px + 0.5) * 2 * pi() / {WIDTH}) AS dx, cos(0.05 + (px + 0.5) * 2 * pi() / {WIDTH}) AS dy,
  tan({EL0!r} + (py + 0.5) * ({EL1!r} - {EL0!r}) / {HEIGHT}) AS slope FROM vw, range({WIDTH}) a(px), range({HEIGHT}) b(py))"""


@query("r1_angular_rays", f"WITH {terrain.GRID_SQL}, {RAYS_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('dx')} AS dx, {r3_sql('dy')} AS dy, {r3_sql('slope')} AS slope FROM ry")
def angular_rays(spark, sf):
    return rays.angular_rays(views(spark, sf)).select("view_id", "px", "py", r3(F.col("dx")).alias("dx"), r3(F.col("dy")).alias("dy"), r3(F.col("slope")).alias("slope"))


def cameras(spark, sf):
    key = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(key.alias("view_id"), F.lit(9).alias("width"), F.lit(5).alias("height"), (key * 0.37).alias("heading"),
                                               ((key % 7 - 3) * 0.1).alias("pitch"), ((key % 3 - 1) * 0.05).alias("roll"), (0.5 + (key % 4) * 0.3).alias("fov"))
    f = rays.intrinsics_from_fov(F.col("height"), F.col("fov"))
    return base.withColumns({"fx": f, "fy": f, "cx": F.col("width") / 2, "cy": F.col("height") / 2})


CAMERAS_SQL = """cam AS (SELECT *, 0.5 * 5 / tan(0.5 * fov) AS f FROM (SELECT s_suppkey AS view_id, s_suppkey * 0.37::DOUBLE AS h, (s_suppkey % 7 - 3) * 0.1::DOUBLE AS p,
  (s_suppkey % 3 - 1) * 0.05::DOUBLE AS r, 0.5::DOUBLE + (s_suppkey % 4) * 0.3::DOUBLE AS fov FROM supplier)),
pix AS (SELECT view_id, px, py, cos(p) * sin(h) + u * (cos(r) * cos(h) - sin(r) * sin(p) * sin(h)) - v * (-sin(r) * cos(h) - cos(r) * sin(p) * sin(h)) AS e,
  cos(p) * cos(h) + u * (-cos(r) * sin(h) - sin(r) * sin(p) * cos(h)) - v * (sin(r) * sin(h) - cos(r) * sin(p) * cos(h)) AS no,
  sin(p) + u * sin(r) * cos(p) - v * cos(r) * cos(p) AS up
  FROM (SELECT cam.*, px, py, (px + 0.5 - 4.5) / f AS u, (py + 0.5 - 2.5) / f AS v FROM cam, range(9) a(px), range(5) b(py)))"""


@query("r2_camera_rays", f"WITH {CAMERAS_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('e / sqrt(e*e + no*no)')} AS dx, {r3_sql('no / sqrt(e*e + no*no)')} AS dy, {r3_sql('up / sqrt(e*e + no*no)')} AS slope FROM pix")
def camera_rays(spark, sf):
    return rays.camera_rays(cameras(spark, sf)).select("view_id", "px", "py", r3(F.col("dx")).alias("dx"), r3(F.col("dy")).alias("dy"), r3(F.col("slope")).alias("slope"))


def distorted_sql(u: str, v: str, k1: str = "0.05") -> tuple[str, str, str]:
    """(radial, tangential u, tangential v) of the test lens, as SQL."""
    r2 = f"({u} * {u} + {v} * {v})"
    return (f"(1 + {r2} * ({k1} + {r2} * (-0.01 + {r2} * 0.001)))", f"(0.004 * {u} * {v} - 0.001 * ({r2} + 2 * {u} * {u}))", f"(0.002 * ({r2} + 2 * {v} * {v}) - 0.002 * {u} * {v})")


def undistort_sql() -> str:
    """Points made from keys, 32 fixed-point steps for each, and what those still miss."""
    radial, tu, tv = distorted_sql("u", "v")
    miss = f"sqrt(power(u * {radial} + {tu} - px, 2) + power(v * {radial} + {tv} - py, 2))"
    return f"""WITH RECURSIVE st(c_custkey, px, py, k, u, v) AS (
  SELECT c_custkey, px, py, 0, px, py FROM (SELECT c_custkey, (c_custkey % 21 - 10)::DOUBLE / 8 AS px, (c_custkey % 13 - 6)::DOUBLE / 6 AS py FROM customer)
  UNION ALL SELECT c_custkey, px, py, k + 1, CASE WHEN abs({radial}) >= 1e-12 THEN (px - {tu}) / {radial} END, CASE WHEN abs({radial}) >= 1e-12 THEN (py - {tv}) / {radial} END FROM st WHERE k < 32),
d AS (SELECT *, {miss} <= 2e-6 * (1 + sqrt(px * px + py * py)) AS ok FROM st WHERE k = 32)
SELECT c_custkey, px, py, CASE WHEN ok THEN round(u, 5) END AS x, CASE WHEN ok THEN round(v, 5) END AS y FROM d"""


@query("r3_undistort", undistort_sql())
def undistort(spark, sf):
    """Points made from keys, some far out, and where an undistorted ray meets the image plane."""
    px, py = ((F.col("c_custkey") % 21 - 10) / 8).cast("double"), ((F.col("c_custkey") % 13 - 6) / 6).cast("double")
    lens = [F.lit(x) for x in (0.05, -0.01, 0.001, 0.002, -0.001)]
    points = table(spark, sf, "customer").select("c_custkey", px.alias("px"), py.alias("py"))
    at = points.withColumn("at", rays.undistort(F.col("px"), F.col("py"), *lens))
    return at.select("c_custkey", "px", "py", F.round("at.x", 5).alias("x"), F.round("at.y", 5).alias("y"))


def lens_rays_sql() -> str:
    """The views of CAMERAS_SQL seen through lenses, some too strong to be undone; those views go."""
    radial, tu, tv = distorted_sql("u", "v", "k1")
    miss = f"sqrt(power(u * {radial} + {tu} - u0, 2) + power(v * {radial} + {tv} - v0, 2))"
    start, rest = CAMERAS_SQL.split("pix AS", 1)
    seen = rest[: rest.index("FROM (SELECT cam")]
    return f"""WITH RECURSIVE {start}
st(view_id, px, py, u0, v0, k1, k, u, v) AS (SELECT *, 0, u0, v0 FROM (
    SELECT view_id, px, py, (px + 0.5 - 4.5)::DOUBLE / f AS u0, (py + 0.5 - 2.5)::DOUBLE / f AS v0, CASE WHEN view_id % 5 = 0 THEN -0.6 ELSE 0.05 END::DOUBLE AS k1 FROM cam, range(9) a(px), range(5) b(py))
  UNION ALL SELECT view_id, px, py, u0, v0, k1, k + 1, CASE WHEN abs({radial}) >= 1e-12 THEN (u0 - {tu}) / {radial} END, CASE WHEN abs({radial}) >= 1e-12 THEN (v0 - {tv}) / {radial} END FROM st WHERE k < 32),
d AS (SELECT *, coalesce({miss} <= 2e-6 * (1 + sqrt(u0 * u0 + v0 * v0)), false) AS ok FROM st WHERE k = 32),
pix AS {seen} FROM (SELECT d.*, h, p, r FROM d JOIN cam ON cam.view_id = d.view_id WHERE d.view_id NOT IN (SELECT view_id FROM d WHERE NOT ok)))
SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('e / sqrt(e*e + no*no)')} AS dx, {r3_sql('no / sqrt(e*e + no*no)')} AS dy, {r3_sql('up / sqrt(e*e + no*no)')} AS slope FROM pix"""


@query("r2_lens_rays", lens_rays_sql())
def lens_rays(spark, sf):
    """Rays through lenses; a view with a pixel that has no undistorted place goes."""
    lens = {"k1": F.when(F.col("view_id") % 5 == 0, -0.6).otherwise(0.05), "k2": F.lit(-0.01), "k3": F.lit(0.001), "p1": F.lit(0.002), "p2": F.lit(-0.001)}
    found = rays.without_bad_views(rays.camera_rays(cameras(spark, sf).withColumns(lens)))
    return found.select("view_id", "px", "py", r3(F.col("dx")).alias("dx"), r3(F.col("dy")).alias("dy"), r3(F.col("slope")).alias("slope"))


@query("r4_intrinsics", f"WITH {CAMERAS_SQL} SELECT view_id, {r3_sql('f')} AS focal FROM cam")
def intrinsics(spark, sf):
    return cameras(spark, sf).select("view_id", r3(F.col("fx")).alias("focal"))


FOOT_SQL = CAMERAS_SQL + """,
un AS (SELECT view_id, px, py, e / w AS e, no / w AS no, up / w AS up FROM (SELECT *, sqrt(e * e + no * no + up * up) AS w FROM pix)),
foot AS (SELECT a.view_id, min(2 * asin(sqrt(power(a.e - b.e, 2) + power(a.no - b.no, 2) + power(a.up - b.up, 2)) / 2)) AS footprint FROM un a JOIN un b
  ON a.view_id = b.view_id AND ((a.px + 1 = b.px AND a.py = b.py) OR (a.px = b.px AND a.py + 1 = b.py)) GROUP BY 1)"""


@query("r5_pixel_footprint", f"WITH {FOOT_SQL} SELECT view_id, floor(footprint * 1000000 + 0.37) / 1000000 AS footprint FROM foot")
def footprint(spark, sf):
    return rays.pixel_footprint(rays.camera_rays(cameras(spark, sf))).select("view_id", (F.floor(F.col("footprint") * 1e6 + 0.37) / 1e6).alias("footprint"))


@query("r6_select_lod", """SELECT c_custkey AS id, 1 + (SELECT count(*) FROM range(2, 6) t(k) WHERE 1.5 * c_custkey * 1.7 * 0.01 / 10 >= power(2.0, k - 1) * (1 + 4 * power(2.0, -23)))::INT AS lod FROM customer""")
def select_lod(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), rays.select_lod(F.col("c_custkey") * 1.7, F.lit(0.01), F.lit(10.0), 5, 1.5).alias("lod"))


def crossing_sql(step: float, cte: str, src: str, keys: str, x: str, y: str) -> str:
    """Flat crossings of rays with grid lines, as windows over a union."""
    return f"""{cte}_t AS (SELECT {keys}, 0.0::DOUBLE AS t FROM {src} UNION ALL SELECT {keys}, {RANGE}::DOUBLE FROM {src}
  UNION ALL SELECT {keys}, t FROM (SELECT {keys}, (k * {step} - ({x})) / dx AS t FROM {src}, range(-{int(RANGE / step) + 2}, {int(RANGE / step) + 3}) r(j), LATERAL (SELECT floor(({x}) / {step}) + j AS k)) WHERE t > 0 AND t < {RANGE}
  UNION ALL SELECT {keys}, t FROM (SELECT {keys}, (k * {step} - ({y})) / dy AS t FROM {src}, range(-{int(RANGE / step) + 2}, {int(RANGE / step) + 3}) r(j), LATERAL (SELECT floor(({y}) / {step}) + j AS k)) WHERE t > 0 AND t < {RANGE}),
{cte} AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS t1 FROM {cte}_t) WHERE t1 - t > 1e-9)"""


COLS_SQL = f"cl AS (SELECT DISTINCT view_id, px, x, y, z, dx, dy FROM ry), {crossing_sql(160.0, 'tp', 'cl', 'view_id, px, x, y, z, dx, dy', 'x - 2600000.0', 'y - 1200000.0')}, tk AS (SELECT *, floor((x - 2600000.0 + dx * (t + t1) / 2) / 160)::BIGINT AS tcol, floor(-(y - 1200000.0 + dy * (t + t1) / 2) / 160)::BIGINT AS trow FROM tp)"


@query("r7_tile_path", f"WITH {terrain.GRID_SQL}, {RAYS_SQL}, {COLS_SQL} SELECT view_id, px::INT AS px, {r3_sql('t')} AS t0, {r3_sql('t1')} AS t1, trow, tcol FROM tk")
def tile_path(spark, sf):
    found = trace.tile_path(rays.angular_columns(views(spark, sf)), GRID)
    return found.select("view_id", "px", r3(F.col("t0")).alias("t0"), r3(F.col("t1")).alias("t1"), "trow", "tcol")


#: Where a session has its ground stored, by the folder of tables it is made from: it is prepared once and traced many times.
_STORED: dict[tuple[str, str], str] = {}


def prepared(spark, sf):
    """(cells, index by tile), made of the tiles' heights, which are stored once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = scratch_path(spark, "terrain")
        with whole_batches(spark):
            terrain.tiles_by_folder(spark, sf).write.parquet(path)
        _STORED[key] = path
    index = spark.read.parquet(_STORED[key])
    return tiles.cells_of(index, GRID.cells), index


LOW_SQL = f"z + slope * least(greatest(-slope / (2 * {K!r}), t), t1) + {K!r} * power(least(greatest(-slope / (2 * {K!r}), t), t1), 2)"


@query("r8_cull_tiles", f"""WITH {CELLS_SQL}, {RAYS_SQL}, {COLS_SQL}, mf AS (SELECT trow, tcol, max(zmax) AS tile_max FROM c GROUP BY 1, 2)
SELECT tk.view_id, tk.px::INT AS px, tk.trow, tk.tcol FROM (SELECT *, -0.2::DOUBLE AS slope FROM tk) tk JOIN mf ON tk.trow = mf.trow AND tk.tcol = mf.tcol WHERE {LOW_SQL} <= tile_max + 1""")
def cull_tiles(spark, sf):
    _, manifest = prepared(spark, sf)
    found = trace.cull_tiles(trace.tile_path(rays.angular_columns(views(spark, sf)), GRID), manifest, F.lit(-0.2))
    return found.select("view_id", "px", "trow", "tcol")


#: A panorama for each nation, from the horizon's upper side down, over 600 km and so over the whole square.
FAR_WIDTH, FAR_HEIGHT, FAR_RANGE = 24, 16, 600000.0
FAR_EL0, FAR_EL1 = math.radians(20), math.radians(-20)
#: Shares of that range after which a panorama goes on with what it has not hit yet: 120 and 600 m.
FAR_BANDS = (0.0002, 0.001)


def far_views(spark, sf):
    n = terrain.side(spark, sf)
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf, "nation").select(
        key.alias("view_id"), (2600000.0 + (key * 37 % (n - 2)) * 10 + 3.7).alias("x"), (1200000.0 - (key * 53 % (n - 2)) * 10 - 4.3).alias("y"),
        (2120.0 + (key % 5) * 20).alias("z"), F.lit(FAR_WIDTH).alias("width"), F.lit(FAR_HEIGHT).alias("height"), F.lit(0.05).alias("az0"), F.lit(0.05 + 2 * math.pi).alias("az1"),
        F.lit(FAR_EL0).alias("el0"), F.lit(FAR_EL1).alias("el1"), F.lit(FAR_RANGE).alias("tmax"))


FAR_RAYS_SQL = f"""vw AS (SELECT n_nationkey::BIGINT AS view_id, 2600000.0::DOUBLE + (n_nationkey * 37 % (n - 2)) * 10 + 3.7::DOUBLE AS x,
  1200000.0::DOUBLE - (n_nationkey * 53 % (n - 2)) * 10 - 4.3::DOUBLE AS y, 2120.0::DOUBLE + (n_nationkey % 5) * 20 AS z, n FROM nation, g),
ry AS MATERIALIZED (SELECT view_id, px, py, x, y, z, n, sin(0.05 + (px + 0.5) * 2 * pi() / {FAR_WIDTH}) AS dx, cos(0.05 + (px + 0.5) * 2 * pi() / {FAR_WIDTH}) AS dy,
  tan({FAR_EL0!r} + (py + 0.5) * ({FAR_EL1!r} - {FAR_EL0!r}) / {FAR_HEIGHT}) AS slope FROM vw, range({FAR_WIDTH}) a(px), range({FAR_HEIGHT}) b(py))"""


def square_crossing_sql(step: int, cte: str, src: str, keys: str) -> str:
    """Crossings of rays with the grid lines of the square alone, where all the ground is; windows over a union."""
    return f"""{cte}_t AS (SELECT {keys}, 0.0::DOUBLE AS t FROM {src} UNION ALL SELECT {keys}, {FAR_RANGE}::DOUBLE FROM {src}
  UNION ALL SELECT {keys}, t FROM (SELECT {keys}, (k * {step} - (x - 2600000.0)) / dx AS t FROM {src}, LATERAL (SELECT unnest(range(0, n * 10 // {step} + 1)) AS k)) WHERE t > 0 AND t < {FAR_RANGE}
  UNION ALL SELECT {keys}, t FROM (SELECT {keys}, (-k * {step} - (y - 1200000.0)) / dy AS t FROM {src}, LATERAL (SELECT unnest(range(0, n * 10 // {step} + 1)) AS k)) WHERE t > 0 AND t < {FAR_RANGE}),
{cte} AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS t1 FROM {cte}_t) WHERE t1 - t > 1e-9)"""


STOP_SQL = f"""CASE WHEN slope * slope + 4 * {K!r} * rise < 0 THEN 0 WHEN slope > 0 THEN greatest(2 * rise / (slope + sqrt(slope * slope + 4 * {K!r} * rise)), 0)
  ELSE greatest((sqrt(slope * slope + 4 * {K!r} * rise) - slope) / (2 * {K!r}), 0) END"""


@query("r8_stop_rising", f"""WITH {CELLS_SQL}, {FAR_RAYS_SQL}, up AS (SELECT ry.*, top + 1 - z AS rise FROM ry, (SELECT max(zmax) AS top FROM c)),
st AS (SELECT *, least({FAR_RANGE}, {STOP_SQL}) AS tmax FROM up)
SELECT view_id, px::INT AS px, py::INT AS py, floor(tmax * 100 + 0.37) / 100 AS tmax FROM st WHERE tmax > 0""")
def stop_rising(spark, sf):
    """Where the rays of the panoramas are over all ground for good: upward ones end early, some at once."""
    _, index = prepared(spark, sf)
    found = trace.stop_rising(rays.angular_rays(far_views(spark, sf)), index, F.col("slope"))
    return found.select("view_id", "px", "py", (F.floor(F.col("tmax") * 100 + 0.37) / 100).alias("tmax"))


@query("r9_block_cull", f"""WITH {CELLS_SQL}, {FAR_RAYS_SQL}, cl AS (SELECT * FROM ry WHERE py = {FAR_HEIGHT - 1}), {square_crossing_sql(80, 'bp', 'cl', 'view_id, px, x, y, z, n, dx, dy, slope')},
bk AS (SELECT *, floor((x - 2600000.0 + dx * (t + t1) / 2) / 80)::BIGINT AS gx, floor(-(y - 1200000.0 + dy * (t + t1) / 2) / 80)::BIGINT AS gy FROM bp),
bm AS (SELECT tcol * 2 + x // 8 AS gx, trow * 2 + 1 - y // 8 AS gy, max(zmax) AS top FROM c GROUP BY 1, 2)
SELECT view_id, px::INT AS px, gx, gy, {r3_sql('t')} AS t0, {r3_sql('t1')} AS t1 FROM (SELECT bk.*, top FROM bk JOIN bm ON bk.gx = bm.gx AND bk.gy = bm.gy) WHERE {LOW_SQL} <= top + 1e-6""")
def block_cull(spark, sf):
    """What a panorama's columns leave to be cut at cell lines: blocks of 8 x 8 cells that their lowest ray does not fly over."""
    _, index = prepared(spark, sf)
    found = trace.pieces_of(trace.paths_of(far_views(spark, sf)), index, GRID, F.col("low_slope"), to_cells=False).filter("not over")
    mid = (F.col("t0") + F.col("t1")) / 2
    gx, gy = F.floor((F.col("x") - GRID.origin_x + F.col("dx") * mid) / 80), F.floor((GRID.origin_y - F.col("y") - F.col("dy") * mid) / 80)
    return found.select("view_id", "px", gx.alias("gx"), gy.alias("gy"), r3(F.col("t0")).alias("t0"), r3(F.col("t1")).alias("t1"))


CELL_PATH_SQL = f"""{crossing_sql(10.0, 'cp', 'ry', 'view_id, px, py, x, y, z, dx, dy, slope', 'x - 2600000.0', 'y - 1200000.0')},
ck AS (SELECT *, floor((x - 2600000.0 + dx * (t + t1) / 2) / 10)::BIGINT AS gx, floor(-(y - 1200000.0 + dy * (t + t1) / 2) / 10)::BIGINT AS gy FROM cp),
met AS MATERIALIZED (SELECT ck.*, z00, z01, z10, z11, zmax, (ck.x - 2600000.0 + dx * t) / 10 - gx AS a0, 1 + gy + (ck.y - 1200000.0 + dy * t) / 10 AS b0, dx / 10 AS a1, dy / 10 AS b1
  FROM ck JOIN c ON c.tcol = gx // 16 AND c.trow = gy // 16 AND c.x = gx % 16 AND c.y = 15 - gy % 16 WHERE gx >= 0 AND gy >= 0)"""
BILINEAR_SQL = f"""co AS (SELECT *, {K!r} - q * a1 * b1 AS qa, slope + 2 * {K!r} * t - ee * a1 - nn * b1 - q * (a0 * b1 + a1 * b0) AS qb,
  z + slope * t + {K!r} * t * t - (z00 + ee * a0 + nn * b0 + q * a0 * b0) AS qc
  FROM (SELECT *, z01 - z00 AS ee, z10 - z00 AS nn, z00 - z01 - z10 + z11 AS q FROM met)),
so AS (SELECT *, CASE WHEN abs(qa) < 1e-12 THEN CASE WHEN abs(qb) > 1e-12 THEN -qc / qb END WHEN disc < 0 THEN NULL ELSE w / qa END AS r1,
    CASE WHEN abs(qa) < 1e-12 OR disc < 0 OR w = 0 THEN NULL ELSE qc / w END AS r2
  FROM (SELECT *, -0.5 * (qb + CASE WHEN qb < 0 THEN -1 ELSE 1 END * sqrt(greatest(disc, 0))) AS w FROM (SELECT *, qb * qb - 4 * qa * qc AS disc FROM co))),
hit AS MATERIALIZED (SELECT *, t + least(CASE WHEN r1 BETWEEN -1e-6 AND t1 - t + 1e-6 THEN least(greatest(r1, 0), t1 - t) END, CASE WHEN r2 BETWEEN -1e-6 AND t1 - t + 1e-6 THEN least(greatest(r2, 0), t1 - t) END,
    CASE WHEN qc <= 0 AND qc >= -0.001 THEN 0 END) AS th FROM so),
fh AS MATERIALIZED (SELECT view_id, px, py, min(th) AS distance, arg_min(struct_pack(z00, z01, z10, z11, gx, gy), th) AS h FROM hit WHERE th IS NOT NULL GROUP BY 1, 2, 3)"""
HITS_SQL = f"""{CELLS_SQL}, {RAYS_SQL}, {CELL_PATH_SQL}, {BILINEAR_SQL}"""
FAR_PATH_SQL = square_crossing_sql(10, "cp", "ry", "view_id, px, py, x, y, z, n, dx, dy, slope") + CELL_PATH_SQL[CELL_PATH_SQL.index(",\nck AS"):]


@query("r9_cell_path", f"WITH {CELLS_SQL}, {RAYS_SQL}, {CELL_PATH_SQL} SELECT view_id, px::INT AS px, (gx // 16)::BIGINT AS tcol, (gy // 16)::BIGINT AS trow, (gx % 16)::INT AS cx, (15 - gy % 16)::INT AS cy FROM met WHERE py = 0")
def cell_path(spark, sf):
    cells, manifest = prepared(spark, sf)
    crossed = trace.cell_path(trace.tile_path(rays.angular_columns(views(spark, sf)), GRID), GRID)
    ground = cells.select("trow", "tcol", F.col("y").alias("cy"), F.col("x").alias("cx"))
    return rays.widened(crossed).join(ground, ["trow", "tcol", "cy", "cx"]).select("view_id", "px", "tcol", "trow", "cx", "cy")


@query("r10_r12_first_hits", f"""WITH {HITS_SQL} SELECT ry.view_id, ry.px::INT AS px, ry.py::INT AS py, {r3_sql('distance')} AS distance, {r3_sql(f'z + slope * distance + {K!r} * distance * distance')} AS elevation
FROM ry LEFT JOIN fh ON ry.view_id = fh.view_id AND ry.px = fh.px AND ry.py = fh.py""")
def first_hits(spark, sf):
    cells, manifest = prepared(spark, sf)
    return trace.trace(views(spark, sf), cells, manifest, GRID).select("view_id", "px", "py", r3(F.col("distance")).alias("distance"), r3(F.col("elevation")).alias("elevation"))


@query("r12_far_views", f"""WITH {CELLS_SQL}, {FAR_RAYS_SQL}, {FAR_PATH_SQL}, {BILINEAR_SQL}
SELECT ry.view_id, ry.px::INT AS px, ry.py::INT AS py, {r3_sql('distance')} AS distance FROM ry LEFT JOIN fh ON ry.view_id = fh.view_id AND ry.px = fh.px AND ry.py = fh.py""")
def far_hits(spark, sf):
    """Panoramas of 24 x 16 rays over the whole square, in bands; most of the upward rays end at once."""
    cells, index = prepared(spark, sf)
    found = trace.trace(far_views(spark, sf), cells, index, GRID, bands=FAR_BANDS)
    return found.select("view_id", "px", "py", r3(F.col("distance")).alias("distance"))


@query("r11_triangle_hits", f"""WITH {CELLS_SQL}, {RAYS_SQL}, {CELL_PATH_SQL},
pl AS (SELECT *, z + slope * t + {K!r} * t * t AS hh, abs(z00 - z11) < abs(z01 - z10) AS sp FROM met),
pp AS (SELECT *, CASE WHEN k = 0 THEN z00 WHEN sp THEN z00 ELSE z01 + z10 - z11 END AS base, CASE WHEN k = 0 THEN z01 - z00 ELSE z11 - z10 END AS ee,
  CASE WHEN k = 0 THEN CASE WHEN sp THEN z11 - z01 ELSE z10 - z00 END ELSE CASE WHEN sp THEN z10 - z00 ELSE z11 - z01 END END AS nn FROM pl, (SELECT unnest([0, 1]) AS k)),
rt AS (SELECT *, CASE WHEN abs(slope - ee * a1 - nn * b1) > 1e-12 THEN (base + ee * a0 + nn * b0 - hh) / (slope - ee * a1 - nn * b1) END AS r FROM pp),
ok AS (SELECT *, a0 + a1 * r AS sx, b0 + b1 * r AS sy FROM rt WHERE r >= 0),
fin AS (SELECT view_id, px, py, min(t + r) AS distance FROM ok WHERE sx BETWEEN -1e-9 AND 1 + 1e-9 AND sy BETWEEN -1e-9 AND 1 + 1e-9
  AND CASE WHEN sp THEN CASE WHEN k = 0 THEN sx - sy >= -1e-9 ELSE sx - sy <= 1e-9 END ELSE CASE WHEN k = 0 THEN sx + sy <= 1 + 1e-9 ELSE sx + sy >= 1 - 1e-9 END END GROUP BY 1, 2, 3)
SELECT ry.view_id, ry.px::INT AS px, ry.py::INT AS py, {r3_sql('distance')} AS distance FROM ry LEFT JOIN fin ON ry.view_id = fin.view_id AND ry.px = fin.px AND ry.py = fin.py""")
def triangle_hits(spark, sf):
    cells, manifest = prepared(spark, sf)
    return trace.trace(views(spark, sf), cells, manifest, GRID, "triangles").select("view_id", "px", "py", r3(F.col("distance")).alias("distance"))


def hits_with_gradients(spark, sf):
    cells, manifest = prepared(spark, sf)
    found = trace.trace(views(spark, sf), cells, manifest, GRID, keep=("z00", "z01", "z10", "z11"))
    e, n = trace.gradient_bilinear(F.col("sx"), F.col("sy"), GRID.cell)
    return written(found.filter("distance is not null").withColumns({"grad_e": e, "grad_n": n}), "hits"), cells, manifest


GRAD_SQL = f"""{HITS_SQL},
gr AS (SELECT ry.*, distance, z + slope * distance + {K!r} * distance * distance AS elevation, (x - 2600000.0 + dx * distance) / 10 - h.gx AS sx, 1 + h.gy + (y - 1200000.0 + dy * distance) / 10 AS sy, h
  FROM ry JOIN fh ON ry.view_id = fh.view_id AND ry.px = fh.px AND ry.py = fh.py),
gg AS (SELECT *, (h.z01 - h.z00 + (h.z00 - h.z01 - h.z10 + h.z11) * sy) / 10 AS grad_e, (h.z10 - h.z00 + (h.z00 - h.z01 - h.z10 + h.z11) * sx) / 10 AS grad_n FROM gr)"""


@query("r14_gradient_bilinear", f"WITH {GRAD_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('grad_e')} AS grad_e, {r3_sql('grad_n')} AS grad_n FROM gg")
def gradients(spark, sf):
    hits, _, _ = hits_with_gradients(spark, sf)
    return hits.select("view_id", "px", "py", r3(F.col("grad_e")).alias("grad_e"), r3(F.col("grad_n")).alias("grad_n"))


TRI_E = "CASE WHEN CASE WHEN abs(z00 - z11) < abs(z01 - z10) THEN sx > sy ELSE sx + sy < 1 END THEN z01 - z00 ELSE z11 - z10 END / 10"
TRI_N = "CASE WHEN CASE WHEN abs(z00 - z11) < abs(z01 - z10) THEN sx <= sy ELSE sx + sy < 1 END THEN z10 - z00 ELSE z11 - z01 END / 10"


@query("r14_gradient_triangle", f"WITH {CELLS_SQL}, u AS (SELECT *, 0.3::DOUBLE AS sx, 0.6::DOUBLE AS sy FROM c) SELECT trow, tcol, y, x, {r3_sql(TRI_E)} AS grad_e, {r3_sql(TRI_N)} AS grad_n FROM u")
def gradient_triangle(spark, sf):
    e, n = trace.gradient_triangle(F.lit(0.3), F.lit(0.6), GRID.cell)
    return terrain.cells(spark, sf).select("trow", "tcol", "y", "x", r3(e).alias("grad_e"), r3(n).alias("grad_n"))


#: Every vertex goes to the eight cells that it neighbours: one aggregation.
SMOOTH_SQL = f"""nb AS (SELECT trow, tcol, y, x, {', '.join(f"max(z) FILTER (k = '{k}') AS {k}" for k in trace.NEIGHBOURS)}
  FROM (SELECT trow, tcol, z, y - d.dy AS y, x - d.dx AS x, d.k FROM (SELECT v.*, unnest([{', '.join(f"{{'k': '{k}', 'dx': {dx}, 'dy': {dy}}}" for k, (dx, dy) in trace.NEIGHBOURS.items())}]) AS d FROM v)) GROUP BY 1, 2, 3, 4),
w AS (SELECT c.*, {', '.join(f'nb.{k}' for k in trace.NEIGHBOURS)} FROM c LEFT JOIN nb ON nb.trow = c.trow AND nb.tcol = c.tcol AND nb.y = c.y AND nb.x = c.x)"""


@query("r15_gradient_smooth", f"""WITH {CELLS_SQL}, {SMOOTH_SQL}
SELECT trow, tcol, y, x, {r3_sql('coalesce((0.7*0.4*(z01-zw0) + 0.3*0.4*(ze0-z00) + 0.7*0.6*(z11-zw1) + 0.3*0.6*(ze1-z10)) / 20 + 0*(zs0+zs1+zn0+zn1), (z01 - z00 + (z00-z01-z10+z11) * 0.6) / 10)')} AS grad_e,
  {r3_sql('coalesce((0.7*0.4*(z10-zs0) + 0.3*0.4*(z11-zs1) + 0.7*0.6*(zn0-z00) + 0.3*0.6*(zn1-z01)) / 20 + 0*(zw0+zw1+ze0+ze1), (z10 - z00 + (z00-z01-z10+z11) * 0.3) / 10)')} AS grad_n FROM w""")
def gradient_smooth(spark, sf):
    vertices = written(terrain.vertices(spark, sf), "vertices")
    wide = trace.with_neighbours(tiles.usable_cells(vertices), vertices)
    e, n = trace.gradient_smooth(F.lit(0.3), F.lit(0.6), GRID.cell)
    return wide.select("trow", "tcol", "y", "x", r3(e).alias("grad_e"), r3(n).alias("grad_n"))


@query("r17_trace_stats")
def trace_stats(spark, sf):
    cells, manifest = prepared(spark, sf)
    return trace.trace(views(spark, sf), cells, manifest, GRID).groupBy("view_id").agg(
        F.count(F.lit(1)).alias("n_rays"), F.sum("n_cells").alias("n_cells"), F.sum("n_steps").alias("n_steps"), F.count("distance").alias("n_hits"))


AZ, EL = 3.9, 0.6
SUN_SQL = f"""{GRAD_SQL},
sr AS (SELECT view_id, px, py, x + distance * dx + 0.5 * sin({AZ}) AS x, y + distance * dy + 0.5 * cos({AZ}) AS y, elevation + 0.5 * tan({EL}) + 0.05 AS z, sin({AZ}) AS dx, cos({AZ}) AS dy, tan({EL}) AS slope
  FROM gg WHERE distance > 0 AND -grad_e * sin({AZ}) - grad_n * cos({AZ}) + tan({EL}) > 0)"""


@query("r18_shadow_rays", f"WITH {SUN_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('x')} AS x, {r3_sql('y')} AS y, {r3_sql('z')} AS z FROM sr")
def shadow_rays(spark, sf):
    hits, _, _ = hits_with_gradients(spark, sf)
    found = trace.shadow_rays(hits, F.lit(AZ), F.lit(EL), GRID.cell)
    return found.select("view_id", "px", "py", *[r3(F.col(c)).alias(c) for c in "xyz"])


def again(sql: str) -> str:
    """The flat trace's CTEs once more, under other names, for the shadow rays."""
    import re

    return re.sub(r"\b(cp_t|cp|ck|met|co|so|hit|fh|ry)\b", lambda m: {"ry": "sr"}.get(m[1], "s_" + m[1]), sql)


@query("r19_shadow_visibility", f"""WITH {SUN_SQL}, {again(CELL_PATH_SQL)}, {again(BILINEAR_SQL)}
SELECT gg.view_id, gg.px::INT AS px, gg.py::INT AS py, s_fh.distance IS NULL AS lit FROM gg LEFT JOIN s_fh ON gg.view_id = s_fh.view_id AND gg.px = s_fh.px AND gg.py = s_fh.py""")
def shadow_visibility(spark, sf):
    hits, cells, manifest = hits_with_gradients(spark, sf)
    return trace.shadow_visibility(hits, cells, manifest, GRID, AZ, EL, RANGE).select("view_id", "px", "py", "lit")


LEVELS, LEVEL_SCALE, FOOTPRINT = 3, 1.5, 0.2
#: The terrain without voids, as C11 keeps tiles that have some at level 1; the last row and column of tiles still lack an edge.
FILLED_SQL = terrain.MOSAIC_SQL + """,
mm AS (SELECT a.col, b.row, coalesce(m.z, 1500.0) AS z, g.n FROM g, LATERAL (SELECT unnest(range(g.n)) AS col) a, LATERAL (SELECT unnest(range(g.n)) AS row) b LEFT JOIN m ON m.col = a.col AND m.row = b.row)""" + terrain.VERTICES_SQL[len(terrain.MOSAIC_SQL):].replace("FROM m,", "FROM mm m,")
LEVELS_SQL = FILLED_SQL + f""",
vl AS (SELECT trow, tcol, k AS lod, y >> (k - 1) AS y, x >> (k - 1) AS x, z FROM v, range(1, {LEVELS + 1}) t(k) WHERE x % (1 << (k - 1)) = 0 AND y % (1 << (k - 1)) = 0),
cl AS MATERIALIZED (SELECT lod, trow, tcol, y, x, max(z) FILTER (k = 0) AS z00, max(z) FILTER (k = 1) AS z01, max(z) FILTER (k = 2) AS z10, max(z) FILTER (k = 3) AS z11
  FROM (SELECT lod, trow, tcol, y - k // 2 AS y, x - k % 2 AS x, z, k FROM (SELECT vl.*, unnest([0, 1, 2, 3]) AS k FROM vl)) GROUP BY ALL HAVING count(z) = 4),
{RAYS_SQL},
near AS (SELECT view_id, trow, tcol, CASE WHEN n < 256 THEN 1 ELSE 1 + (SELECT count(*) FROM range(2, {LEVELS + 1}) t(k) WHERE {LEVEL_SCALE} * away * {FOOTPRINT} / 10 >= power(2.0, k - 1) * (1 + 4 * power(2.0, -23))) END AS lod
  FROM (SELECT view_id, trow, tcol, f.n, sqrt(power(greatest(2600000.0 + tcol * 160 - x, x - 2600000.0 - tcol * 160 - 160, 0), 2) + power(greatest(1200000.0 - (trow + 1) * 160 - y, y - 1200000.0 + (trow + 1) * 160 - 160, 0), 2)) AS away
    FROM vw, (SELECT trow, tcol, count(*) AS n FROM cl WHERE lod = 1 GROUP BY 1, 2) f)),
{crossing_sql(10.0, 'cp', 'ry', 'view_id, px, py, x, y, z, dx, dy, slope', 'x - 2600000.0', 'y - 1200000.0')},
ck AS (SELECT *, floor((x - 2600000.0 + dx * (t + t1) / 2) / 10)::BIGINT AS gx, floor(-(y - 1200000.0 + dy * (t + t1) / 2) / 10)::BIGINT AS gy FROM cp),
cn AS (SELECT ck.*, lod, 1 << (lod - 1) AS lw FROM ck JOIN near ON ck.view_id = near.view_id AND gx >= 0 AND gy >= 0 AND near.tcol = gx // 16 AND near.trow = gy // 16),
met AS MATERIALIZED (SELECT *, sum(gap) OVER (PARTITION BY view_id, px, py ORDER BY t) AS gaps FROM (
  SELECT cn.*, z00, z01, z10, z11, ((cn.x - 2600000.0 + dx * t) / 10 - cl.tcol * 16) / lw - cl.x AS a0, (16 * (cl.trow + 1) + (cn.y - 1200000.0 + dy * t) / 10) / lw - cl.y AS b0, dx / (10 * lw) AS a1, dy / (10 * lw) AS b1,
    (t - coalesce(lag(t1) OVER (PARTITION BY view_id, px, py ORDER BY t), 0) > 1e-6)::INT AS gap
  FROM cn JOIN cl ON cl.lod = cn.lod AND cl.tcol = gx // 16 AND cl.trow = gy // 16 AND cl.x = (gx % 16) // lw AND cl.y = (15 - gy % 16) // lw)),
{BILINEAR_SQL},
sh AS (SELECT view_id, px, py, min(th) AS distance, arg_min(lod, th) AS lod FROM (SELECT view_id, px, py, lod, CASE WHEN gaps = 0 AND qc < 0 THEN t ELSE th END AS th FROM hit) WHERE th IS NOT NULL GROUP BY 1, 2, 3)"""


def filled_vertices(spark, sf):
    n = terrain.side(spark, sf)
    every = spark.range(n * n).select((F.col("id") % n).alias("col"), F.floor(F.col("id") / n).alias("row"))
    whole = every.join(terrain.mosaic(spark, sf), ["col", "row"], "left").withColumn("z", F.coalesce("z", F.lit(1500.0)))
    return tiles.assign_tiles(whole, terrain.CELLS).filter(F.col("tcol").between(0, (n - 1) // terrain.CELLS) & F.col("trow").between(0, (n - 1) // terrain.CELLS))


@query("r6_level_hits", f"""WITH {LEVELS_SQL} SELECT ry.view_id, ry.px::INT AS px, ry.py::INT AS py, {r3_sql('distance')} AS distance, lod::INT AS lod
FROM ry LEFT JOIN sh ON ry.view_id = sh.view_id AND ry.px = sh.px AND ry.py = sh.py""")
def level_hits(spark, sf):
    """First hits at mixed levels of detail, coarser with distance."""
    cells = written(levels.level_cells(filled_vertices(spark, sf), GRID, LEVELS, "point"), "level-cells")
    index = written(levels.level_index(cells, GRID), "level-index")
    found = levels.trace_levels(views(spark, sf).withColumn("footprint", F.lit(FOOTPRINT)), cells, index, GRID, LEVELS, LEVEL_SCALE)
    return found.select("view_id", "px", "py", r3(F.col("distance")).alias("distance"), F.col("lod").cast("int").alias("lod"))

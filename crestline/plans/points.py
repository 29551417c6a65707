"""Queries of peaks, points and summits (P), dataset stacks (C) and track streams (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geodesy import from_crs, to_crs
from ..operators import catalogue, points, rays, stacked, tiles, trace
from ..storage import written
from ..streaming.track import stream_track_clearance
from . import terrain, tracing
from .geodesy_sql import from_lv95_sql, vincenty_sql
from .registry import query, r3, r3_sql, table
from .terrain import CELLS, CELLS_SQL, GRID, SAMPLES_SQL, VERTICES_SQL
from .tracing import BILINEAR_SQL, CELL_PATH_SQL, GRAD_SQL, HITS_SQL, RANGE, RAYS_SQL, VIEWS_SQL, K, crossing_sql

# peaks --------------------------------------------------------------------------


def peaks(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("peak_id"), (45.0 + k % 300 / 100.0).alias("lat"), (6.0 + k * 7 % 500 / 100.0).alias("lon"),
                                           F.col("p_retailprice").alias("elevation"), F.col("p_size").cast("double").alias("prominence"), F.col("p_name").alias("name"))


@query("p1_search_peaks", f"""WITH q AS (SELECT n_nationkey::BIGINT AS query_id, lower(strip_accents(trim(n_name))) AS wanted FROM nation
  UNION ALL SELECT p_partkey + 1000, lower(strip_accents(trim(p_name[1:5]))) FROM part WHERE p_partkey % 100 = 1),
b AS (SELECT query_id, p_partkey AS peak_id, CASE WHEN name = wanted THEN 0 WHEN starts_with(name, wanted) THEN 1 ELSE 2 END AS match, 46.0::DOUBLE AS lat0, 7.0::DOUBLE + (query_id % 10)::DOUBLE / 10 AS lon0,
    45.0::DOUBLE + (p_partkey % 300)::DOUBLE / 100 AS lat1, 6.0::DOUBLE + (p_partkey * 7 % 500)::DOUBLE / 100 AS lon1
  FROM q JOIN (SELECT p_partkey, lower(strip_accents(p_name)) AS name FROM part) ON wanted <> '' AND contains(name, wanted)),
d AS ({vincenty_sql('b')})
SELECT query_id, rank, peak_id, match::INT AS match, {r3_sql('distance')} AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match, distance, peak_id)::INT AS rank FROM d) WHERE rank <= 6""")
def search_peaks(spark, sf):
    """Names of nations and parts of peak names, asked from fixed places; the six best each."""
    words = table(spark, sf, "part").filter("p_partkey % 100 = 1").select((F.col("p_partkey") + 1000).alias("query_id"), F.upper(F.substring("p_name", 1, 5)).alias("text"))
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("text")).unionByName(words)
    found = points.search_peaks(asked.withColumns({"lat": F.lit(46.0), "lon": 7.0 + F.col("query_id") % 10 / 10}), peaks(spark, sf))
    return found.select("query_id", "rank", "peak_id", "match", r3(F.col("distance")).alias("distance"))


def target_views(spark, sf):
    return tracing.cameras(spark, sf).withColumns({"tmax": F.lit(20000.0), "pixel_size": F.col("fov") / F.col("height")})


def targets(spark, sf):
    k = F.col("o_orderkey")
    views = table(spark, sf, "supplier").count()
    return table(spark, sf, "orders").select((k % views + 1).alias("view_id"), k.alias("target_id"), (k * 13 % 20000 - 10000.0).alias("east"), (k * 29 % 20000 - 10000.0).alias("north"), (k % 900 - 400.0).alias("dz"))


TARGETS_SQL = """tg AS (SELECT o_orderkey % (SELECT count(*) FROM supplier) + 1 AS view_id, o_orderkey AS target_id, o_orderkey * 13 % 20000 - 10000.0::DOUBLE AS east, o_orderkey * 29 % 20000 - 10000.0::DOUBLE AS north, o_orderkey % 900 - 400.0::DOUBLE AS dz FROM orders)"""
PROJECT_SQL = TARGETS_SQL + f""", cv AS (SELECT *, 0.5 * 5 / tan(0.5 * fov) AS f FROM (SELECT s_suppkey AS view_id, s_suppkey * 0.37::DOUBLE AS h, (s_suppkey % 7 - 3) * 0.1::DOUBLE AS p, (s_suppkey % 3 - 1) * 0.05::DOUBLE AS r, 0.5::DOUBLE + (s_suppkey % 4) * 0.3::DOUBLE AS fov FROM supplier)),
tu AS (SELECT *, dz - {K!r} * (east * east + north * north) AS up, cos(p) * sin(h) AS fe, cos(p) * cos(h) AS fn, sin(p) AS fu, cos(r) * cos(h) - sin(r) * sin(p) * sin(h) AS re, -cos(r) * sin(h) - sin(r) * sin(p) * cos(h) AS rn, sin(r) * cos(p) AS ru,
  -sin(r) * cos(h) - cos(r) * sin(p) * sin(h) AS ue, sin(r) * sin(h) - cos(r) * sin(p) * cos(h) AS un, cos(r) * cos(p) AS uu FROM tg JOIN cv USING (view_id)),
td AS (SELECT *, east * fe + north * fn + up * fu AS fw, east * re + north * rn + up * ru AS ri, -(east * ue + north * un + up * uu) AS dn FROM tu),
tp AS (SELECT *, CASE WHEN fw > 1e-9 THEN 4.5 + f * ri / fw ELSE 4.5 END AS px, CASE WHEN fw > 1e-9 THEN 2.5 + f * dn / fw ELSE 2.5 END AS py FROM td),
pj AS (SELECT *, fw > 1e-9 AND px >= 0 AND py >= 0 AND px < 9 AND py < 5 AS onscreen FROM tp)"""


@query("p4_project_point", f"WITH {PROJECT_SQL} SELECT target_id, onscreen, CASE WHEN onscreen THEN {r3_sql('px')} END AS px, CASE WHEN onscreen THEN {r3_sql('py')} END AS py FROM pj")
def project_point(spark, sf):
    found = points.projected(target_views(spark, sf), targets(spark, sf))
    return found.select("target_id", "onscreen", F.when(F.col("onscreen"), r3(F.col("px"))).alias("px"), F.when(F.col("onscreen"), r3(F.col("py"))).alias("py"))


@query("p5_pixel_of", """SELECT c_custkey AS id, CASE WHEN c_custkey % 23 / 20.0 BETWEEN 0 AND 1 AND c_custkey % 19 / 18.0 BETWEEN 0 AND 1 THEN least(floor(c_custkey % 23 / 20.0 * 640), 639)::INT END AS px,
  CASE WHEN c_custkey % 23 / 20.0 BETWEEN 0 AND 1 AND c_custkey % 19 / 18.0 BETWEEN 0 AND 1 THEN least(floor(c_custkey % 19 / 18.0 * 480), 479)::INT END AS py FROM customer""")
def pixel_of(spark, sf):
    k = F.col("c_custkey")
    at = points.pixel_of(k % 23 / 20.0, k % 19 / 18.0, F.lit(640), F.lit(480))
    return table(spark, sf, "customer").select(k.alias("id"), at["px"].alias("px"), at["py"].alias("py"))


def view_targets(spark, sf):
    """For each traced view the mosaic's highest vertex of each tile, as seen from it, in reach."""
    top = terrain.vertices(spark, sf).groupBy("trow", "tcol").agg(F.max_by(F.struct("z", "col", "row"), F.struct("z", "col", "row")).alias("t"))
    v = tracing.views(spark, sf).select("view_id", "x", "y", "z")
    reach = 2
    r, c = F.floor((GRID.origin_y - F.col("y")) / GRID.width), F.floor((F.col("x") - GRID.origin_x) / GRID.width)
    near = rays.dealt(v, "view_id").withColumn("trow", F.explode(F.sequence(r - reach, r + reach))).withColumn("tcol", F.explode(F.sequence(c - reach, c + reach)))
    met = rays.widened(near).join(top, ["trow", "tcol"])
    return met.select("view_id", (F.col("trow") * 100000 + F.col("tcol")).alias("target_id"), (GRID.origin_x + F.col("t.col") * 10 - F.col("x")).alias("east"), (GRID.origin_y - F.col("t.row") * 10 - F.col("y")).alias("north"),
                      (F.col("t.z") - F.col("z")).alias("dz"), F.col("t.z").alias("prominence"), F.col("t.z").alias("elevation"))


def down_views(spark, sf):
    """Pinhole views from the traced views' places, steeply down, with rays of the same pixels."""
    v = tracing.views(spark, sf).select("view_id", "x", "y", "z", "tmax")
    return v.withColumns({"width": F.lit(12), "height": F.lit(8), "heading": F.col("view_id") * 0.37, "pitch": F.lit(-1.0), "roll": F.lit(0.0), "fx": F.lit(7.0), "fy": F.lit(7.0), "cx": F.lit(6.0), "cy": F.lit(4.0), "pixel_size": F.lit(0.14)})


def down_hits(spark, sf):
    """First hits of those views' rays: each its own path, traced like shadow rays, then the nearest."""
    views = written(down_views(spark, sf), "down-views")
    cells, manifest = tracing.prepared(spark, sf)
    r = written(rays.widened(rays.camera_rays(views)).join(views.select("view_id", "x", "y", "z", "tmax"), "view_id"), "camera-rays")
    return views, trace.first_hits(r, cells, manifest, GRID)


OCCLUDED_SQL = f"""{CELLS_SQL}, {VIEWS_SQL},
ca AS (SELECT *, sin(view_id * 0.37::DOUBLE) AS sh, cos(view_id * 0.37::DOUBLE) AS ch, sin(-1.0::DOUBLE) AS sp, cos(-1.0::DOUBLE) AS cp FROM vw),
ax AS (SELECT ca.*, px, py, cp * sh + u * ch + v * sp * sh AS e, cp * ch - u * sh + v * sp * ch AS no, sp - v * cp AS up
  FROM ca, LATERAL (SELECT px, py, (px - 5.5)::DOUBLE / 7 AS u, (py - 3.5)::DOUBLE / 7 AS v FROM range(12) a(px), range(8) b(py))),
ry AS (SELECT view_id, px, py, x, y, z, e / sqrt(e * e + no * no) AS dx, no / sqrt(e * e + no * no) AS dy, up / sqrt(e * e + no * no) AS slope FROM ax),
{CELL_PATH_SQL}, {BILINEAR_SQL},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trow, tcol ORDER BY z DESC, col DESC, row DESC) AS k FROM v) WHERE k = 1),
tg AS (SELECT ca.*, trow * 100000 + tcol AS target_id, 2600000.0 + col * 10 - ca.x AS east, 1200000.0 - row * 10 - ca.y AS north, top.z - ca.z AS dz
  FROM ca JOIN top ON trow BETWEEN floor((1200000.0 - ca.y) / 160) - 2 AND floor((1200000.0 - ca.y) / 160) + 2 AND tcol BETWEEN floor((ca.x - 2600000.0) / 160) - 2 AND floor((ca.x - 2600000.0) / 160) + 2),
tu AS (SELECT *, dz - {K!r} * (east * east + north * north) AS tup, sqrt(east * east + north * north) AS away FROM tg),
td AS (SELECT *, cp * (east * sh + north * ch) + tup * sp AS fw, east * ch - north * sh AS ri, sp * (east * sh + north * ch) - tup * cp AS dn FROM tu),
ti AS (SELECT *, CASE WHEN fw > 1e-9 THEN 6 + 7 * ri / fw ELSE 6 END AS tx, CASE WHEN fw > 1e-9 THEN 4 + 7 * dn / fw ELSE 4 END AS ty FROM td),
ts AS (SELECT *, fw > 1e-9 AND tx >= 0 AND ty >= 0 AND tx < 12 AND ty < 8 AS onscreen FROM ti)"""


@query("p2_visible_peaks", f"""WITH {OCCLUDED_SQL},
nr AS (SELECT ts.*, greatest(ceil(50 / away / 0.14), 1) AS w FROM ts WHERE onscreen AND away BETWEEN 50 AND {RANGE}),
sp AS (SELECT fh.view_id, fh.px, fh.py, distance * dx AS he, distance * dy AS hn, slope * distance + {K!r} * distance * distance AS hz FROM fh JOIN ry ON fh.view_id = ry.view_id AND fh.px = ry.px AND fh.py = ry.py WHERE distance > 0),
bt AS (SELECT nr.view_id, target_id, min(away) AS away, min(sqrt(power(he - east, 2) + power(hn - north, 2) + power(hz - dz, 2))) AS off
  FROM nr JOIN sp ON sp.view_id = nr.view_id AND abs(px + 0.5 - tx) <= w AND abs(py + 0.5 - ty) <= w GROUP BY 1, 2),
rk AS (SELECT bt.*, top.z AS prominence, row_number() OVER (PARTITION BY view_id ORDER BY top.z DESC, away, target_id)::INT AS rank FROM bt JOIN top ON trow * 100000 + tcol = target_id WHERE off <= greatest(50, 0.28 * away))
SELECT view_id, target_id, rank, {r3_sql('away')} AS distance, prominence FROM rk WHERE rank <= 100""")
def visible_peaks(spark, sf):
    views, hits = down_hits(spark, sf)
    found = points.visible_peaks(views, hits, view_targets(spark, sf))
    return found.select("view_id", "target_id", "rank", r3(F.col("distance")).alias("distance"), "prominence")


@query("p3_target_occluded", f"""WITH {OCCLUDED_SQL} SELECT ts.view_id, target_id, onscreen,
  CASE WHEN away > {RANGE} THEN true WHEN NOT onscreen THEN false ELSE coalesce(fh.distance + greatest(5.0, 0.28 * away) < away, false) END AS occluded
FROM ts LEFT JOIN fh ON onscreen AND fh.view_id = ts.view_id AND fh.px = floor(tx) AND fh.py = floor(ty)""")
def target_occluded(spark, sf):
    views, hits = down_hits(spark, sf)
    seen = points.projected(views, view_targets(spark, sf).drop("prominence", "elevation")).withColumn("distance", F.hypot("east", "north"))
    return points.target_occluded(seen, hits).select("view_id", "target_id", "onscreen", "occluded")


@query("p6_inspect", f"""WITH {GRAD_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('distance')} AS distance, {r3_sql('elevation')} AS elevation, {r3_sql('atan(sqrt(grad_e * grad_e + grad_n * grad_n)) * 180 / pi()')} AS slope_deg,
  {r3_sql('(degrees(atan2(-grad_e, -grad_n)) + 360) - 360 * floor((degrees(atan2(-grad_e, -grad_n)) + 360) / 360)')} AS aspect_deg FROM gg""")
def inspect(spark, sf):
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    return points.inspect(hits, hits.select("view_id", "px", "py")).select("view_id", "px", "py", *[r3(F.col(c)).alias(c) for c in ("distance", "elevation", "slope_deg", "aspect_deg")])


@query("p6_inspect_place")
def inspect_place(spark, sf):
    """The same with place and true north; projections are no SQL, a test compares it with moved points."""
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    found = points.inspect(hits, hits.select("view_id", "px", "py"), 2056)
    return found.select("view_id", "px", "py", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), r3(F.col("slope_deg")).alias("slope_deg"), r3(F.col("aspect_deg")).alias("aspect_deg"))


def places(spark, sf):
    n = terrain.side(spark, sf)
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("point_id"), (2600000.0 + k * 37 % (n * 10) + 3.3).alias("x"), (1200000.0 - k * 91 % (n * 10) - 2.2).alias("y"))


PLACES_SQL = "pl AS (SELECT c_custkey AS point_id, 2600000.0::DOUBLE + c_custkey * 37 % (n * 10) + 3.3::DOUBLE AS x, 1200000.0::DOUBLE - c_custkey * 91 % (n * 10) - 2.2::DOUBLE AS y FROM customer, g)"
AT_SQL = PLACES_SQL + ", atp AS (SELECT *, floor((x - 2600000.0) / 10)::BIGINT AS gx, floor(-(y - 1200000.0) / 10)::BIGINT AS gy FROM pl)"
GROUND_SQL = AT_SQL + """, gd AS (SELECT atp.*, (atp.x - 2600000.0) / 10 - gx AS sx, 1 + gy + (atp.y - 1200000.0) / 10 AS sy, z00, z01, z10, z11 FROM atp LEFT JOIN c ON c.tcol = gx // 16 AND c.trow = gy // 16 AND c.x = gx % 16 AND c.y = 15 - gy % 16),
gr0 AS (SELECT *, z00 + (z01 - z00) * sx + (z10 - z00) * sy + (z00 - z01 - z10 + z11) * sx * sy AS ground FROM gd)"""


@query("p7_sample_ground", f"WITH {CELLS_SQL}, {GROUND_SQL} SELECT point_id, {r3_sql('ground')} AS ground FROM gr0")
def sample_ground(spark, sf):
    return points.sample_ground(places(spark, sf), terrain.cells(spark, sf), GRID).select("point_id", r3(F.col("ground")).alias("ground"))


RADIUS_SQL = """rd AS (SELECT p.point_id, v.z, v.col, v.row, 2600000.0 + v.col * 10 AS vx, 1200000.0 - v.row * 10 AS vy, sqrt(power(2600000.0 + v.col * 10 - p.x, 2) + power(1200000.0 - v.row * 10 - p.y, 2)) AS d
  FROM pl p JOIN m v ON v.col BETWEEN floor((p.x - 2600000.0) / 10) - 5 AND floor((p.x - 2600000.0) / 10) + 6 AND v.row BETWEEN floor((1200000.0 - p.y) / 10) - 5 AND floor((1200000.0 - p.y) / 10) + 6 WHERE sqrt(power(2600000.0 + v.col * 10 - p.x, 2) + power(1200000.0 - v.row * 10 - p.y, 2)) <= 45)"""


@query("p8_grid_points", f"WITH {terrain.MOSAIC_SQL}, {PLACES_SQL}, {RADIUS_SQL} SELECT point_id, count(*) AS n, {r3_sql('min(z)')} AS lo, {r3_sql('max(z)')} AS hi FROM rd GROUP BY 1")
def grid_points(spark, sf):
    found = points.grid_points(places(spark, sf).withColumnRenamed("point_id", "centre_id"), terrain.vertices(spark, sf), GRID, 45.0)
    return found.groupBy(F.col("centre_id").alias("point_id")).agg(F.count(F.lit(1)).alias("n"), r3(F.min("z")).alias("lo"), r3(F.max("z")).alias("hi"))


@query("p9_find_summit", f"""WITH {CELLS_SQL}, {GROUND_SQL}, {RADIUS_SQL},
on_ground AS (SELECT rd.* FROM rd SEMI JOIN c ON c.tcol = rd.col // 16 AND c.trow = rd.row // 16 AND c.x = rd.col % 16 AND c.y = least(15, 16 - rd.row % 16)),
ev AS (SELECT point_id, z FROM on_ground UNION ALL SELECT point_id, ground FROM gr0)
SELECT pl.point_id, {r3_sql('max(ev.z)')} AS z FROM pl LEFT JOIN ev ON ev.point_id = pl.point_id GROUP BY 1""")
def find_summit(spark, sf):
    vertices = written(terrain.vertices(spark, sf), "vertices")
    found = points.find_summit(places(spark, sf).withColumnRenamed("point_id", "centre_id"), vertices, tiles.usable_cells(vertices), GRID, 45.0)
    return found.select(F.col("centre_id").alias("point_id"), r3(F.col("z")).alias("z"))


def tracks(spark, sf):
    n = terrain.side(spark, sf)
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("event_id"), (2600000.0 + k * 37 % (n * 10) + 3.3).alias("x"), (1200000.0 - k * 91 % (n * 10) - 2.2).alias("y"),
                                             F.when(k % 2 == 0, "FollowTerrain").otherwise("HoldAltitude").alias("mode"), (k % 2200).cast("double").alias("height"))


TRACK_SQL = GROUND_SQL.replace("c_custkey AS point_id", "event_id AS point_id").replace("c_custkey", "event_id").replace("FROM customer, g", "FROM events, g")


@query("p10_track_clearance", f"""WITH {CELLS_SQL}, {TRACK_SQL} SELECT point_id AS event_id, {r3_sql('CASE WHEN point_id % 2 = 0 THEN ground + 50 ELSE point_id % 2200 END')} AS z,
  coalesce(CASE WHEN point_id % 2 = 0 THEN ground IS NOT NULL ELSE point_id % 2200 >= ground + 0.5 END, false) AS accepted FROM gr0""")
def track_clearance(spark, sf):
    return points.track_clearance(tracks(spark, sf), terrain.cells(spark, sf), GRID).select("event_id", r3(F.col("z")).alias("z"), "accepted")


@query("x1_stream_track_clearance", f"""WITH {CELLS_SQL}, {TRACK_SQL} SELECT point_id AS event_id, {r3_sql('CASE WHEN point_id % 2 = 0 THEN ground + 50 ELSE point_id % 2200 END')} AS z,
  coalesce(CASE WHEN point_id % 2 = 0 THEN ground IS NOT NULL ELSE point_id % 2200 >= ground + 0.5 END, false) AS accepted FROM gr0""")
def stream_clearance(spark, sf):
    """The same over a stream: positions read as files arrive, joined to stored cells, appended to a table."""
    cells = written(terrain.cells(spark, sf), "cells")
    return stream_track_clearance(tracks(spark, sf), cells, GRID).select("event_id", r3(F.col("z")).alias("z"), "accepted")


@query("p11_look_at", f"WITH {TARGETS_SQL} SELECT target_id, {r3_sql('degrees(atan2(east, north))')} AS heading, {r3_sql(f'degrees(atan2(dz - {K!r} * (east*east + north*north), sqrt(east*east + north*north)))')} AS pitch FROM tg")
def look_at(spark, sf):
    heading, pitch = points.look_at(F.col("east"), F.col("north"), F.col("dz"))
    return targets(spark, sf).select("target_id", r3(F.degrees(heading)).alias("heading"), r3(F.degrees(pitch)).alias("pitch"))


@query("p12_compass_sector", f"SELECT event_id, ({list(points.SECTORS)})[1 + (floor((h + 11.25) / 22.5)::INT % 16)] AS sector FROM (SELECT event_id, d - 360 * floor(d / 360) AS h FROM (SELECT event_id, event_id * 7.3 - 400 AS d FROM events))")
def compass_sector(spark, sf):
    return table(spark, sf, "events").select("event_id", points.compass_sector(F.col("event_id") * 7.3 - 400).alias("sector"))


# stacks -------------------------------------------------------------------------

COARSE = tiles.Grid(2600004.0, 1199998.0, 15.0, CELLS)


def primary_vertices(spark, sf):
    """Vertices of the even sources alone: the dataset on top of the stack; all sources' lie below."""
    some = terrain.samples(spark, sf).filter("source_id % 2 = 0 and mask <> 0").withColumnRenamed("value", "z")
    n = terrain.side(spark, sf)
    placed = tiles.assign_tiles(tiles.mosaic(some, terrain.RANK), CELLS)
    return placed.filter(F.col("tcol").between(0, (n - 1) // CELLS) & F.col("trow").between(0, (n - 1) // CELLS))


def primary_cells(spark, sf):
    return tiles.usable_cells(primary_vertices(spark, sf))


def _primary_sql() -> str:
    import re

    own = CELLS_SQL[len(SAMPLES_SQL):].replace("mask <> 0", "mask <> 0 AND source_id % 2 = 0")
    return re.sub(r"\b([mvc])(?= AS (?:MATERIALIZED )?\(|\.\*)|(?<=FROM )([mv])\b", lambda x: (x[1] or x[2]) + "1", own)


BOTH_SQL = CELLS_SQL + _primary_sql()


@query("c1_pick_frame", """WITH d AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey ELSE s_suppkey // 3 END AS view_id, CASE WHEN s_suppkey % 5 = 0 THEN 4326 ELSE 2056 END AS epsg FROM supplier)
SELECT view_id, CASE WHEN count(*) = 1 AND min(epsg) <> 4326 THEN 'crs' ELSE 'aeqd' END AS kind, CASE WHEN count(*) = 1 AND min(epsg) <> 4326 THEN min(epsg) END AS epsg FROM d GROUP BY 1""")
def pick_frame(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.when(k % 4 == 0, -k).otherwise(F.floor(k / 3)).alias("view_id"), F.when(k % 5 == 0, 4326).otherwise(2056).alias("epsg"))
    return catalogue.pick_frame(rows.withColumn("projected", F.col("epsg") != 4326))


@query("c2_tiles_in_range", f"""WITH {VERTICES_SQL}, k AS (SELECT DISTINCT trow, tcol FROM v), {PLACES_SQL},
d AS (SELECT point_id AS observer_id, trow, tcol, trow = floor((1200000.0 - y) / 160) AND tcol = floor((x - 2600000.0) / 160) AS own,
  sqrt(power(greatest(2600000.0 + tcol * 160 - x, x - 2600000.0 - tcol * 160 - 160, 0), 2) + power(greatest(1200000.0 - (trow + 1) * 160 - y, y - 1200000.0 + (trow + 1) * 160 - 160, 0), 2)) AS distance FROM pl, k)
SELECT observer_id, rank, trow, tcol, {r3_sql('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY observer_id ORDER BY own DESC, distance, trow, tcol)::INT AS rank FROM d WHERE own OR distance <= 250) WHERE rank <= 8""")
def tiles_in_range(spark, sf):
    keys = terrain.vertices(spark, sf).select("trow", "tcol").distinct().withColumn("priority", F.lit(0))
    found = catalogue.tiles_in_range(keys, places(spark, sf).withColumnRenamed("point_id", "observer_id"), GRID, 250.0, 8)
    return found.select("observer_id", "rank", "trow", "tcol", r3(F.col("distance")).alias("distance"))


@query("c3_observer_fallback", f"""WITH {VERTICES_SQL}, k AS (SELECT DISTINCT trow, tcol FROM v), b AS (SELECT (min(trow) + max(trow)) / 2.0 AS mr, (min(tcol) + max(tcol)) / 2.0 AS mc FROM k)
SELECT trow, tcol, 2600000.0::DOUBLE + (tcol + 0.5) * 160 AS x, 1200000.0::DOUBLE - (trow + 0.5) * 160 AS y FROM k, b ORDER BY power(trow - mr, 2) + power(tcol - mc, 2), trow, tcol LIMIT 1""")
def observer_fallback(spark, sf):
    return catalogue.observer_fallback(terrain.vertices(spark, sf).select("trow", "tcol").distinct(), GRID)


@query("c4_owned_cells", f"WITH {BOTH_SQL} SELECT trow, tcol, y, x FROM c ANTI JOIN c1 USING (trow, tcol, y, x)")
def owned_cells(spark, sf):
    return catalogue.owned_cells(terrain.cells(spark, sf), GRID, primary_cells(spark, sf), GRID).select("trow", "tcol", "y", "x")


@query("c4_owned_cells_misaligned", f"""WITH {BOTH_SQL},
w AS (SELECT trow, tcol, y, x, (tcol * 16 + x) * 10.0::DOUBLE - 4 AS e, 2.0::DOUBLE - (trow * 16 + 16 - y) * 10 AS n FROM c),
o AS (SELECT w.*, hx, unnest(range(floor(n / 15 + 1e-6)::BIGINT, ceil((n + 10) / 15 - 1e-6)::BIGINT)) AS hn FROM (SELECT *, unnest(range(floor(e / 15 + 1e-6)::BIGINT, ceil((e + 10) / 15 - 1e-6)::BIGINT)) AS hx FROM w) w)
SELECT trow, tcol, count(*) AS n_owned FROM (SELECT o.trow, o.tcol, o.y, o.x FROM o LEFT JOIN c1 ON hx >= 0 AND hn < 0 AND c1.tcol = hx // 16 AND c1.x = hx % 16 AND c1.trow = (-hn - 1) // 16 AND c1.y = 15 - (-hn - 1) % 16
  WHERE c1.trow IS NULL GROUP BY ALL) GROUP BY 1, 2""")
def owned_cells_misaligned(spark, sf):
    """The same where the upper dataset has another origin and cell size."""
    keep = catalogue.owned_cells(terrain.cells(spark, sf), GRID, primary_cells(spark, sf), COARSE)
    return keep.groupBy("trow", "tcol").agg(F.count(F.lit(1)).alias("n_owned"))


@query("c5_owned_hits", f"WITH {BOTH_SQL}, {AT_SQL} SELECT point_id, {r3_sql('x')} AS x FROM atp WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE c1.tcol = gx // 16 AND c1.trow = gy // 16 AND c1.x = gx % 16 AND c1.y = 15 - gy % 16)")
def owned_hits(spark, sf):
    return catalogue.owned_hits(places(spark, sf), primary_cells(spark, sf), GRID).select("point_id", r3(F.col("x")).alias("x"))


@query("c6_locate", f"""WITH {BOTH_SQL}, {AT_SQL} SELECT point_id, CASE WHEN EXISTS (SELECT 1 FROM c1 WHERE c1.tcol = gx // 16 AND c1.trow = gy // 16 AND c1.x = gx % 16 AND c1.y = 15 - gy % 16) THEN 0
  WHEN EXISTS (SELECT 1 FROM c WHERE c.tcol = gx // 16 AND c.trow = gy // 16 AND c.x = gx % 16 AND c.y = 15 - gy % 16) THEN 1 END AS dataset_id FROM atp""")
def locate(spark, sf):
    both = primary_cells(spark, sf).select(F.lit(0).alias("dataset_id"), "trow", "tcol", "y", "x").unionByName(terrain.cells(spark, sf).select(F.lit(1).alias("dataset_id"), "trow", "tcol", "y", "x"))
    return catalogue.locate(places(spark, sf), both, {0: GRID, 1: GRID}).select("point_id", "dataset_id")


@query("c7_vertical_offset", f"WITH {CELLS_SQL} SELECT trow, tcol, {r3_sql('max(zmax) + CASE WHEN tcol % 2 = 0 THEN -2.5 ELSE 4.25 END')} AS zmax FROM c GROUP BY trow, tcol")
def vertical_offset(spark, sf):
    rows = terrain.cells(spark, sf).withColumn("dataset_id", F.col("tcol") % 2)
    offsets = spark.createDataFrame([(0, -2.5), (1, 4.25)], "dataset_id long, vertical_offset_m double")
    return catalogue.apply_vertical_offset(rows, offsets, ["zmax"]).groupBy("trow", "tcol").agg(r3(F.max("zmax")).alias("zmax"))


RAY_KEYS = "view_id, px, py, x, y, z, dx, dy, slope"
RAISED = 37.5
#: Every ray cut at the lines of both grids; the layer on top owns a piece, else the one below, raised by its offset.
STACK_SQL = f"""{BOTH_SQL}, {RAYS_SQL},
{crossing_sql(10.0, 'fa', 'ry', RAY_KEYS, 'x - 2600000.0', 'y - 1200000.0')}, {crossing_sql(15.0, 'fb', 'ry', RAY_KEYS, 'x - 2600004.0', 'y - 1199998.0')},
cut AS (SELECT *, (t + t1) / 2 AS mid FROM (SELECT *, lead(t) OVER (PARTITION BY {RAY_KEYS} ORDER BY t) AS t1 FROM (SELECT * FROM fa_t UNION SELECT * FROM fb_t)) WHERE t1 - t > 1e-9),
piece AS (SELECT *, floor((x - 2600000.0 + dx * mid) / 10)::BIGINT AS gx, floor(-(y - 1200000.0 + dy * mid) / 10)::BIGINT AS gy,
  floor((x - 2600004.0 + dx * mid) / 15)::BIGINT AS hx, floor(-(y - 1199998.0 + dy * mid) / 15)::BIGINT AS hy FROM cut),
top AS (SELECT piece.*, c1.z00 AS p00, c1.z01 AS p01, c1.z10 AS p10, c1.z11 AS p11 FROM piece LEFT JOIN c1
  ON hx >= 0 AND hy >= 0 AND c1.tcol = hx // 16 AND c1.trow = hy // 16 AND c1.x = hx % 16 AND c1.y = 15 - hy % 16),
owned AS (SELECT top.*, p00 IS NULL AS low, c.z00 + {RAISED} AS q00, c.z01 + {RAISED} AS q01, c.z10 + {RAISED} AS q10, c.z11 + {RAISED} AS q11 FROM top LEFT JOIN c
  ON p00 IS NULL AND gx >= 0 AND gy >= 0 AND c.tcol = gx // 16 AND c.trow = gy // 16 AND c.x = gx % 16 AND c.y = 15 - gy % 16),
met AS (SELECT *, sum(gap) OVER (PARTITION BY view_id, px, py ORDER BY t) AS gaps FROM (
  SELECT view_id, px, py, x, y, z, dx, dy, slope, t, t1, gx, gy, low::INT AS dataset_id, coalesce(p00, q00) AS z00, coalesce(p01, q01) AS z01, coalesce(p10, q10) AS z10, coalesce(p11, q11) AS z11,
    CASE WHEN low THEN (x - 2600000.0 + dx * t) / 10 - gx ELSE (x - 2600004.0 + dx * t) / 15 - hx END AS a0,
    CASE WHEN low THEN 1 + gy + (y - 1200000.0 + dy * t) / 10 ELSE 1 + hy + (y - 1199998.0 + dy * t) / 15 END AS b0,
    dx / CASE WHEN low THEN 10 ELSE 15 END AS a1, dy / CASE WHEN low THEN 10 ELSE 15 END AS b1,
    (t - coalesce(lag(t1) OVER (PARTITION BY view_id, px, py ORDER BY t), 0) > 1e-6)::INT AS gap
  FROM owned WHERE coalesce(p00, q00) IS NOT NULL)),
{BILINEAR_SQL},
sh AS (SELECT view_id, px, py, min(th) AS distance, arg_min(dataset_id, th) AS dataset_id
  FROM (SELECT view_id, px, py, dataset_id, CASE WHEN gaps = 0 AND qc < 0 THEN t ELSE th END AS th FROM hit) WHERE th IS NOT NULL GROUP BY 1, 2, 3)"""


@query("c5_stacked_first_hits", f"""WITH {STACK_SQL} SELECT ry.view_id, ry.px::INT AS px, ry.py::INT AS py, {r3_sql('distance')} AS distance, {r3_sql(f'z + slope * distance + {K!r} * distance * distance')} AS elevation, dataset_id
FROM ry LEFT JOIN sh ON ry.view_id = sh.view_id AND ry.px = sh.px AND ry.py = sh.py""")
def stacked_first_hits(spark, sf):
    """R10-R13 over two datasets with other origins and cell sizes, the lower one raised."""
    layers = [stacked.Layer(written(primary_cells(spark, sf), "cells"), COARSE), stacked.Layer(terrain.cells(spark, sf), GRID, RAISED)]
    found = stacked.trace_stack(tracing.views(spark, sf), layers)
    return found.select("view_id", "px", "py", r3(F.col("distance")).alias("distance"), r3(F.col("elevation")).alias("elevation"), "dataset_id")


#: About where EPSG 2154 has the corner of the square.
FRENCH = tiles.Grid(1037400.0, 6659590.0, 10.0, CELLS)


@query("r14_foreign_layer_hits")
def foreign_layer_hits(spark, sf):
    """A stack of two reference systems: the dataset of EPSG 2056 over one of 2154, traced through affine patches, with gradients."""
    layers = [stacked.Layer(written(primary_cells(spark, sf), "cells"), COARSE, epsg=2056), stacked.Layer(tracing.prepared(spark, sf)[0].drop("brow", "bcol"), FRENCH, RAISED, 2154)]
    found = stacked.stack_gradients(stacked.trace_stack(tracing.views(spark, sf), layers, frame_epsg=2056), layers)
    return found.select("view_id", "px", "py", "dataset_id", *[r3(F.col(c)).alias(c) for c in ("distance", "elevation", "grad_e", "grad_n")])


# a stack by latitude and longitude: cells of powers of two, so that both engines place vertices exactly
GEO, GEO_TOP = tiles.Grid(7.0, 46.0, 1 / 8192, CELLS), tiles.Grid(7.0 + 1 / 2048, 46.0 - 1 / 4096, 3 / 16384, CELLS)


def geo_stack(spark, sf):
    layers = []
    for vertices, grid, offset in ((primary_vertices(spark, sf), GEO_TOP, -2.5), (terrain.vertices(spark, sf), GEO, RAISED)):
        kept = written(vertices, "vertices")
        layers.append(stacked.Layer(tiles.usable_cells(kept), grid, offset, 4326, kept))
    return layers


def geo_places(spark, sf):
    n = terrain.side(spark, sf)
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("centre_id"), (46.0 - (k * 91 % (n * 10) / 10.0 + 0.22) / 8192).alias("lat"), (7.0 + (k * 37 % (n * 10) / 10.0 + 0.33) / 8192).alias("lon"))


GEO_PLACES_SQL = "gp AS (SELECT c_custkey AS centre_id, 46.0::DOUBLE - (c_custkey * 91 % (n * 10) / 10.0::DOUBLE + 0.22::DOUBLE) / 8192 AS lat, 7.0::DOUBLE + (c_custkey * 37 % (n * 10) / 10.0::DOUBLE + 0.33::DOUBLE) / 8192 AS lon FROM customer, g)"


def geo_ground_sql(src: str) -> str:
    """CTEs that add ground and dataset_id of the stack to src (lat, lon)."""
    steps, was = [], src
    for number, (grid, cells, offset) in enumerate(((GEO_TOP, "c1", -2.5), (GEO, "c", RAISED))):
        keys = f"SELECT *, floor(a / 16)::BIGINT AS tc, floor(-b / 16)::BIGINT AS tr FROM (SELECT *, (lon - {grid.origin_x!r}::DOUBLE) / {grid.cell!r}::DOUBLE AS a, (lat - {grid.origin_y!r}::DOUBLE) / {grid.cell!r}::DOUBLE AS b FROM {was})"
        cell = f"SELECT *, least(floor(a - tc * 16), 15)::INT AS kx, least(floor(b + (tr + 1) * 16), 15)::INT AS ky FROM ({keys})"
        steps.append(f"""gs{number} AS (SELECT k.* EXCLUDE (a, b, tc, tr, kx, ky), q.z00 + (q.z01 - q.z00) * sx + (q.z10 - q.z00) * sy + (q.z00 - q.z01 - q.z10 + q.z11) * sx * sy + {offset} AS h{number}
  FROM (SELECT *, a - tc * 16 - kx AS sx, b + (tr + 1) * 16 - ky AS sy FROM ({cell})) k LEFT JOIN {cells} q ON q.tcol = tc AND q.trow = tr AND q.x = kx AND q.y = ky)""".replace("EXCLUDE (a, b, tc, tr, kx, ky)", "EXCLUDE (a, b, tc, tr, kx, ky, sx, sy)"))
        was = f"gs{number}"
    return ",\n".join(steps) + ",\ngs AS (SELECT * EXCLUDE (h0, h1), coalesce(h0, h1) AS ground, CASE WHEN h0 IS NOT NULL THEN 0 WHEN h1 IS NOT NULL THEN 1 END AS dataset_id FROM gs1)"


GEO_NEAR_SQL = f"""{GEO_PLACES_SQL},
gv AS (SELECT 0 AS layer, {GEO_TOP.origin_x!r}::DOUBLE + col * {GEO_TOP.cell!r}::DOUBLE AS vlon, {GEO_TOP.origin_y!r}::DOUBLE - row * {GEO_TOP.cell!r}::DOUBLE AS vlat FROM m1
  UNION ALL SELECT 1, {GEO.origin_x!r}::DOUBLE + col * {GEO.cell!r}::DOUBLE, {GEO.origin_y!r}::DOUBLE - row * {GEO.cell!r}::DOUBLE FROM m),
gb AS (SELECT centre_id, layer, gp.lat AS lat0, gp.lon AS lon0, vlat AS lat1, vlon AS lon1 FROM gp JOIN gv ON vlat BETWEEN gp.lat - 0.0005 AND gp.lat + 0.0005 AND vlon BETWEEN gp.lon - 0.0007 AND gp.lon + 0.0007),
gn AS (SELECT centre_id, layer, lat1 AS lat, lon1 AS lon, distance FROM ({vincenty_sql('gb')}) WHERE distance <= 45)"""


@query("p7_stacked_ground", f"WITH {BOTH_SQL}, {GEO_PLACES_SQL}, {geo_ground_sql('gp')} SELECT centre_id AS point_id, {r3_sql('ground')} AS ground, dataset_id FROM gs")
def stacked_ground(spark, sf):
    """P7 over two datasets with other origins, cell sizes and offsets."""
    return stacked.sample_stack(geo_places(spark, sf), geo_stack(spark, sf)).select(F.col("centre_id").alias("point_id"), r3(F.col("ground")).alias("ground"), "dataset_id")


@query("p8_stacked_grid_points", f"WITH {BOTH_SQL}, {GEO_NEAR_SQL} SELECT centre_id, layer AS dataset_id, count(*) AS n, {r3_sql('max(distance)')} AS farthest FROM gn GROUP BY 1, 2")
def stacked_grid_points(spark, sf):
    found = stacked.grid_points(geo_places(spark, sf), geo_stack(spark, sf), 45.0)
    return found.groupBy("centre_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"), r3(F.max("distance")).alias("farthest"))


@query("p9_stacked_summit", f"""WITH {BOTH_SQL}, {GEO_NEAR_SQL}, ge AS (SELECT centre_id, lat, lon, distance FROM gn UNION ALL SELECT centre_id, lat, lon, 0 FROM gp), {geo_ground_sql('ge')}
SELECT centre_id, {r3_sql('max(ground)')} AS z, {r3_sql('arg_min(distance, (-ground, distance))')} AS distance FROM gs GROUP BY 1""")
def stacked_summit(spark, sf):
    found = stacked.find_summit(geo_places(spark, sf), geo_stack(spark, sf), 45.0)
    return found.select("centre_id", r3(F.col("z")).alias("z"), r3(F.col("distance")).alias("distance"))


STACK_RANGE_SQL = f"""{VERTICES_SQL}, {PLACES_SQL}, k AS (SELECT DISTINCT trow, tcol FROM v WHERE (trow + tcol) % 3 > 0),
t AS (SELECT 0 AS priority, trow, tcol, 2600004.0::DOUBLE + tcol * 240 AS west, 1199998.0::DOUBLE - (trow + 1) * 240 AS south, 240 AS w FROM k WHERE tcol % 2 = 0
  UNION ALL SELECT 1, trow, tcol, 2600000.0::DOUBLE + tcol * 160, 1200000.0::DOUBLE - (trow + 1) * 160, 160 FROM k),
d AS (SELECT point_id AS observer_id, t.*, x >= west AND x < west + w AND y > south AND y <= south + w AS own,
  sqrt(power(greatest(west - x, x - west - w, 0), 2) + power(greatest(south - y, y - south - w, 0), 2)) AS distance FROM pl, t),
near AS (SELECT * FROM d WHERE own OR distance <= 250)"""


def stack_range(spark, sf):
    keys = terrain.vertices(spark, sf).select("trow", "tcol").distinct().filter((F.col("trow") + F.col("tcol")) % 3 > 0)
    both = keys.filter("tcol % 2 = 0").withColumn("priority", F.lit(0)).unionByName(keys.withColumn("priority", F.lit(1)))
    return catalogue.tiles_in_range(both, places(spark, sf).withColumnRenamed("point_id", "observer_id"), {0: COARSE, 1: GRID}, 250.0, 1 << 30)


@query("c2_stacked_tiles_in_range", f"""WITH {STACK_RANGE_SQL} SELECT observer_id, row_number() OVER (PARTITION BY observer_id ORDER BY own DESC, distance, priority, trow, tcol)::INT AS rank, priority, trow, tcol, {r3_sql('distance')} AS distance FROM near""")
def stacked_tiles_in_range(spark, sf):
    """C2 over two datasets with other grids; the datasets lack every third tile."""
    return stack_range(spark, sf).select("observer_id", "rank", "priority", "trow", "tcol", r3(F.col("distance")).alias("distance"))


@query("c3_stack_fallback", f"""WITH {STACK_RANGE_SQL}, f AS (SELECT observer_id, min((priority, trow, tcol)) AS t FROM near GROUP BY 1 HAVING NOT bool_or(own))
SELECT observer_id, priority, f.t[2] AS trow, f.t[3] AS tcol, west + (tcol % 5 + 4) * w / 16.0 AS x, south + (trow % 3 + 2) * w / 16.0 AS y
FROM f JOIN t ON t.priority = f.t[1] AND t.trow = f.t[2] AND t.tcol = f.t[3]""")
def stack_fallback(spark, sf):
    """Each tile with two usable rectangles, of which the lower one is the first."""
    found = written(stack_range(spark, sf), "candidates")
    rect = lambda column, row, size: F.struct(column.alias("column"), row.alias("row"), F.lit(size).alias("width"), F.lit(size // 2).alias("height"))
    low, high = rect(F.col("tcol") % 5, F.col("trow") % 3, 8), rect(F.col("tcol") % 5, F.col("trow") % 3 + 6, 4)
    coverage = found.select("priority", "trow", "tcol").distinct().withColumn("r", F.explode(F.array(high, low))).select("priority", "trow", "tcol", "r.*")
    return catalogue.stack_fallback(found, coverage, {0: COARSE, 1: GRID})


W2_REGION = (139488000.0, 95090000.0, 40000.0, 30000.0)


@query("w2_map_pixel_of", f"""WITH {terrain.GRID_SQL}, {GEO_PLACES_SQL} SELECT centre_id AS point_id, {r3_sql(f'((lon + 180) / 360 * 268435456 - {W2_REGION[0]}) / {W2_REGION[2]} * 800')} AS mx,
  {r3_sql(f'((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 268435456 - {W2_REGION[1]}) / {W2_REGION[3]} * 600')} AS my FROM gp""")
def map_pixel_of(spark, sf):
    from ..operators.imaging import map_pixel_of as pixel

    mx, my = pixel(F.col("lat"), F.col("lon"), W2_REGION, 800, 600)
    return geo_places(spark, sf).select(F.col("centre_id").alias("point_id"), r3(mx).alias("mx"), r3(my).alias("my"))


@query("c8_coverage_footprints", f"""WITH {VERTICES_SQL}, ks AS (SELECT DISTINCT trow, tcol FROM v),
cn AS (SELECT trow, tcol, corner, 2600000.0 + (tcol + (corner IN (1, 2))::INT) * 160 AS x, 1200000.0 - (trow + 1 - (corner >= 2)::INT) * 160 AS y FROM ks, range(4) t(corner))
SELECT trow, tcol, corner::INT AS corner, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({from_lv95_sql('cn')})""")
def coverage_footprints(spark, sf):
    keys = terrain.vertices(spark, sf).select("trow", "tcol").distinct()
    found = catalogue.coverage_footprints(keys, GRID, lambda x, y: from_crs(x, y, 2056))
    return found.select("trow", "tcol", F.posexplode("corners").alias("corner", "p")).select("trow", "tcol", "corner", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def patches(spark, sf):
    keys = terrain.vertices(spark, sf).select("trow", "tcol").distinct()

    def place_of(trow, tcol):
        def place(col, row):
            # the tiles stretched to 50 km, so that the affine fit has something to be wrong about
            x, y = 2500000.0 + (tcol * 16 + col) * 300, 1300000.0 - ((trow + 1) * 16 - row) * 300
            ll = from_crs(x, y, 2056)
            return F.transform(F.array(ll), lambda p: to_crs(p["lon"], p["lat"], 2154))[0]

        return place

    return catalogue.tile_patches(keys, CELLS, place_of, 2.0)


@query("c9_tile_patches")
def tile_patches(spark, sf):
    return patches(spark, sf).groupBy("trow", "tcol", "size").agg(F.count(F.lit(1)).alias("n"), (F.max("residual") <= 2.0).alias("fits"))


@query("c10_patch_coverage", f"""WITH {CELLS_SQL}, runs AS (SELECT trow, tcol, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY trow, tcol, y ORDER BY x) AS k FROM c) GROUP BY trow, tcol, y, k),
rects AS (SELECT trow, tcol, x0, x1 + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY trow, tcol, x0, x1 ORDER BY y) AS k FROM runs) GROUP BY trow, tcol, x0, x1, k)
SELECT trow, tcol, pc, pr, sum((least(x1, pc + 8) - greatest(x0, pc)) * (least(y1, pr + 8) - greatest(y0, pr)))::DOUBLE AS area FROM rects, (SELECT unnest([0, 8]) AS pc) a, (SELECT unnest([0, 8]) AS pr) b
WHERE least(x1, pc + 8) > greatest(x0, pc) AND least(y1, pr + 8) > greatest(y0, pr) GROUP BY ALL""")
def patch_coverage(spark, sf):
    rects = tiles.coverage_rects(terrain.cells(spark, sf))
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("col0"), F.lit(j).alias("row0"), F.lit(8).alias("size")) for i in (0, 8) for j in (0, 8)]))
    parts = rects.select("trow", "tcol").distinct().withColumn("p", quarter).select("trow", "tcol", "p.*")
    return catalogue.patch_coverage(parts, rects).groupBy("trow", "tcol", "pc", "pr").agg(F.sum(F.col("width") * F.col("height")).cast("double").alias("area"))


@query("c11_native_if_partial", f"WITH {CELLS_SQL} SELECT trow, tcol, CASE WHEN count(*) < 256 THEN 1 ELSE 3 END AS lod FROM c GROUP BY 1, 2")
def native_if_partial(spark, sf):
    return terrain.cells(spark, sf).groupBy("trow", "tcol").agg(catalogue.native_if_partial(F.count(F.lit(1)), CELLS, F.lit(3)).alias("lod"))


@query("r16_recovered_steps", f"""WITH {HITS_SQL}, pa AS (SELECT view_id, px, py, t, t1, th, qc < 0 AS below, lag(t1) OVER w AS was FROM hit WINDOW w AS (PARTITION BY view_id, px, py ORDER BY t)),
ga AS (SELECT *, sum(CASE WHEN t - coalesce(was, 0) > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY view_id, px, py ORDER BY t ROWS UNBOUNDED PRECEDING) AS gaps FROM pa)
SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('min(CASE WHEN th IS NOT NULL THEN th WHEN below AND gaps = 0 THEN t END)')} AS distance FROM ga GROUP BY 1, 2, 3""")
def recovered_steps(spark, sf):
    cells, _ = tracing.prepared(spark, sf)
    path = trace.entries(rays.angular_rays(tracing.views(spark, sf)), cells, GRID)
    return trace.recovered_steps(path).groupBy("view_id", "px", "py").agg(r3(F.min("hit")).alias("distance"))


@query("r20_hit_positions", f"""WITH {GRAD_SQL}, hp AS (SELECT view_id, px, py, x + distance * dx AS x, y + distance * dy AS y FROM gg)
SELECT view_id, px::INT AS px, py::INT AS py, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({from_lv95_sql('hp')})""")
def hit_positions(spark, sf):
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    at = from_crs(F.col("x") + F.col("distance") * F.col("dx"), F.col("y") + F.col("distance") * F.col("dy"), 2056)
    return hits.withColumn("at", at).select("view_id", "px", "py", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))

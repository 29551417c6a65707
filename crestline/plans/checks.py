"""Queries of checks (V), coordinate text (I), map coordinates (G) and run logs (S10, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coordinates, geodesy
from ..operators import runs, tiles, validate
from . import terrain
from .geodesy_sql import from_lv95_sql, move_sql, offset_sql, to_lv95_sql
from .preparation import RANGE_SQL, RECTS_SQL
from .registry import query, r3, r3_sql, table
from .terrain import CELLS


def sources(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.cast("int").alias("source_id"), F.when(k % 11 == 5, 2154).otherwise(2056).alias("epsg"), F.when(k % 13 == 3, 5.0).otherwise(10.0).alias("res_x"),
        F.when(k % 17 == 4, 5.0).otherwise(-10.0).alias("res_y"), F.when(k % 19 == 1, 0.1).otherwise(0.0).alias("skew_x"), F.lit(0.0).alias("skew_y"),
        (2600000 + k * 10 + F.when(k % 7 == 2, 3.0).otherwise(0.0)).alias("x0"), (1200000 - k * 20).cast("double").alias("y0"),
        F.when(k % 23 == 6, 3).otherwise(1).alias("bands"), F.when(k % 9 == 8, "point").otherwise("area").alias("registration"), F.when(k % 29 == 9, "foot").otherwise("metre").alias("unit"))


@query("v1_check_sources", """WITH s AS (SELECT s_suppkey AS k, s_suppkey::INT AS source_id, CASE WHEN s_suppkey % 11 = 5 THEN 2154 ELSE 2056 END AS epsg, CASE WHEN s_suppkey % 13 = 3 THEN 5.0 ELSE 10.0 END AS rx,
  CASE WHEN s_suppkey % 17 = 4 THEN 5.0 ELSE -10.0 END AS ry, s_suppkey % 19 = 1 AS skew, CASE WHEN s_suppkey % 7 = 2 THEN 3 ELSE 0 END AS dx, CASE WHEN s_suppkey % 23 = 6 THEN 3 ELSE 1 END AS bands,
  CASE WHEN s_suppkey % 9 = 8 THEN 'point' ELSE 'area' END AS reg, CASE WHEN s_suppkey % 29 = 9 THEN 'foot' ELSE 'metre' END AS unit FROM supplier),
f AS (SELECT epsg AS fe, rx AS frx, ry AS fry, reg AS fr, unit AS fu, 2600000 + k * 10 + dx AS fx, 1200000 - k * 20 AS fy FROM s ORDER BY source_id LIMIT 1), b AS (SELECT * FROM s, f)
SELECT source_id, 'bands' AS rule FROM b WHERE bands <> 1 UNION ALL SELECT source_id, 'rotated' FROM b WHERE skew UNION ALL SELECT source_id, 'square' FROM b WHERE abs(abs(rx) - abs(ry)) > 1e-9
UNION ALL SELECT source_id, 'crs' FROM b WHERE epsg <> fe UNION ALL SELECT source_id, 'resolution' FROM b WHERE rx <> frx OR ry <> fry UNION ALL SELECT source_id, 'registration' FROM b WHERE reg <> fr
UNION ALL SELECT source_id, 'unit' FROM b WHERE unit <> fu
UNION ALL SELECT source_id, 'alignment' FROM b WHERE abs((2600000 + k * 10 + dx - fx) / frx - round((2600000 + k * 10 + dx - fx) / frx)) > 1e-6 OR abs((1200000 - k * 20 - fy) / fry - round((1200000 - k * 20 - fy) / fry)) > 1e-6""")
def check_sources(spark, sf):
    return validate.check_sources(sources(spark, sf))


@query("v4_check_manifest", f"""WITH {RANGE_SQL}, mf AS (SELECT trow, tcol, CASE WHEN tcol = 1 THEN zmax + 1 ELSE zmin END AS zmin, CASE WHEN trow = 0 THEN NULL ELSE zmax END AS zmax FROM r UNION ALL SELECT trow, tcol, zmin, zmax FROM r WHERE trow = tcol)
SELECT trow, tcol, 'bounds' AS rule FROM mf WHERE zmax IS NULL UNION ALL SELECT trow, tcol, 'order' FROM mf WHERE zmin > zmax
UNION ALL SELECT trow, tcol, 'duplicate' FROM (SELECT *, count(*) OVER (PARTITION BY trow, tcol) AS n FROM mf) WHERE n > 1""")
def check_manifest(spark, sf):
    every = tiles.elevation_range(terrain.vertices(spark, sf))
    odd = every.select("trow", "tcol", F.when(F.col("tcol") == 1, F.col("zmax") + 1).otherwise(F.col("zmin")).alias("zmin"), F.when(F.col("trow") != 0, F.col("zmax")).alias("zmax"))
    return validate.check_manifest(odd.unionByName(every.filter("trow = tcol")))


@query("v5_check_coverage", f"""WITH {RECTS_SQL}, w AS (SELECT trow, tcol, "column", row, CASE WHEN trow % 2 = 0 AND row = 3 THEN width + 3 ELSE width END AS width, height, row_number() OVER () AS id FROM rects)
SELECT DISTINCT trow, tcol, 'bounds' AS rule FROM w WHERE "column" + width > 16 OR row + height > 16
UNION ALL SELECT DISTINCT a.trow, a.tcol, 'overlap' FROM w a JOIN w b ON a.trow = b.trow AND a.tcol = b.tcol AND a.id < b.id AND a."column" < b."column" + b.width AND b."column" < a."column" + a.width AND a.row < b.row + b.height AND b.row < a.row + a.height""")
def check_coverage(spark, sf):
    rects = tiles.coverage_rects(terrain.cells(spark, sf))
    wide = rects.withColumn("width", F.when((F.col("trow") % 2 == 0) & (F.col("row") == 3), F.col("width") + 3).otherwise(F.col("width")))
    return validate.check_coverage(wide, CELLS)


@query("v6_check_stack", """WITH d AS (SELECT (s_suppkey // 2)::INT AS dataset_id, s_suppkey AS priority, CASE WHEN s_suppkey % 5 = 4 THEN 32 ELSE 16 END AS cells, CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE 0.5 END AS o FROM supplier)
SELECT dataset_id, 'duplicate' AS rule FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n FROM d) WHERE n > 1
UNION ALL SELECT dataset_id, 'cells' FROM d WHERE cells <> (SELECT arg_min(cells, priority) FROM d) UNION ALL SELECT dataset_id, 'offset' FROM d WHERE o IS NULL""")
def check_stack(spark, sf):
    k = F.col("s_suppkey")
    return validate.check_stack(table(spark, sf, "supplier").select(F.floor(k / 2).cast("int").alias("dataset_id"), k.alias("priority"), F.when(k % 5 == 4, 32).otherwise(16).alias("cells"),
                                                                    F.when(k % 7 != 6, 0.5).alias("vertical_offset_m")))


NAMES_SQL = "n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tile_r' || (p_partkey - 50) || '_c' || (7 - p_partkey) || '.ptile' WHEN 1 THEN 'a_r1_c2.x_r' || p_partkey || '_c-3.ptile' WHEN 2 THEN 'tile_r' || p_partkey || '.ptile' ELSE p_name END AS name FROM part)"


@query("v7_parse_tile_name", rf"""WITH {NAMES_SQL} SELECT p_partkey, try_cast(nullif(regexp_extract(name, '^.*_r(-?[0-9]+)_c(-?[0-9]+)\.[^.]*$', 1), '') AS BIGINT) AS trow,
  try_cast(nullif(regexp_extract(name, '^.*_r(-?[0-9]+)_c(-?[0-9]+)\.[^.]*$', 2), '') AS BIGINT) AS tcol FROM n""")
def parse_tile_name(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.format_string("tile_r%d_c%d.ptile", k - 50, 7 - k)).when(k % 4 == 1, F.format_string("a_r1_c2.x_r%d_c-3.ptile", k)).when(k % 4 == 2, F.format_string("tile_r%d.ptile", k)).otherwise(F.col("p_name"))
    row, col = validate.parse_tile_name(name)
    return table(spark, sf, "part").select("p_partkey", row.alias("trow"), col.alias("tcol"))


@query("v8_check_tile_position", "SELECT c_custkey AS id, abs((CASE WHEN c_custkey % 3 = 0 THEN 0.001 WHEN c_custkey % 3 = 1 THEN 0.0001 ELSE 0 END)) > 160e-6 AS misplaced FROM customer")
def check_tile_position(spark, sf):
    k = F.col("c_custkey")
    off = F.when(k % 3 == 0, 0.001).when(k % 3 == 1, 0.0001).otherwise(0.0)
    return table(spark, sf, "customer").select(k.alias("id"), validate.misplaced(2600000.0 + off, F.lit(1200000.0), F.lit(2600000.0), F.lit(1200000.0), 160.0).alias("misplaced"))


@query("v9_check_views", """WITH v AS (SELECT s_suppkey AS view_id, s_suppkey % 5 AS w, CASE WHEN s_suppkey % 7 = 3 THEN 'nan'::DOUBLE ELSE 0.1 END AS h, (s_suppkey % 4 - 1) * 0.1 AS step, s_suppkey % 13 * 15.0 AS fov, s_suppkey % 6 - 1 AS f FROM supplier)
SELECT view_id, 'image' AS rule FROM v WHERE w < 1 UNION ALL SELECT view_id, 'angles' FROM v WHERE isnan(h) UNION ALL SELECT view_id, 'step' FROM v WHERE step <= 0
UNION ALL SELECT view_id, 'fov' FROM v WHERE fov <= 0 OR fov >= 180 UNION ALL SELECT view_id, 'focal' FROM v WHERE f <= 0""")
def check_views(spark, sf):
    k = F.col("s_suppkey")
    return validate.check_views(table(spark, sf, "supplier").select(k.alias("view_id"), (k % 5).alias("width"), F.lit(10).alias("height"), F.when(k % 7 == 3, float("nan")).otherwise(0.1).alias("heading"),
                                                                    F.lit(0.0).alias("pitch"), ((k % 4 - 1) * 0.1).alias("step"), (k % 13 * 15.0).alias("fov"), (k % 6 - 1).alias("focal"), F.lit(100.0).alias("tmax")))


PEAKS_SQL = "pk AS (SELECT p_partkey AS peak_id, (p_partkey * 7 % 1900) / 10.0 - 95 AS lat, (p_partkey * 11 % 3600) / 10.0 - 180 AS lon, p_retailprice AS elevation, CASE WHEN p_size % 10 = 3 THEN NULL ELSE p_size * 1.0 END AS prominence, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS name FROM part)"


@query("v10_check_peaks", f"""WITH {PEAKS_SQL} SELECT peak_id, 'number' AS rule FROM pk WHERE prominence IS NULL UNION ALL SELECT peak_id, 'place' FROM pk WHERE abs(lat) > 90 OR abs(lon) > 180 UNION ALL SELECT peak_id, 'name' FROM pk WHERE trim(name) = ''""")
def check_peaks(spark, sf):
    k = F.col("p_partkey")
    return validate.check_peaks(table(spark, sf, "part").select(k.alias("peak_id"), (k * 7 % 1900 / 10.0 - 95).alias("lat"), (k * 11 % 3600 / 10.0 - 180).alias("lon"), F.col("p_retailprice").alias("elevation"),
                                                                F.when(F.col("p_size") % 10 != 3, F.col("p_size") * 1.0).alias("prominence"), F.when(k % 9 == 0, " ").otherwise(F.col("p_name")).alias("name")))


@query("v11_valid_lat_lon", "SELECT c_custkey AS id, abs(c_custkey * 0.7 - 60) <= 90 AND abs(c_custkey * 1.3 - 100) <= 180 AS ok FROM customer")
def valid_lat_lon(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), geodesy.valid_lat_lon(k * 0.7 - 60, k * 1.3 - 100).alias("ok"))


# map coordinates ------------------------------------------------------------


@query("g7_map_xy", f"SELECT c_custkey AS id, {r3_sql('(c_custkey * 0.11 - 80 + 180) / 360 * 268435456')} AS x, {r3_sql('(0.5 - ln((1 + sin((c_custkey % 150 - 75) * pi() / 180)) / (1 - sin((c_custkey % 150 - 75) * pi() / 180))) / (4 * pi())) * 268435456')} AS y FROM customer")
def map_xy(spark, sf):
    k = F.col("c_custkey")
    x, y = geodesy.map_xy(k % 150 - 75, k * 0.11 - 80)
    return table(spark, sf, "customer").select(k.alias("id"), r3(x).alias("x"), r3(y).alias("y"))


@query("g8_unwrap_lon", f"SELECT c_custkey AS id, {r3_sql('170 + (c_custkey * 1.7 - 900 - 170) - 360 * round_even((c_custkey * 1.7 - 900 - 170) / 360, 0)')} AS lon FROM customer")
def unwrap_lon(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), r3(geodesy.unwrap_lon(k * 1.7 - 900, F.lit(170.0))).alias("lon"))


@query("g1_crs_round_trip")
def crs_round_trip(spark, sf):
    """Places of each fixed system, to WGS84 and back."""
    k = F.col("c_custkey")
    base = table(spark, sf, "customer").select(k.alias("id"), (k % 500).alias("i"))
    found = None
    for epsg, x, y in ((2056, 2500000.0, 1100000.0), (2154, 300000.0, 6300000.0), (27700, 250000.0, 200000.0)):
        one = base.select("id", F.lit(epsg).alias("epsg"), (x + F.col("i") * 600).alias("x"), (y + F.col("i") * 300).alias("y"))
        one = one.withColumn("ll", geodesy.from_crs(F.col("x"), F.col("y"), epsg)).withColumn("b", geodesy.to_crs(F.col("ll.lon"), F.col("ll.lat"), epsg))
        one = one.select("id", "epsg", F.round("ll.lat", 6).alias("lat"), F.round("ll.lon", 6).alias("lon"), (F.hypot(F.col("b.x") - F.col("x"), F.col("b.y") - F.col("y")) < 0.05).alias("back"))
        found = one if found is None else found.unionByName(one)
    return found


GONE_SQL = "(SELECT c_custkey AS id, (c_custkey % 140 - 70)::DOUBLE AS lat0, (c_custkey * 0.9::DOUBLE) % 360 - 180 AS lon0, (c_custkey * 37 % 20000 - 10000)::DOUBLE AS e, (c_custkey * 91 % 30000 - 15000)::DOUBLE AS n FROM customer)"


@query("g2_g4_geodesics", f"""SELECT id, round(lat1, 6) AS lat, round(lon1, 6) AS lon, {r3_sql('east')} AS east, {r3_sql('north')} AS north FROM ({offset_sql('(' + move_sql(GONE_SQL) + ')')})""")
def geodesics(spark, sf):
    """Go somewhere, look back; the frame's axes on the way."""
    k = F.col("c_custkey")
    base = table(spark, sf, "customer").select(k.alias("id"), (k % 140 - 70.0).alias("lat"), (k * 0.9 % 360 - 180).alias("lon"), (k * 37.0 % 20000 - 10000).alias("e"), (k * 91.0 % 30000 - 15000).alias("n"))
    went = base.withColumn("p", geodesy.geodesic_move(F.col("lat"), F.col("lon"), F.col("e"), F.col("n")))
    back = went.withColumn("o", geodesy.geodesic_offset(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")))
    return back.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), r3(F.col("o.east")).alias("east"), r3(F.col("o.north")).alias("north"))


NORTH_SQL = f"""WITH pt AS (SELECT c_custkey AS id, 2500000.0::DOUBLE + c_custkey % 300 * 1000 AS x, 1100000.0::DOUBLE + c_custkey % 300 * 500 AS y FROM customer),
ll AS (SELECT id, x, y, lat AS lat0, lon AS lon0, 0.0::DOUBLE AS e, 10.0::DOUBLE AS n FROM ({from_lv95_sql('pt')})),
mv AS ({move_sql('ll')}), ax AS (SELECT id, (x1 - x) / sqrt(power(x1 - x, 2) + power(y1 - y, 2)) AS ne, (y1 - y) / sqrt(power(x1 - x, 2) + power(y1 - y, 2)) AS nn FROM ({to_lv95_sql('mv', 'lat1', 'lon1')}))"""


@query("g5_g6_true_north", NORTH_SQL + f""" SELECT id, round(nn, 6) AS ee, round(ne, 6) AS ne, {r3_sql('nn * 100 + ne * 200')} AS dx, round(1 + atan2(ne, nn), 6) AS azimuth FROM ax""")
def true_north(spark, sf):
    k = F.col("c_custkey") % 300
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (2500000.0 + k * 1000).alias("x"), (1100000.0 + k * 500).alias("y"))
    at = base.withColumn("ll", geodesy.from_crs(F.col("x"), F.col("y"), 2056)).withColumn("b", geodesy.true_north_basis(F.col("x"), F.col("y"), F.col("ll.lat"), F.col("ll.lon"), 2056))
    return at.select("id", F.round("b.ee", 6).alias("ee"), F.round("b.ne", 6).alias("ne"), r3(geodesy.frame_offset(F.col("b"), F.lit(100.0), F.lit(200.0))["x"]).alias("dx"),
                     F.round(geodesy.render_azimuth(F.col("b"), F.lit(1.0)), 6).alias("azimuth"))


# coordinate text --------------------------------------------------------------

TEXTS_SQL = """tx AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '46.' || o_orderkey % 1000 || ', 7.2' WHEN 1 THEN 'LV95 26' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || ', 1200000'
  WHEN 2 THEN 'NG ' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || ' 59877' WHEN 3 THEN 'SW1A 1AA' WHEN 4 THEN 'wgs84: ' || o_orderkey % 80 || ' ; -1.5e1' WHEN 5 THEN 'NG9 Hotel' WHEN 6 THEN o_orderpriority
  WHEN 7 THEN chr(65 + (o_orderkey % 26)::INT) || chr(65 + (o_orderkey // 26 % 26)::INT) || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') ELSE 'os ' || o_orderkey || ' 7' END AS text FROM orders)"""


def texts(spark, sf):
    k = F.col("o_orderkey")
    five = F.lpad((k % 100000).cast("string"), 5, "0")
    kinds = [F.concat(F.lit("46."), k % 1000, F.lit(", 7.2")), F.concat(F.lit("LV95 26"), five, F.lit(", 1200000")), F.concat(F.lit("NG "), five, F.lit(" 59877")), F.lit("SW1A 1AA"),
             F.concat(F.lit("wgs84: "), k % 80, F.lit(" ; -1.5e1")), F.lit("NG9 Hotel"), F.col("o_orderpriority"),
             F.concat(F.char(65 + k % 26), F.char(65 + F.floor(k / 26) % 26), F.lpad((k % 10000).cast("string"), 4, "0")), F.concat(F.lit("os "), k, F.lit(" 7"))]
    text = kinds[8]
    for i in range(7, -1, -1):
        text = F.when(k % 9 == i, kinds[i]).otherwise(text)
    return table(spark, sf, "orders").select(k.alias("id"), text.alias("text"))


LET = "'ABCDEFGHJKLMNOPQRSTUVWXYZ'"
SQUARES_SQL = f"""cp AS (SELECT *, upper(regexp_replace(text, '[ ,]', '', 'g')) AS c FROM tx),
sq AS (SELECT *, CASE WHEN i1 >= 0 AND i2 >= 0 THEN ((i1 + 8) % 5) * 5 + i2 % 5 END AS e, CASE WHEN i1 >= 0 AND i2 >= 0 THEN 19 - (i1 // 5) * 5 - i2 // 5 END AS n FROM (
  SELECT *, CASE WHEN length(c) > 1 THEN instr({LET}, c[1]) - 1 ELSE -1 END AS i1, CASE WHEN length(c) > 1 THEN instr({LET}, c[2]) - 1 ELSE -1 END AS i2 FROM cp)),
ok AS (SELECT *, coalesce(e <= 6 AND n BETWEEN 0 AND 12, false) AS inside FROM sq)"""


@query("i1_is_coordinate", rf"""WITH {TEXTS_SQL}, {SQUARES_SQL} SELECT id, regexp_matches(upper(text), '^(LATLON|WGS 84|WGS84|LV95|OSGB|BNG|OS|DATASET|PROJECTED)(:|\s|$)')
  OR (regexp_matches(upper(text), '^[0-9\s+\-.,;E]+$') AND regexp_matches(text, '[0-9+\-.,;]')) OR (regexp_matches(c, '^[A-HJ-Z][A-HJ-Z][0-9]+$') AND inside) AS is_coordinate FROM ok""")
def is_coordinate(spark, sf):
    return texts(spark, sf).select("id", coordinates.is_coordinate(F.col("text")).alias("is_coordinate"))


PRE = r"'^(LATLON|WGS 84|WGS84|LV95|OSGB|BNG|OS|DATASET|PROJECTED)(:|\s|$)'"
PREFIX_SQL = rf"""pf AS (SELECT id, text, CASE WHEN w IN ('LATLON', 'WGS84', 'WGS 84') THEN 'WGS84' WHEN w IN ('OSGB', 'BNG', 'OS') THEN 'OSGB' WHEN w IN ('DATASET', 'PROJECTED') THEN 'DATASET' ELSE nullif(w, '') END AS system,
  CASE WHEN w <> '' THEN trim(regexp_replace(upper(text), {PRE}, '')) ELSE text END AS rest FROM (SELECT *, regexp_extract(upper(text), {PRE}, 1) AS w FROM tx))"""


@query("i2_strip_prefix", f"WITH {TEXTS_SQL}, {PREFIX_SQL} SELECT id, system, rest FROM pf")
def strip_prefix(spark, sf):
    name, rest = coordinates.strip_prefix(F.col("text"))
    return texts(spark, sf).select("id", name.alias("system"), rest.alias("rest"))


NUM = r"([+-]?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?)"


@query("i3_parse_pair", rf"""WITH {TEXTS_SQL}, {PREFIX_SQL} SELECT id, try_cast(nullif(regexp_extract(rest, '^{NUM}[\s,;]+{NUM}$', 1), '') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(rest, '^{NUM}[\s,;]+{NUM}$', 2), '') AS DOUBLE) AS b FROM pf""")
def parse_pair(spark, sf):
    pair = coordinates.parse_pair(coordinates.strip_prefix(F.col("text"))[1])
    return texts(spark, sf).select("id", pair["a"].alias("a"), pair["b"].alias("b"))


@query("i4_parse_os_grid", f"""WITH {TEXTS_SQL}, {SQUARES_SQL}, g AS (SELECT *, inside AND regexp_matches(c, '^[A-HJ-Z][A-HJ-Z]([0-9][0-9])+$') AND length(c) <= 12 AS good, (length(c) - 2) // 2 AS h FROM ok)
SELECT id, CASE WHEN good THEN (e * 100000 + rpad(c[3:2 + h], 5, '0')::INT)::DOUBLE END AS x, CASE WHEN good THEN (n * 100000 + rpad(c[3 + h:], 5, '0')::INT)::DOUBLE END AS y FROM g""")
def parse_os_grid(spark, sf):
    at = coordinates.parse_os_grid(F.col("text"))
    return texts(spark, sf).select("id", at["x"].alias("x"), at["y"].alias("y"))


@query("i5_detect_systems")
def detect_systems(spark, sf):
    found = texts(spark, sf).select("id", coordinates.candidates(F.col("text"), 2056).alias("c"))
    return found.select("id", F.posexplode("c").alias("rank", "c")).select("id", "rank", "c.system", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("i5_detect_geographic")
def detect_geographic(spark, sf):
    """The same texts over a geographic terrain, whose system is asked only where no other takes the numbers."""
    found = texts(spark, sf).select("id", coordinates.candidates(F.col("text"), 4326).alias("c"))
    return found.select("id", F.posexplode("c").alias("rank", "c")).select("id", "rank", "c.system", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


# run logs ---------------------------------------------------------------------


def log_lines(spark, sf):
    k = F.col("event_id")
    depth = (k % 3).cast("int")
    return table(spark, sf, "events").select(
        F.floor(k / 50).alias("run_id"), (k % 50).alias("line"),
        F.concat(F.repeat(F.lit("  "), depth), F.col("event_type"), F.lit(" : "), F.format_string("%d.%d", k % 900, k % 10), F.lit(" ms (wall)"), F.when(k % 10 == 7, " x").otherwise("")).alias("text"))


LOG_SQL = """lg AS (SELECT event_id // 50 AS run_id, event_id % 50 AS line, (event_id % 3)::INT AS depth, event_type AS name, event_id % 900 + event_id % 10 / 10.0 AS ms FROM events WHERE event_id % 10 <> 7),
pa AS (SELECT *, CASE WHEN depth = 0 THEN name WHEN depth = 1 THEN coalesce(p0 || '/', '') || name ELSE coalesce(p0 || '/', '') || coalesce(p1 || '/', '') || name END AS path FROM (
  SELECT *, last_value(CASE WHEN depth = 0 THEN name END IGNORE NULLS) OVER w AS p0, last_value(CASE WHEN depth = 1 THEN name END IGNORE NULLS) OVER w AS p1 FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY line ROWS UNBOUNDED PRECEDING)))"""


@query("s10_parse_run_log", f"WITH {LOG_SQL} SELECT run_id, line, path, ms FROM pa")
def parse_run_log(spark, sf):
    return runs.parse_run_log(log_lines(spark, sf)).select("run_id", "line", "path", "ms")


@query("b1_summarise_runs", f"""SELECT user_id % 7 AS directory, event_id % 4 AS cache_mib, {r3_sql('median(value)')} AS median_ms, {r3_sql('median(value) FILTER (event_id % 5 > 1)')} AS warm_ms, count(*) AS n_runs FROM events WHERE event_id % 11 <> 0 GROUP BY 1, 2""")
def summarise_runs(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 7).alias("directory"), (F.col("event_id") % 4).alias("cache_mib"), (F.col("event_id") % 5).alias("repetition"), F.col("value").alias("ms"), (F.col("event_id") % 11 != 0).alias("ok"))
    return runs.summarise_runs(rows).select("directory", "cache_mib", r3(F.col("median_ms")).alias("median_ms"), r3(F.col("warm_ms")).alias("warm_ms"), "n_runs")


@query("b2_warm_quantiles", f"SELECT user_id % 50 AS run_id, {r3_sql('median(value)')} AS median_ms, {r3_sql('max(value)')} AS p95_ms FROM events WHERE event_id % 18 >= 6 GROUP BY 1")
def warm_quantiles(spark, sf):
    frames = table(spark, sf, "events").select((F.col("user_id") % 50).alias("run_id"), (F.col("event_id") % 18).alias("frame"), F.col("value").alias("ms"))
    return runs.warm_quantiles(frames, 6).select("run_id", r3(F.col("median_ms")).alias("median_ms"), r3(F.col("p95_ms")).alias("p95_ms"))

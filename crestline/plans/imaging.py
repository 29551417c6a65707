"""Queries of shading (H), the visibility map (W) and the sun (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shading, solar
from ..operators import imaging, trace
from ..storage import written
from . import terrain, tracing
from .registry import query, r3, r3_sql, table
from .terrain import GRID
from .tracing import GRAD_SQL, HITS_SQL, K

SUN = shading.sun_vector(3.9, 0.6)


def vertices(spark, sf):
    return terrain.mosaic(spark, sf)


def normal_sql(scale: str, x: str) -> str:
    v = f"least(greatest(({x}), 0), 1)"
    return {"linear": v, "log": f"log2(1 + 255 * {v}) / 8", "sqrt": f"sqrt({v})", "square": f"{v} * {v}"}[scale]


@query("h1_normalise", f"""WITH {terrain.MOSAIC_SQL} SELECT col, row, {', '.join(f"{r3_sql(normal_sql(s, '(z - 100) / (1900 - 100)'))} AS {s}_scale" for s in ('linear', 'log', 'sqrt', 'square'))} FROM m""")
def normalise(spark, sf):
    return vertices(spark, sf).select("col", "row", *[r3(shading.normalise(F.col("z"), 100, 1900, s)).alias(f"{s}_scale") for s in ("linear", "log", "sqrt", "square")])


def palette_sql(x: str, name: str, k: int) -> str:
    stops = [float(s[k]) for s in shading.PALETTES[name]]
    v = f"least(greatest(({x}), 0), 1)"
    low = f"greatest(least(ceil({v} * 4) - 1, 3), 0)::INT"
    a, b = f"({stops})[{low} + 1]", f"({stops})[{low} + 2]"
    return f"floor(least(greatest({a} + ({v} * 4 - {low}) * ({b} - {a}), 0), 255) + 0.5)::INT"


X_SQL = "(z - 100) / 1800"


@query("h2_colourmap", f"""WITH {terrain.MOSAIC_SQL} SELECT col, row, {', '.join(f"{palette_sql(X_SQL, n, k)} AS {n}_{'rgb'[k]}" for n in ('viridis', 'turbo') for k in range(3))} FROM m""")
def colourmap(spark, sf):
    x = (F.col("z") - 100) / 1800
    return vertices(spark, sf).select("col", "row", *[c.alias(f"{n}_{'rgb'[k]}") for n in ("viridis", "turbo") for k, c in enumerate(shading.colourmap(x, n))])


@query("h3_scalar_image", f"""WITH {HITS_SQL}, d AS (SELECT ry.*, coalesce(distance, 0) AS d FROM ry LEFT JOIN fh ON ry.view_id = fh.view_id AND ry.px = fh.px AND ry.py = fh.py)
SELECT view_id, px::INT AS px, py::INT AS py, {', '.join(f"{palette_sql('d / 300', 'viridis', k)} AS {'rgb'[k]}" for k in range(3))} FROM d""")
def scalar_image(spark, sf):
    cells, manifest = tracing.prepared(spark, sf)
    hits = trace.trace(tracing.views(spark, sf), cells, manifest, GRID)
    return hits.select("view_id", "px", "py", *[c.alias("rgb"[k]) for k, c in enumerate(shading.scalar_image(F.col("distance"), 0.0, 300.0))])


NORMAL_SQL = f"{GRAD_SQL}, nm AS (SELECT *, -grad_e / sqrt(grad_e*grad_e + grad_n*grad_n + 1) AS ne, -grad_n / sqrt(grad_e*grad_e + grad_n*grad_n + 1) AS nn, 1 / sqrt(grad_e*grad_e + grad_n*grad_n + 1) AS nu FROM gg)"


@query("h4_normal_image", f"WITH {NORMAL_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {', '.join(f'floor(least(greatest(0.5 * {n} + 0.5, 0), 1) * 255 + 0.5)::INT AS {c}' for n, c in (('ne', 'r'), ('nn', 'g'), ('nu', 'b')))} FROM nm")
def normal_image(spark, sf):
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    return hits.select("view_id", "px", "py", *[c.alias("rgb"[k]) for k, c in enumerate(shading.normal_image(F.col("distance"), F.col("grad_e"), F.col("grad_n")))])


def _light_sql() -> str:
    import math

    sx, sy = SUN[0] / math.hypot(*SUN[:2]), SUN[1] / math.hypot(*SUN[:2])
    lobes, level = "1.5 * greatest(nu, 0)", 1.5
    for ex, ey in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        w = 1 + 0.75 * max((ex * sx + ey * sy) * math.sqrt(0.5), 0)
        lobes += f" + {w!r} * greatest({0.5 * ex} * ne + {0.5 * ey} * nn + {math.sqrt(0.5)!r} * nu, 0)"
        level += w * math.sqrt(0.5)
    return f"(1 + (0.35 + 0.65 * least(greatest(({lobes}) / {level!r}, 0), 1) - 1) * 0.65)"


SKY_SQL = _light_sql()
LIGHT_SQL = f"{NORMAL_SQL}, lt AS (SELECT *, {SKY_SQL} AS sky, 0.28 * {SKY_SQL} + 0.72 * greatest(ne * {SUN[0]!r} + nn * {SUN[1]!r} + nu * {SUN[2]!r}, 0) AS li FROM nm)"


def srgb_sql(c: str) -> str:
    return f"floor(least(greatest(CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * power({c}, 1 / 2.4) - 0.055 END, 0), 1) * 255 + 0.5)::INT"


@query("h5_sky_exposure", f"WITH {LIGHT_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('sky')} AS sky FROM lt")
def sky_exposure(spark, sf):
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    return hits.select("view_id", "px", "py", r3(shading.sky_exposure(shading.normal(F.col("grad_e"), F.col("grad_n")), SUN, 0.65)).alias("sky"))


@query("h6_shade_white", f"WITH {LIGHT_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {srgb_sql('li')} AS grey FROM lt")
def shade_white(spark, sf):
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    return hits.select("view_id", "px", "py", shading.shade_white(F.col("distance"), F.col("grad_e"), F.col("grad_n"), SUN, F.lit(True)).alias("grey"))


def _coloured(k: int) -> str:
    c = f"({palette_sql('elevation / 2000', 'magma', k)} / 255.0)"
    linear = f"(CASE WHEN {c} > 0.04045 THEN power(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END * li)"
    return f"{srgb_sql(linear)} AS {'rgb'[k]}"


@query("h7_shade_coloured", f"WITH {LIGHT_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {', '.join(map(_coloured, range(3)))} FROM lt")
def shade_coloured(spark, sf):
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    rgb = shading.shade_coloured(F.col("distance"), F.col("grad_e"), F.col("grad_n"), SUN, F.lit(True), F.col("elevation") / 2000, "magma")
    return hits.select("view_id", "px", "py", *[c.alias("rgb"[k]) for k, c in enumerate(rgb)])


def _outline_sql() -> str:
    base = 24 - 18 * 0.65
    limits = (max(1.35, 0.45 * base), max(1.5, 0.75 * base), max(1.25, 0.55 * base))
    joins, conds = "", []
    for d, (ox, oy) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1))):
        hit = []
        for r, limit in zip((1, 2, 4), limits, strict=True):
            n = f"n{d}{r}"
            joins += f" LEFT JOIN al {n} ON {n}.view_id = a.view_id AND {n}.px = a.px + {ox * r} AND {n}.py = a.py + {oy * r}"
            chord = f"sqrt(power(a.dx / a.le - {n}.dx / {n}.le, 2) + power(a.dy / a.le - {n}.dy / {n}.le, 2) + power(a.slope / a.le - {n}.slope / {n}.le, 2))"
            actual = f"sqrt(power({n}.d * {n}.dx - a.d * a.dx, 2) + power({n}.d * {n}.dy - a.d * a.dy, 2) + power({n}.up - a.up, 2))"
            hit.append(f"coalesce({n}.d > a.d AND {actual} / greatest(least(a.d * a.le, {n}.d * {n}.le) * {chord}, 1) > {limit}, false)")
        conds.append(f"(n{d}1.view_id IS NOT NULL AND n{d}1.d IS NULL) OR ({hit[0]} AND ({hit[1]} OR {hit[2]}))")
    return f"a.d IS NOT NULL AND ({' OR '.join(conds)}) AS outline FROM al a{joins}"


@query("h8_feature_outlines", f"""WITH {HITS_SQL}, al AS (SELECT ry.*, distance AS d, sqrt(dx*dx + dy*dy + slope*slope) AS le, distance * slope + {K!r} * distance * distance AS up
  FROM ry LEFT JOIN fh ON ry.view_id = fh.view_id AND ry.px = fh.px AND ry.py = fh.py)
SELECT a.view_id, a.px::INT AS px, a.py::INT AS py, {_outline_sql()}""")
def outlines(spark, sf):
    cells, manifest = tracing.prepared(spark, sf)
    hits = written(trace.trace(tracing.views(spark, sf), cells, manifest, GRID), "hits")
    return imaging.feature_outlines(hits).select("view_id", "px", "py", "outline")


@query("h9_pack_rgb", f"WITH {terrain.MOSAIC_SQL} SELECT col, row, floor(least(greatest(z / 1500, 0), 1) * 255 + 0.5)::INT AS byte FROM m")
def pack_rgb(spark, sf):
    return vertices(spark, sf).select("col", "row", shading.pack_rgb(F.col("z") / 1500).alias("byte"))


W, H = 64, 48
POINTS_SQL = f"{HITS_SQL}, vp AS (SELECT view_id, px, py, distance * dx AS east, distance * dy AS north FROM (SELECT ry.*, distance FROM ry JOIN fh ON ry.view_id = fh.view_id AND ry.px = fh.px AND ry.py = fh.py) WHERE distance > 0)"
MAP_SQL = f"{POINTS_SQL}, mp AS (SELECT view_id, 32 + east * 0.4 + north * 0.1 AS mx, 24 + east * 0.1 + north * -0.4 AS my FROM vp)"


def mapped(spark, sf):
    cells, manifest = tracing.prepared(spark, sf)
    points = imaging.visible_points(trace.trace(tracing.views(spark, sf), cells, manifest, GRID))
    mx, my = imaging.map_pixel(F.col("east"), F.col("north"), (32.0, 24.0), (0.4, 0.1), (0.1, -0.4))
    return points.withColumns({"mx": mx, "my": my})


@query("w1_visible_points", f"WITH {POINTS_SQL} SELECT view_id, px::INT AS px, py::INT AS py, {r3_sql('east')} AS east, {r3_sql('north')} AS north FROM vp")
def visible_points(spark, sf):
    return mapped(spark, sf).select("view_id", "px", "py", r3(F.col("east")).alias("east"), r3(F.col("north")).alias("north"))


@query("w2_map_pixel", f"WITH {MAP_SQL} SELECT view_id, {r3_sql('mx')} AS mx, {r3_sql('my')} AS my FROM mp")
def map_pixel(spark, sf):
    return mapped(spark, sf).select("view_id", r3(F.col("mx")).alias("mx"), r3(F.col("my")).alias("my"))


@query("w3_visibility_mask", f"""WITH {MAP_SQL} SELECT px::INT AS px, py::INT AS py, count(*) AS n_points, count(DISTINCT view_id) AS n_views FROM (
  SELECT view_id, ceil(mx - 1.5) + i AS px, ceil(my - 1.5) + j AS py FROM mp, (SELECT unnest([0, 1]) AS i) a, (SELECT unnest([0, 1]) AS j) b WHERE mx BETWEEN -1 AND {W + 1} AND my BETWEEN -1 AND {H + 1})
WHERE px BETWEEN 0 AND {W - 1} AND py BETWEEN 0 AND {H - 1} GROUP BY 1, 2""")
def visibility_mask(spark, sf):
    return imaging.visibility_mask(mapped(spark, sf), W, H, ["view_id"])


# sun -------------------------------------------------------------------------

DATE_SQL = "lpad((o_orderkey % 33)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || (1570 + o_orderkey % 500)::VARCHAR AS d, lpad((o_orderkey % 26)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 63)::VARCHAR, 2, '0') AS t"


@query("a1_parse_date_time", f"""WITH s AS (SELECT o_orderkey, {DATE_SQL} FROM orders) SELECT o_orderkey, strftime(CASE WHEN t[1:2] < '24' AND t[4:5] < '60' AND d[7:10] >= '1583'
  THEN try_cast(d[7:10] || '-' || d[4:5] || '-' || d[1:2] || ' ' || t || ':00' AS TIMESTAMP) END, '%Y-%m-%d %H:%M') AS parsed FROM s""")
def parse_date_time(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("o_orderkey")
    date = F.concat(two(k % 33), F.lit("-"), two(k % 14), F.lit("-"), (1570 + k % 500).cast("string"))
    time = F.concat(two(k % 26), F.lit(":"), two(k % 63))
    return table(spark, sf, "orders").select(k, F.date_format(solar.parse_date_time(date, time), "yyyy-MM-dd HH:mm").alias("parsed"))


ZONES = ["Europe/Zurich", "America/New_York", "Asia/Kolkata"]


@query("a2_local_to_utc", f"""WITH e AS (SELECT event_id, TIMESTAMP '2026-03-29 00:00:00' + (event_id * 17 % 400) * INTERVAL 1 MINUTE AS l, ({ZONES})[1 + event_id % 3] AS z FROM events)
SELECT event_id, strftime(CASE WHEN ((l AT TIME ZONE z) AT TIME ZONE z) = l THEN (l AT TIME ZONE z) AT TIME ZONE 'UTC' END, '%Y-%m-%d %H:%M') AS utc FROM e""")
def local_to_utc(spark, sf):
    ts = F.timestamp_add("MINUTE", F.col("event_id") * 17 % 400, F.lit("2026-03-29 00:00:00").cast("timestamp"))
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", F.date_format(solar.local_to_utc(ts, zone), "yyyy-MM-dd HH:mm").alias("utc"))


def ephemeris_sql(src: str, minutes: str) -> str:
    """Chained CTEs over src(id, lat, lon, ts): the sun at the given minutes of the day."""
    r = "(pi() / 180)"
    return f"""jd AS (SELECT *, {minutes} AS mi, CASE WHEN month(ts) > 2 THEN year(ts) ELSE year(ts) - 1 END AS yy, CASE WHEN month(ts) > 2 THEN month(ts) ELSE month(ts) + 12 END AS mm FROM {src}),
jt AS (SELECT *, (floor(365.25 * (yy + 4716)) + floor(30.6001 * (mm + 1)) + day(ts) + mi / 1440.0 + 2 - floor(yy / 100.0) + floor(floor(yy / 100.0) / 4) - 1524.5 - 2451545.0) / 36525.0::DOUBLE AS tc FROM jd),
e1 AS (SELECT *, 280.46646 + tc * (36000.76983 + 0.0003032 * tc) AS l0, (357.52911 + tc * (35999.05029 - 0.0001537 * tc)) * {r} AS an, 0.016708634 - tc * (0.000042037 + 0.0000001267 * tc) AS ec,
  (125.04 - 1934.136 * tc) * {r} AS om, 21.448 - tc * (46.815 + tc * (0.00059 - tc * 0.001813)) AS se FROM jt),
e2 AS (SELECT *, l0 - 360 * floor(l0 / 360) AS ml, sin(an) * (1.914602 - tc * (0.004817 + 0.000014 * tc)) + sin(2 * an) * (0.019993 - 0.000101 * tc) + sin(3 * an) * 0.000289 AS ce,
  (23 + (26 + se / 60) / 60) * {r} + 0.00256 * {r} * cos(om) AS ti FROM e1),
e3 AS (SELECT *, asin(sin(ti) * sin((ml + ce - 0.00569 - 0.00478 * sin(om)) * {r})) AS de, power(tan(ti / 2), 2) AS vy, ml * {r} AS lr FROM e2),
ep AS (SELECT *, 4 / {r} * (vy * sin(2 * lr) - 2 * ec * sin(an) + 4 * ec * vy * sin(an) * cos(2 * lr) - 0.5 * vy * vy * sin(4 * lr) - 1.25 * ec * ec * sin(2 * an)) AS eq FROM e3)"""


PLACE_SQL = "src AS (SELECT event_id AS id, (user_id * 7 % 1780) / 10.0 - 89.0 AS lat, (user_id * 13 % 3600) / 10.0 - 180.0 AS lon, ts FROM events)"


def places(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 7 % 1780 / 10.0 - 89.0).alias("lat"), (F.col("user_id") * 13 % 3600 / 10.0 - 180.0).alias("lon"), "ts")


@query("a3_solar_position", f"""WITH {PLACE_SQL}, {ephemeris_sql('src', 'hour(ts) * 60 + minute(ts)')},
ha AS (SELECT *, ((mi + eq + 4 * lon) - 1440 * floor((mi + eq + 4 * lon) / 1440)) / 4 - 180 AS hd FROM ep), hr AS (SELECT *, hd * pi() / 180 AS h, lat * pi() / 180 AS la FROM ha),
az AS (SELECT *, atan2(sin(h), cos(h) * sin(la) - tan(de) * cos(la)) * 180 / pi() + 180 AS a FROM hr)
SELECT id, {r3_sql('a - 360 * floor(a / 360)')} AS azimuth, {r3_sql('asin(least(greatest(sin(la) * sin(de) + cos(la) * cos(de) * cos(h), -1), 1)) * 180 / pi()')} AS elevation FROM az""")
def solar_position(spark, sf):
    found = places(spark, sf).select("id", solar.solar_place(F.col("lat"), F.col("lon"), F.col("ts")).alias("s"))
    return found.select("id", r3(F.col("s.azimuth") / solar.RAD).alias("azimuth"), r3(F.col("s.elevation") / solar.RAD).alias("elevation"))


@query("a4_daylight_times", f"""WITH {PLACE_SQL}, {ephemeris_sql('src', '720')}, co AS (SELECT *, -tan(lat * pi() / 180) * tan(de) AS c FROM ep)
SELECT id, CASE WHEN c <= -1 THEN 'PolarDay' WHEN c >= 1 THEN 'PolarNight' ELSE 'Normal' END AS state,
  {r3_sql("CASE WHEN c > -1 AND c < 1 THEN 720 - 4 * lon - eq - 4 * acos(least(greatest(c, -1), 1)) * 180 / pi() ELSE 0 END")} AS sunrise,
  {r3_sql("CASE WHEN c > -1 AND c < 1 THEN 720 - 4 * lon - eq + 4 * acos(least(greatest(c, -1), 1)) * 180 / pi() ELSE 0 END")} AS sunset FROM co""")
def daylight_times(spark, sf):
    found = places(spark, sf).select("id", solar.daylight_times(F.col("lat"), F.col("lon"), F.col("ts")).alias("d"))
    return found.select("id", "d.state", r3(F.col("d.sunrise")).alias("sunrise"), r3(F.col("d.sunset")).alias("sunset"))


#: Three instants for each view, some at night; the observer's place comes from its key.
SUNS_SQL = f"""src AS (SELECT s_suppkey AS id, 46.0::DOUBLE + (s_suppkey % 10) AS lat, 7.0::DOUBLE + (s_suppkey % 7) AS lon, instant,
  TIMESTAMP '2026-06-21 00:00:00' + (s_suppkey * 37 % 240 + instant * 480)::INT * INTERVAL 1 MINUTE AS ts FROM supplier, range(3) i(instant)), {ephemeris_sql('src', 'hour(ts) * 60 + minute(ts)')},
ha AS (SELECT *, ((((mi + eq + 4 * lon) - 1440 * floor((mi + eq + 4 * lon) / 1440)) / 4 - 180) * pi() / 180) AS ho, lat * pi() / 180 AS la FROM ep),
suns AS (SELECT id, instant, atan2(sin(ho), cos(ho) * sin(la) - tan(de) * cos(la)) + pi() AS sa, asin(least(greatest(sin(la) * sin(de) + cos(la) * cos(de) * cos(ho), -1), 1)) AS el FROM ha),
sr AS (SELECT view_id * 10 + instant AS view_id, px, py, x + distance * dx + 0.5 * sin(sa) AS x, y + distance * dy + 0.5 * cos(sa) AS y, elevation + 0.5 * tan(el) + 0.05 AS z, sin(sa) AS dx, cos(sa) AS dy, tan(el) AS slope
  FROM gg JOIN suns ON id = view_id WHERE el > 0 AND distance > 0 AND -grad_e * sin(sa) - grad_n * cos(sa) + tan(el) > 0)"""


@query("a5_sunlit_hits", f"""WITH {tracing.GRAD_SQL}, {SUNS_SQL}, {tracing.again(tracing.CELL_PATH_SQL)}, {tracing.again(tracing.BILINEAR_SQL)}
SELECT gg.view_id, gg.px::INT AS px, gg.py::INT AS py, instant, el > 0 AND s_fh.distance IS NULL AS lit FROM gg JOIN suns ON id = gg.view_id
  LEFT JOIN s_fh ON gg.view_id * 10 + instant = s_fh.view_id AND gg.px = s_fh.px AND gg.py = s_fh.py""")
def sunlit_hits(spark, sf):
    """A3, R19 for three instants of each view: one trace, one pass of shadows."""
    hits, cells, manifest = tracing.hits_with_gradients(spark, sf)
    key = F.col("s_suppkey")
    at = table(spark, sf, "supplier").select(key.alias("view_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("instant"))
    at = at.withColumn("ts", F.expr("timestamp_ntz'2026-06-21 00:00:00' + make_dt_interval(0, 0, cast(view_id * 37 % 240 + instant * 480 as int))"))
    suns = at.withColumn("s", solar.solar_place(46.0 + F.col("view_id") % 10, 7.0 + F.col("view_id") % 7, F.col("ts"))).select("view_id", "instant", "s.azimuth", "s.elevation")
    return trace.sunlit_hits(hits, suns, cells, manifest, GRID, tracing.RANGE).select("view_id", "px", "py", "instant", "lit")


@query("a6_local_clock", f"""SELECT event_id, strftime(((DATE '2026-07-01' + (event_id % 5)::INT)::TIMESTAMP + (event_id * 37 % 3000 - 700) * INTERVAL 1 MINUTE) AT TIME ZONE 'UTC' AT TIME ZONE ({ZONES})[1 + event_id % 3], '%H:%M') AS clock FROM events""")
def local_clock(spark, sf):
    date = F.date_add(F.lit("2026-07-01").cast("date"), (F.col("event_id") % 5).cast("int"))
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", solar.local_clock(date, (F.col("event_id") * 37 % 3000 - 700).cast("double"), zone).alias("clock"))

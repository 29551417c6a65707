"""Queries of tile preparation (T) and sample checks (V2, V3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles
from . import terrain
from .registry import query, r3, r3_sql, table
from .terrain import CELLS, CELLS_SQL, GRID, MOSAIC_SQL, SAMPLES_SQL, VERTICES_SQL


@query("v2_valid_samples", f"""WITH {SAMPLES_SQL} SELECT source_id, count(*) AS n_samples, count(*) FILTER (mask <> 0 AND value::FLOAT <> (20.0)::FLOAT) AS n_valid FROM s GROUP BY 1""")
def valid_samples(spark, sf):
    ok = tiles.valid_sample(F.col("value"), F.lit(20.0), F.col("mask"))
    return terrain.samples(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(ok).alias("n_valid"))


@query("v3_srtm_floor", f"""WITH {SAMPLES_SQL} SELECT source_id % 2 = 0 AS is_srtm, count(*) AS n_samples, count(*) FILTER (source_id % 2 <> 0 OR value - 1500 >= -1000) AS n_kept FROM s GROUP BY 1""")
def srtm_floor(spark, sf):
    srtm = F.col("source_id") % 2 == 0
    return terrain.samples(spark, sf).groupBy(srtm.alias("is_srtm")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(tiles.above_floor(F.col("value") - 1500, srtm, -1000.0)).alias("n_kept"))


@query("t1_assign_tiles", f"""WITH {VERTICES_SQL} SELECT trow, tcol, count(*) AS n_vertices, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM v GROUP BY 1, 2""")
def assign_tiles(spark, sf):
    return terrain.vertices(spark, sf).groupBy("trow", "tcol").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("t2_mosaic", f"""WITH {MOSAIC_SQL} SELECT col, row, round(z, 3) AS z FROM m""")
def mosaic(spark, sf):
    return terrain.mosaic(spark, sf).select("col", "row", F.round("z", 3).alias("z"))


@query("t3_scale_offset", f"""WITH {SAMPLES_SQL} SELECT source_id, {r3_sql('min(value * 0.5 + source_id % 7)')} AS lo, {r3_sql('max(value * 0.5 + source_id % 7)')} AS hi FROM s GROUP BY 1""")
def scale_offset(spark, sf):
    z = tiles.scale_offset(F.col("value"), F.lit(0.5), (F.col("source_id") % 7).cast("double"))
    return terrain.samples(spark, sf).groupBy("source_id").agg(r3(F.min(z)).alias("lo"), r3(F.max(z)).alias("hi"))


LOD_SQL = f"""WITH {VERTICES_SQL},
l2 AS (SELECT trow, tcol, y // 2 AS y, x // 2 AS x, z FROM v WHERE x % 2 = 0 AND y % 2 = 0 AND (x IN (0, 16) OR y IN (0, 16))
  UNION ALL SELECT a.trow, a.tcol, a.y // 2, a.x // 2, @VALUE
  FROM (SELECT trow, tcol, y * 2 AS y, x * 2 AS x FROM (SELECT DISTINCT trow, tcol FROM v), range(1, 8) t(x), range(1, 8) u(y)) a
  JOIN v b ON a.trow = b.trow AND a.tcol = b.tcol AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.trow, a.tcol, a.y, a.x HAVING count(*) = 9)
SELECT trow, tcol, y::INT AS y, x::INT AS x, {r3_sql('z')} AS z FROM l2"""


def _lod(method):
    def run(spark, sf):
        return tiles.lod_step(terrain.vertices(spark, sf), CELLS, method).select("trow", "tcol", "y", "x", r3(F.col("z")).alias("z"))

    return run


query("t4_lod_mean", LOD_SQL.replace("@VALUE", "sum(z * (2 - abs(a.x - b.x)) * (2 - abs(a.y - b.y))) / 16"))(_lod("mean"))
query("t4_lod_max", LOD_SQL.replace("@VALUE", "max(z)"))(_lod("max"))
query("t4_lod_point", f"WITH {VERTICES_SQL} SELECT trow, tcol, (y // 2)::INT AS y, (x // 2)::INT AS x, {r3_sql('z')} AS z FROM v WHERE x % 2 = 0 AND y % 2 = 0")(_lod("point"))


@query("t5_usable_cells", f"""WITH {CELLS_SQL} SELECT trow, tcol, y, x, round(z00, 3) AS z00, round(z01, 3) AS z01, round(z10, 3) AS z10, round(z11, 3) AS z11 FROM c""")
def usable_cells(spark, sf):
    return terrain.cells(spark, sf).select("trow", "tcol", "y", "x", *[F.round(z, 3).alias(z) for z in ("z00", "z01", "z10", "z11")])


RECTS_SQL = CELLS_SQL + """,
runs AS (SELECT trow, tcol, y, min(x) AS x0, max(x) AS x1 FROM (
  SELECT *, x - row_number() OVER (PARTITION BY trow, tcol, y ORDER BY x) AS k FROM c) GROUP BY trow, tcol, y, k),
rects AS (SELECT trow, tcol, x0 AS "column", min(y) AS row, x1 - x0 + 1 AS width, count(*)::INT AS height FROM (
  SELECT *, y - row_number() OVER (PARTITION BY trow, tcol, x0, x1 ORDER BY y) AS k FROM runs) GROUP BY trow, tcol, x0, x1, k)"""


@query("t6_coverage_rects", f"""WITH {RECTS_SQL} SELECT * FROM rects""")
def coverage_rects(spark, sf):
    return tiles.coverage_rects(terrain.cells(spark, sf))


POINTS_SQL = """pts AS (SELECT c_custkey AS id, (c_custkey * 37 % (n * 10)) / 10.0 AS gx, (c_custkey * 91 % (n * 10)) / 10.0 AS gy FROM customer, g)"""


@query("t7_covers", f"""WITH {RECTS_SQL}, {POINTS_SQL},
p AS (SELECT id, floor(gx / 16)::BIGINT AS tcol, floor(gy / 16)::BIGINT AS trow, gx - floor(gx / 16) * 16 AS px, 16 - (gy - floor(gy / 16) * 16) AS py FROM pts)
SELECT id, bool_or(coalesce(px >= "column" AND px < "column" + width AND py >= row AND py < row + height, false)) AS covered
FROM p LEFT JOIN rects r ON p.trow = r.trow AND p.tcol = r.tcol GROUP BY id""")
def covers(spark, sf):
    n = terrain.side(spark, sf)
    at = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % (n * 10) / 10.0).alias("gx"), (F.col("c_custkey") * 91 % (n * 10) / 10.0).alias("gy"))
    points = at.select("id", F.floor(F.col("gx") / 16).alias("tcol"), F.floor(F.col("gy") / 16).alias("trow"), (F.col("gx") - F.floor(F.col("gx") / 16) * 16).alias("px"),
                       (16 - (F.col("gy") - F.floor(F.col("gy") / 16) * 16)).alias("py"))
    return tiles.covers(points, tiles.coverage_rects(terrain.cells(spark, sf))).select("id", "covered")


@query("t7_covered_area", f"""WITH {RECTS_SQL} SELECT trow, tcol, round(sum(greatest(least(12.5, "column" + width) - greatest(2.5, "column"), 0) * greatest(least(11.0, row + height) - greatest(1.25, row), 0)), 3)::DOUBLE AS area FROM rects GROUP BY 1, 2""")
def covered_area(spark, sf):
    area = tiles.overlap_area(F.lit(2.5), F.lit(1.25), F.lit(12.5), F.lit(11.0))
    return tiles.coverage_rects(terrain.cells(spark, sf)).groupBy("trow", "tcol").agg(F.round(F.sum(area), 3).alias("area"))


QUANT_SQL = VERTICES_SQL + """,
q AS (SELECT trow, tcol, y, x, z, min(round(z * 10)::BIGINT) OVER (PARTITION BY trow, tcol) - 1 AS base_dm, round(z * 10)::BIGINT AS dm FROM v)"""


@query("t8_quantize", f"""WITH {QUANT_SQL} SELECT trow, tcol, y, x, base_dm, (dm - base_dm)::INT AS code FROM q""")
def quantize(spark, sf):
    return tiles.quantize(terrain.vertices(spark, sf))


@query("t9_dequantize", f"""WITH {QUANT_SQL} SELECT trow, tcol, y, x, round(dm / 10.0, 3) AS z FROM q""")
def dequantize(spark, sf):
    coded = tiles.quantize(terrain.vertices(spark, sf))
    return coded.select("trow", "tcol", "y", "x", F.round(tiles.dequantize(F.col("base_dm"), F.col("code")), 3).alias("z"))


RANGE_SQL = VERTICES_SQL + """,
r AS (SELECT trow, tcol, lo - w AS zmin, hi + w AS zmax FROM (SELECT *, 4 * power(2.0, -23) * greatest(1, abs(lo), abs(hi)) AS w FROM (
  SELECT trow, tcol, min(z) AS lo, max(z) AS hi FROM v GROUP BY 1, 2)))"""


@query("t10_elevation_range", f"""WITH {RANGE_SQL} SELECT trow, tcol, round(zmin, 3) AS zmin, round(zmax, 3) AS zmax FROM r""")
def elevation_range(spark, sf):
    return tiles.elevation_range(tiles.lod_pyramid(terrain.vertices(spark, sf), CELLS, 3, "point")).select("trow", "tcol", F.round("zmin", 3).alias("zmin"), F.round("zmax", 3).alias("zmax"))


@query("t11_build_manifest", f"""WITH {RANGE_SQL},
nw AS (SELECT * FROM r WHERE (trow + tcol) % 2 = 0), old AS (SELECT trow, tcol, zmin, CASE WHEN tcol % 3 = 0 THEN NULL ELSE zmax END AS zmax FROM r WHERE trow % 3 <> 0)
SELECT coalesce(nw.trow, old.trow) AS trow, coalesce(nw.tcol, old.tcol) AS tcol, round(coalesce(nw.zmin, old.zmin), 3) AS zmin, round(coalesce(nw.zmax, old.zmax), 3) AS zmax,
  coalesce(nw.zmin, old.zmin) IS NULL OR coalesce(nw.zmax, old.zmax) IS NULL AS rescan FROM nw FULL JOIN old ON nw.trow = old.trow AND nw.tcol = old.tcol""")
def build_manifest(spark, sf):
    every = tiles.elevation_range(terrain.vertices(spark, sf))
    old = every.filter("trow % 3 <> 0").withColumn("zmax", F.when(F.col("tcol") % 3 != 0, F.col("zmax")))
    return tiles.build_manifest(every.filter("(trow + tcol) % 2 = 0"), old).select("trow", "tcol", F.round("zmin", 3).alias("zmin"), F.round("zmax", 3).alias("zmax"), "rescan")


@query("t12_max_pyramid", f"""WITH {CELLS_SQL} SELECT trow, tcol, k::INT AS level, (y >> (k - 1))::INT AS "by", (x >> (k - 1))::INT AS bx, round(max(zmax), 3) AS zmax, count(*) AS n
FROM c, range(1, 6) t(k) GROUP BY ALL""")
def max_pyramid(spark, sf):
    return tiles.max_pyramid(terrain.cells(spark, sf), 5).withColumn("zmax", F.round("zmax", 3))


@query("t13_tile_key", """SELECT c_custkey AS id, floor((1200000.0 - (1200000.0 + c_custkey * 7.25 - 3000)) / 160)::BIGINT AS trow, floor((2600000.0 - 2000 + c_custkey * 3.5 - 2600000.0) / 160)::BIGINT AS tcol FROM customer""")
def tile_key(spark, sf):
    trow, tcol = tiles.tile_key(2600000.0 - 2000 + F.col("c_custkey") * 3.5, 1200000.0 + F.col("c_custkey") * 7.25 - 3000, GRID)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), trow.alias("trow"), tcol.alias("tcol"))


@query("t14_infer_grid", f"""WITH {VERTICES_SQL} SELECT DISTINCT trow, tcol, 2600000.0::DOUBLE AS origin_x, 1200000.0::DOUBLE AS origin_y FROM v""")
def infer_grid(spark, sf):
    keys = terrain.vertices(spark, sf).select("trow", "tcol").distinct()
    x, y = tiles.infer_grid(2600000.0 + F.col("tcol") * GRID.width, 1200000.0 - (F.col("trow") + 1) * GRID.width, F.col("trow"), F.col("tcol"), F.lit(GRID.width))
    return keys.select("trow", "tcol", x.alias("origin_x"), y.alias("origin_y"))


@query("t15_tile_distance", f"""WITH {VERTICES_SQL}, k AS (SELECT DISTINCT trow, tcol, 2600000.0 + tcol * 160 AS w, 1200000.0 - (trow + 1) * 160 AS so FROM v)
SELECT trow, tcol, round(sqrt(power(greatest(w - 2600100, 2600100 - w - 160, 0), 2) + power(greatest(so - 1199900, 1199900 - so - 160, 0), 2)), 3) AS distance FROM k""")
def tile_distance(spark, sf):
    keys = terrain.vertices(spark, sf).select("trow", "tcol").distinct()
    d = tiles.tile_distance(F.lit(2600100.0), F.lit(1199900.0), F.col("trow"), F.col("tcol"), GRID)
    return keys.select("trow", "tcol", F.round(d, 3).alias("distance"))

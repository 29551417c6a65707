"""Geodesy, coordinate text, sun and calendar, mask and registered queries."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from crestline.functions import coordinates, geodesy, shading, solar
from crestline.operators import imaging, rays
from crestline.plans.all import ORACLE_SQL, QUERIES


def test_geodesics_round_trip_and_cross_the_date_line(spark):
    rows = [(46.0, 7.0, 100.0, 0.0), (43.17, 16.44, 0.0, 100.0), (72.0, 179.999, -3000.0, 4000.0), (-45.0, -179.999, -3000.0, 4000.0), (46.0, 7.0, 300000.0, 200000.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, e double, n double")
    df = df.withColumn("p", geodesy.geodesic_move(F.col("lat"), F.col("lon"), F.col("e"), F.col("n"))).withColumn("o", geodesy.geodesic_offset(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")))
    for r in df.collect():
        assert abs(r.o.east - r.e) < 1e-5 and abs(r.o.north - r.n) < 1e-5 and -180 <= r.p.lon <= 180
    assert df.collect()[3].p.lon > 179


def test_fixed_systems(spark):
    r = spark.range(1).select(geodesy.from_crs(F.lit(2621451.3), F.lit(1105565.9), 2056).alias("ch"), geodesy.from_crs(F.lit(190716.0), F.lit(859877.0), 27700).alias("gb"),
                              geodesy.to_crs(F.lit(3.0), F.lit(46.5), 2154).alias("fr")).first()
    assert abs(r.ch.lat - 46.1012605320838) < 1e-7 and abs(r.ch.lon - 7.71604367731172) < 1e-7
    assert abs(r.fr.x - 700000) < 1e-3 and abs(r.fr.y - 6600000) < 1e-3 and 57.5 < r.gb.lat < 57.6


def test_coordinate_routing(spark):
    yes = ["51.25, -0.75", "-12", "7.", "60,", "wgs84: 1 2", "LV95 2700123 1250456", "lv95\t2500000,1100000", "SU 12345 67890", "TQ,123,456", "SD7", "OSGB: 1 2", "dataset 1 2"]
    no = ["", "Snowdon", "Matterhorn 2", "Säntis", "Paris", "M1 1AE", "SU Inn", "12 High Street", "Datasets of old", "Osgbury"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", coordinates.is_coordinate(F.col("t")).alias("c"))
    assert {r.t for r in df.collect() if r.c} == set(yes)


def test_coordinate_systems(spark):
    cases = {"2621451.3,1105565.9": "LV95", "NG 90716 59877": "OSGB", "-45,179.9": "WGS84", "wgs84: 46 7": "WGS84", "91 7": "OSGB"}
    df = spark.createDataFrame([(t,) for t in [*cases, "Ben Nevis", "NG 123"]], "t string").select("t", coordinates.candidates(F.col("t"), 2056).alias("c"))
    got = {r.t: [x.system for x in r.c] for r in df.collect()}
    assert {t: got[t][0] for t in cases} == cases and got["Ben Nevis"] == [] and got["NG 123"] == []
    assert got["2621451.3,1105565.9"] == ["LV95"]


def test_dates_and_sun(spark):
    df = spark.createDataFrame([("29-02-2024", "23:59"), ("29-02-2023", "00:00"), ("01-01-1582", "00:00"), ("1-1-2020", "00:00"), ("01-13-2020", "00:00"), ("01-01-2020", "24:00")], "d string, t string")
    assert [r.p is not None for r in df.select(solar.parse_date_time(F.col("d"), F.col("t")).alias("p")).collect()] == [True, False, False, False, False, False]
    noon = F.lit("2026-03-20 12:00:00").cast("timestamp")
    s = spark.range(1).select(solar.solar_place(F.lit(40.0), F.lit(0.0), noon).alias("s")).first().s
    assert 3.0 < s.azimuth < 3.2 and s.elevation > 0.8
    d = spark.range(1).select(solar.daylight_times(F.lit(80.0), F.lit(0.0), F.lit("2026-06-21").cast("date")).alias("a"), solar.daylight_times(F.lit(80.0), F.lit(0.0), F.lit("2026-12-21").cast("date")).alias("b")).first()
    assert d.a.state == "PolarDay" and d.b.state == "PolarNight"
    gap = spark.range(1).select(solar.local_to_utc(F.lit("2026-03-29 02:30:00").cast("timestamp"), F.lit("Europe/Zurich")).alias("u")).first()
    assert gap.u is None


def test_mask_covers_pixels_within_one(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(300)] + [(0.5, 0.5), (31.5, 18.5), (-1.0, -1.0), (1e30, 0.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(pts, "mx double, my double")
    got = {(r.px, r.py) for r in imaging.visibility_mask(df, 32, 19).collect()}
    want = {(x, y) for x in range(32) for y in range(19) if any(-1 <= x + 0.5 - a < 1 and -1 <= y + 0.5 - b < 1 for a, b in pts)}
    assert got == want


def test_visible_points(spark):
    df = spark.createDataFrame([(0.6, 0.8, d) for d in (10.0, 0.0, -1.0, float("inf"), float("nan"))], "dx double, dy double, distance double")
    got = [(r.east, r.north) for r in imaging.visible_points(df).collect()]
    assert got == [(6.0, 8.0)]


def test_camera_reprojects(spark):
    from crestline.operators.points import projected

    cam = spark.createDataFrame([(1, 9, 7, 1.1, 0.3, 0.2, 8.0, 8.0, 4.5, 3.5, 1e9, 0.1)], "view_id long, width int, height int, heading double, pitch double, roll double, fx double, fy double, cx double, cy double, tmax double, pixel_size double")
    r = rays.camera_rays(cam)
    t = r.select("view_id", (F.col("py") * 9 + F.col("px")).cast("long").alias("target_id"), (F.col("dx") * 0.01).alias("east"), (F.col("dy") * 0.01).alias("north"), (F.col("slope") * 0.01).alias("dz"))
    for x in projected(cam, t).collect():
        assert x.onscreen and abs(x.px - (x.target_id % 9 + 0.5)) < 1e-3 and abs(x.py - (x.target_id // 9 + 0.5)) < 1e-3


def test_undistort_fails_as_null(spark):
    at = rays.undistort(F.lit(5.0), F.lit(5.0), F.lit(-0.9), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(at.alias("p")).first().p is None


def test_palettes(spark):
    r = spark.range(1).select(*[c.alias("rgb"[k]) for k, c in enumerate(shading.colourmap(F.lit(0.25)))], *[c.alias("xyz"[k]) for k, c in enumerate(shading.viewfinder(F.lit(1.0)))]).first()
    assert tuple(r) == (59, 82, 139, 255, 255, 255) and len(shading.VIEWFINDER) == 96


def canonical(rows, columns):
    def one(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["t2_mosaic", "t4_lod_mean", "t6_coverage_rects", "t12_max_pyramid", "r10_r12_first_hits", "r11_triangle_hits", "r19_shadow_visibility", "h8_feature_outlines",
                                  "w3_visibility_mask", "p9_find_summit", "c2_tiles_in_range", "c4_owned_cells", "x1_stream_track_clearance", "s8_write_tiles", "r16_recovered_steps", "g2_g4_geodesics", "g5_g6_true_north",
                                  "c8_coverage_footprints", "p2_visible_peaks", "r20_hit_positions"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "customer", "part", "orders", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert canonical([r.asDict() for r in got.collect()], sorted(columns)) == canonical(want, sorted(columns))


def test_terrain_system_of_a_free_text(spark):
    """A geographic terrain is asked only where nothing else takes the numbers; a projected one where its range does."""
    cases = {("46.5 7.2", 4326): ["WGS84", "OSGB"], ("120.5, 45.0", 4326): ["OSGB"], ("-120.5, 45.0", 4326): ["DATASET"], ("2600000 1200000", 4326): ["LV95"], ("2600000 1200000", 2056): ["LV95"],
             ("900000 6500000", 2154): ["DATASET"], ("46.5 7.2", 2154): ["WGS84", "OSGB"], ("NG 90716 59877", 4326): ["OSGB"], ("46.5 7.2", 27700): ["WGS84", "OSGB"]}
    for (text, epsg), want in cases.items():
        got = spark.createDataFrame([(text,)], "t string").select(coordinates.candidates(F.col("t"), epsg).alias("c")).first().c
        assert [c.system for c in got] == want, (text, epsg, got)
    far = spark.createDataFrame([("-120.5, 45.0",)], "t string").select(coordinates.candidates(F.col("t"), 4326).alias("c")).first().c[0]
    assert (far.lat, far.lon) == (45.0, -120.5)


@pytest.mark.parametrize("epsg,x,y", [(2056, 2620000.0, 1105000.0), (2154, 900000.0, 6500000.0), (27700, 400000.0, 300000.0)])
def test_true_north_and_frame_turns(spark, epsg, x, y):
    """Unit axes at right angles; a frame offset by them ends where the geodesic does; a true azimuth turns with them."""
    at = spark.range(1).select(geodesy.from_crs(F.lit(x), F.lit(y), epsg).alias("p")).select("p", geodesy.true_north_basis(F.lit(x), F.lit(y), F.col("p.lat"), F.col("p.lon"), epsg).alias("b"))
    moved = geodesy.geodesic_move(F.col("p.lat"), F.col("p.lon"), F.lit(30.0), F.lit(40.0))
    r = at.select("b", geodesy.frame_offset(F.col("b"), F.lit(30.0), F.lit(40.0)).alias("o"), moved.alias("m"), geodesy.render_azimuth(F.col("b"), F.lit(0.0)).alias("north")).select(
        "b", "o", "north", geodesy.to_crs(F.col("m.lon"), F.col("m.lat"), epsg).alias("q")).first()
    assert math.hypot(r.b.ee, r.b.en) == pytest.approx(1) and r.b.ee * r.b.ne + r.b.en * r.b.nn == pytest.approx(0, abs=1e-12)
    # scale factors of the projections are within 0.1 %
    assert math.hypot(r.q.x - x - r.o.x, r.q.y - y - r.o.y) < 0.06
    assert (math.sin(r.north), math.cos(r.north)) == pytest.approx((r.b.ne, r.b.nn), abs=1e-9)

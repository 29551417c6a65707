"""Tile preparation, sources and stacks on hand-made fixtures."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from crestline.operators import catalogue, levels, points, stacked, tiles, trace, validate
from crestline.sources import gazetteer, rasters
from crestline.sources import tiles as store
from crestline.storage import scratch_path

VERTEX = "trow long, tcol long, y int, x int, z double"


def tile(values, no_data=None):
    """A square raster, north first, as vertices of tile (0, 0)."""
    n = len(values) - 1
    return [(0, 0, n - r, c, None if v == no_data else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)]


def test_float_raster_with_void(spark):
    void = -3.4e38
    rows = tile([[void, 5, 100], [40, 200.24, 0], [-1200, 25, 80]], void)
    v = spark.createDataFrame(rows, VERTEX)
    assert tiles.usable_cells(v).count() == 3
    r = tiles.elevation_range(v).first()
    assert abs(r.zmin + 1200) < 0.01 and r.zmin < -1200 and r.zmax > 200.24
    rects = tiles.coverage_rects(tiles.usable_cells(v)).collect()
    assert sum(x.width * x.height for x in rects) == 3


def test_quantise_range(spark):
    v = spark.createDataFrame(tile([[-400, 0, 6153.4], [0, 10, 20], [30, 40, 50]]), VERTEX)
    coded = tiles.quantize(v).collect()
    assert {r.base_dm for r in coded} == {-4001} and min(r.code for r in coded) == 1 and max(r.code for r in coded) == 65535
    back = tiles.quantize(v).select(tiles.dequantize(F.col("base_dm"), F.col("code")).alias("z")).collect()
    assert sorted(r.z for r in back) == sorted(x[4] for x in tile([[-400, 0, 6153.4], [0, 10, 20], [30, 40, 50]]))
    steep = spark.createDataFrame(tile([[-400, 0, 6153.5], [0, 10, 20], [30, 40, 50]]), VERTEX)
    with pytest.raises(Exception, match="6553.4"):
        tiles.quantize(steep).collect()


def test_partial_tile_covers_half_open(spark):
    v = spark.createDataFrame(tile([[-99999, 0, 6153.4], [0, 10, 20], [30, 40, 50]], -99999), VERTEX)
    rects = tiles.coverage_rects(tiles.usable_cells(v))
    pts = spark.createDataFrame([(0, 0, 0.5, 1.5), (0, 0, 1.5, 1.5), (0, 0, 2.0, 1.0), (0, 0, 1.0, 1.0)], "trow long, tcol long, px double, py double")
    got = {(r.px, r.py): r.covered for r in tiles.covers(pts, rects).collect()}
    assert got == {(0.5, 1.5): False, (1.5, 1.5): True, (2.0, 1.0): False, (1.0, 1.0): True}


@pytest.mark.parametrize("method", ["point", "mean", "max"])
@pytest.mark.parametrize("floor", [-2000.0, -1000.0])
def test_srtm_voids_through_lods(spark, method, floor):
    z = {(r, c): 100.0 for r in range(9) for c in range(9)}
    z |= {(0, 0): -32768.0, (0, 4): -32767.0, (2, 2): -29102.0, (6, 2): -7110.0, (2, 6): -1001.0, (4, 4): -25459.0, (1, 7): -1000.0, (7, 7): 4800.0}
    rows = [(0, 0, 8 - r, c, v) for (r, c), v in z.items()]
    ok = tiles.valid_sample(F.col("z"), F.lit(-32768.0), F.lit(1)) & tiles.above_floor(F.col("z"), F.lit(True), floor)
    v = spark.createDataFrame(rows, VERTEX).withColumn("z", F.when(ok, F.col("z")))
    got = {(r.lod, r.y, r.x): r.z for r in tiles.lod_pyramid(v, 8, 3, method).collect()}
    assert got.get((2, 2, 2)) is None and got.get((3, 1, 1)) is None
    assert (got[1, 6, 6] is None) == (floor == -1000.0)
    if method != "point":
        assert (2, 1, 1) not in got and (2, 3, 1) not in got
    assert max(x for x in got.values() if x is not None) == 4800


def test_lod_edges_are_taken_as_they_are_and_max_covers(spark):
    rng = random.Random(1)
    rows = [(0, 0, y, x, rng.uniform(0, 100)) for y in range(9) for x in range(9)]
    v, fine = spark.createDataFrame(rows, VERTEX), {(r[2], r[3]): r[4] for r in rows}
    for method in ("mean", "max"):
        for r in tiles.lod_step(v, 8, method).collect():
            if r.x in (0, 4) or r.y in (0, 4):
                assert r.z == fine[2 * r.y, 2 * r.x]
            else:
                around = [fine[2 * r.y + j, 2 * r.x + i] for j in (-1, 0, 1) for i in (-1, 0, 1)]
                want = max(around) if method == "max" else sum(fine[2 * r.y + j, 2 * r.x + i] * (2 - abs(i)) * (2 - abs(j)) for j in (-1, 0, 1) for i in (-1, 0, 1)) / 16
                assert math.isclose(r.z, want)


def test_mosaic_falls_back_and_does_not_depend_on_partitions(spark):
    rows = [(s, c, r, None if (c + r + s) % 4 == 0 and s == 0 else 100.0 * s + c) for s in range(3) for c in range(6) for r in range(6)]
    df = spark.createDataFrame(rows, "source_id int, col long, row long, z double").filter("z is not null")
    one = sorted(map(tuple, tiles.mosaic(df.coalesce(1), ["source_id"]).collect()))
    assert one == sorted(map(tuple, tiles.mosaic(df.repartition(7), ["source_id"]).collect()))
    assert all(z == (100.0 + c if (c + r) % 4 == 0 else c) for c, r, z in one)


def test_assign_tiles_shares_edges_and_floors_negatives(spark):
    df = spark.createDataFrame([(0, 0), (3, 4), (-1, -4), (-4, -5)], "col long, row long")
    got = {}
    for r in tiles.assign_tiles(df, 4).collect():
        got.setdefault((r.col, r.row), set()).add((r.trow, r.tcol, r.y, r.x))
    assert got[0, 0] == {(0, 0, 4, 0), (0, -1, 4, 4), (-1, 0, 0, 0), (-1, -1, 0, 4)}
    assert got[3, 4] == {(1, 0, 4, 3), (0, 0, 0, 3)} and got[-1, -4] == {(-1, -1, 4, 3), (-2, -1, 0, 3)}
    assert got[-4, -5] == {(-2, -1, 1, 0), (-2, -2, 1, 4)}


def test_manifest_and_stack_checks(spark):
    m = spark.createDataFrame([(-3, 5, -44.25, 123.5), (0, 0, 200.0, 100.0), (1, 1, 0.0, float("nan")), (2, 2, 0.0, 1.0), (2, 2, 0.0, 1.0)], "trow long, tcol long, zmin double, zmax double")
    assert {(r.trow, r.rule) for r in validate.check_manifest(m).collect()} == {(0, "order"), (1, "bounds"), (2, "duplicate")}
    d = spark.createDataFrame([(1, 0, 16, 0.0), (2, 1, 32, float("inf"))], "dataset_id int, priority int, cells int, vertical_offset_m double")
    assert {(r.dataset_id, r.rule) for r in validate.check_stack(d).collect()} == {(2, "cells"), (2, "offset")}


def test_tiles_are_written_once_and_read_back(spark):
    v = spark.createDataFrame([(r, c, y, x, float(r + c + y * x)) for r in range(2) for c in range(2) for y in range(3) for x in range(3)] + [(5, 5, 0, 0, None)], VERTEX).withColumn("lod", F.lit(1))
    path = scratch_path(spark, "tiles")
    assert tuple(store.write_tiles(v, path, max_tiles=1).first())[:2] == (1, 0)
    assert tuple(store.write_tiles(v, path).first())[:2] == (3, 1)
    assert tuple(store.write_tiles(v, path).first())[:2] == (0, 4)
    m = store.read_manifest(spark, path).collect()
    assert len(m) == 4 and all(sum(c.width * c.height for c in r.coverage) == 4 for r in m)
    assert tuple(store.write_tiles(v, path, overwrite=True).first())[:2] == (4, 0)
    assert store.read_tiles(spark, path).count() == 36


def test_overwriting_tiles_leaves_the_others(spark):
    def tile(r, c, z):
        return [(r, c, y, x, z) for y in range(3) for x in range(3)]

    def frame(*parts):
        return spark.createDataFrame(sum(parts, []), VERTEX).withColumn("lod", F.lit(1))

    def heights():
        return {(r.trow, r.tcol): r.z for r in store.read_tiles(spark, path).groupBy("trow", "tcol").agg(F.max("z").alias("z")).collect()}

    path = scratch_path(spark, "tiles")
    first = frame(tile(0, 0, 1.0), tile(0, 1, 2.0), tile(1, 0, 3.0), tile(20, 20, 4.0))
    assert tuple(store.write_tiles(first, path).first()) == (4, 0, 0, 0)
    # one tile replaced, by a partial one; all others stay, in its block and elsewhere
    half = tile(0, 1, 9.0)[:-1] + [(0, 1, 2, 2, None)]
    assert tuple(store.write_tiles(frame(half), path, overwrite=True).first()) == (1, 0, 1, 0)
    assert heights() == {(0, 0): 1.0, (0, 1): 9.0, (1, 0): 3.0, (20, 20): 4.0}
    # a tile that has lost its ground goes, also where it was its block's last; others in its input are written
    bare = [(20, 20, y, x, None) for y in range(3) for x in range(3)]
    assert tuple(store.write_tiles(frame(bare, tile(2, 2, 5.0)), path, overwrite=True).first()) == (1, 0, 0, 1)
    assert heights() == {(0, 0): 1.0, (0, 1): 9.0, (1, 0): 3.0, (2, 2): 5.0}
    assert {(r.trow, r.tcol): r.zmax > 0 for r in store.read_manifest(spark, path).collect()} == {k: True for k in heights()}
    # without overwrite an empty tile removes nothing; max_tiles counts what is skipped too
    assert tuple(store.write_tiles(frame(tile(0, 0, 7.0), tile(0, 1, 7.0), tile(3, 3, 7.0)), path, max_tiles=2).first()) == (0, 2, 0, 0)
    assert tuple(store.write_tiles(frame(tile(0, 0, 7.0), tile(3, 3, 7.0), tile(4, 4, 7.0)), path, max_tiles=2).first()) == (1, 1, 0, 0)
    # stored tiles may be their own input
    assert tuple(store.write_tiles(store.read_tiles(spark, path), path, overwrite=True).first()) == (5, 0, 1, 0)
    assert heights() == {(0, 0): 1.0, (0, 1): 9.0, (1, 0): 3.0, (2, 2): 5.0, (3, 3): 7.0}
    # a block's tiles alone, by key
    some = spark.createDataFrame([(0, 1)], "trow long, tcol long")
    assert store.read_tiles(spark, path, some).count() == 9


def test_hgt_and_zip_and_asc(spark, tmp_path):
    import zipfile

    import numpy as np

    grid = np.full((1201, 1201), 100, ">i2")
    grid[0, 1], grid[1200, 1200] = -32768, -430
    (tmp_path / "sub").mkdir()
    (tmp_path / "out").mkdir()
    grid.tofile(tmp_path / "sub" / "N46E007.hgt")
    asc = "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -1\n1 2 3\n-1 5 6.5\n"
    (tmp_path / "a.asc").write_text(asc)
    (tmp_path / "out" / "b.asc").write_text(asc)
    (tmp_path / "c.tif").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("inner/d.ASC", asc)
        z.writestr("readme.txt", "no")
    found = [(r.name, r.kind) for r in rasters.discover_sources(spark, str(tmp_path), str(tmp_path / "out")).collect()]
    assert found == [("N46E007.hgt", ".hgt"), ("a.asc", ".asc"), ("c.tif", ".tif"), ("z.zip/inner/d.ASC", ".asc")]
    h = rasters.read_hgt(spark, str(tmp_path / "sub"))
    assert h.count() == 1201 * 1201 and h.filter("mask = 0").count() == 1
    low = h.filter("value = -430").first()
    assert (low.lat, low.lon, low.row, low.col) == (46, 7, 1200, 1200)
    got = {(r.row, r.col): r.value for r in rasters.read_asc(spark, str(tmp_path / "a.asc")).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): -1, (1, 1): 5, (1, 2): 6.5}


def test_every_supplier_is_a_source(spark):
    """As many files as suppliers (100 of sf0.01), as the SQL says."""
    from crestline.plans.all import ORACLE_SQL, QUERIES

    sf, db = "/root/testdata/sf0.01", duckdb.connect()
    for name in ("supplier", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = [tuple(r) for r in QUERIES["s1_discover_sources"](spark, sf).collect()]
    assert got == db.execute(ORACLE_SQL["s1_discover_sources"]).fetchall() == [(".txt", 100)]


def test_sidecar_numbers(spark):
    one = spark.range(1).select(rasters.epsg_from_gml(F.lit("urn:ogc:def:crs:EPSG::2056 urn:ogc:def:crs:EPSG::2056")).alias("e"))
    assert one.first().e == 2056
    with pytest.raises(Exception, match="EPSG"):
        spark.range(1).select(rasters.epsg_from_gml(F.lit("urn:ogc:def:crs:EPSG::2056 urn:ogc:def:crs:EPSG::2154")).alias("e")).collect()


def test_gazetteer(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Lat,Lon,Elevation,Prom,Name\n45.83,6.86,4808,4695,Mont Blanc\n\n47.42,13.06,2941,2181,"HOCHKÖNIG, the ""king"""\n1,2,3,4,a "b" c\n', encoding="utf-8")
    got = gazetteer.read_peaks(spark, str(tmp_path / "p.csv")).orderBy("peak_id").collect()
    assert [(r.peak_id, r.elevation, r.name) for r in got] == [(0, 4808, "Mont Blanc"), (1, 2941, 'HOCHKÖNIG, the "king"'), (2, 3, 'a "b" c')]
    (tmp_path / "q.csv").write_text("Lat,Lon,Elevation,Prom,Name\n1,2,3,no peak\n")
    with pytest.raises(Exception, match="no peak"):
        gazetteer.read_peaks(spark, str(tmp_path / "q.csv")).collect()


def test_peak_search(spark):
    rows = [(0, 45.83, 6.86, 4808.0, 4695.0, "Mont Blanc du Tacul"), (1, 45.9, 6.9, 4808.0, 4695.0, "Mont Blanc"), (2, 45.0, 6.0, 1.0, 1.0, "Mont Blanc de Seilon"), (3, 46.0, 7.1, 1.0, 1.0, "Petit Mont Blanc"),
            (4, 47.42, 13.06, 2941.0, 2181.0, "HOCHKÖNIG")]
    peaks = spark.createDataFrame(rows, "peak_id long, lat double, lon double, elevation double, prominence double, name string")
    q = spark.createDataFrame([(1, "  mont blanc  ", 46.0, 7.0), (2, "hochkonig", 46.0, 7.0), (3, "", 46.0, 7.0)], "query_id long, text string, lat double, lon double")
    got = {}
    for r in points.search_peaks(q, peaks).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.peak_id)
    assert got == {1: [1, 0, 2, 3], 2: [4]}
    assert points.search_peaks(q, peaks, 2).filter("query_id = 1").count() == 2


GRID = tiles.Grid(0.0, 0.0, 10.0, 16)


def flat(spark, z=1000.0, spikes=(), skip=(), tcols=(0, 1), trows=(0,), grid=GRID):
    """Vertices of flat ground with spikes {(gx, gy): z} and voids, by raster column and row."""
    spikes = dict(spikes)
    rows = []
    for tr in trows:
        for tc in tcols:
            for y in range(grid.cells + 1):
                for x in range(grid.cells + 1):
                    col, row = tc * grid.cells + x, tr * grid.cells + grid.cells - y
                    rows.append((tr, tc, y, x, None if (col, row) in skip else spikes.get((col, row), z), col, row))
    return spark.createDataFrame(rows, VERTEX + ", col long, row long")


def test_summit(spark):
    v = flat(spark, spikes={(13, 4): 1200.0, (13, 13): 1800.0})
    c = tiles.usable_cells(v)
    at = spark.createDataFrame([(1, 95.0, -40.0), (2, 300.0, -40.0), (3, 9000.0, 0.0)], "centre_id long, x double, y double")
    got = {r.centre_id: r for r in points.find_summit(at, v, c, GRID, 60.0).collect()}
    assert (got[1].z, got[1].vx, got[1].vy) == (1200, 130, -40)
    assert got[2].z == 1000 and got[2].distance == 0 and got[3].z is None
    assert {r.centre_id: r.z for r in points.find_summit(at, v, c, GRID, 0.0).collect()} == {1: 1000, 2: 1000, 3: None}
    with pytest.raises(ValueError):
        points.find_summit(at, v, c, GRID, -1.0)


def test_vertices_on_the_last_edge_count_once(spark):
    v = flat(spark)
    at = spark.createDataFrame([(1, 318.0, -158.0), (2, 160.0, -80.0)], "centre_id long, x double, y double")
    got = {(r.centre_id, r.vx, r.vy) for r in points.grid_points(at, v, GRID, 10.0).collect()}
    assert got == {(1, 320.0, -160.0), (1, 310.0, -160.0), (1, 320.0, -150.0)} | {(2, 160.0 + x, -80.0 + y) for x, y in ((0, 0), (10, 0), (-10, 0), (0, 10), (0, -10))}
    assert points.grid_points(at, v, GRID, 10.0).filter("centre_id = 2").count() == 5


def geo_layer(spark, grid, offset, **flat_args):
    v = flat(spark, grid=grid, **flat_args)
    return stacked.Layer(tiles.usable_cells(v), grid, offset, 4326, v)


def test_summit_of_a_stack(spark):
    """Offsets, circle, priority over a higher dataset below, holes, plateau, far away, off the ground."""
    step = 1 / 8192
    top = geo_layer(spark, tiles.Grid(7.0, 46.0, step, 16), -50.0, tcols=(0,), spikes={(13, 4): 1200.0, (13, 13): 1800.0}, skip={(2, 13)})
    below = geo_layer(spark, tiles.Grid(7.0, 46.0, step, 16), 0.0, tcols=(0,), z=2000.0)
    far = geo_layer(spark, tiles.Grid(16.0, 43.0, step, 16), 0.0, tcols=(0,), spikes={(7, 8): 1300.0})
    rows = [(1, 46 - 6 * step, 7 + 9 * step), (2, 46 - 4 * step, 7 + 4.5 * step), (3, 46 - 13 * step, 7 + 1 * step), (4, 43 - 8 * step, 16 + 5 * step), (5, 50.0, 7.0)]
    at = spark.createDataFrame(rows, "centre_id long, lat double, lon double")
    got = {r.centre_id: r for r in stacked.find_summit(at, [top, below, far], 60.0).collect()}
    assert got[1].z == 1150 and abs(got[1].lon - 7 - 13 * step) < 1e-12 and abs(got[1].lat - 46 + 4 * step) < 1e-12
    assert got[2].z == 950 and got[2].distance == 0 and got[3].z == 2000 and got[4].z == 1300 and got[5].z is None
    same = {r.centre_id: (r.z, r.distance) for r in stacked.find_summit(at, [top, below, far], 0.0).collect()}
    assert same[1] == (950.0, 0.0) and same[4] == (1000.0, 0.0) and same[5] == (None, None)
    with pytest.raises(ValueError):
        stacked.find_summit(at, [top], -1.0)


def test_grid_points_over_the_date_line_and_at_a_pole(spark):
    from crestline.functions.geodesy import geodesic

    step = 1 / 64
    west = geo_layer(spark, tiles.Grid(-180.0, 90.0, step, 16), 0.0, tcols=(0,), trows=(0, 1))
    east = geo_layer(spark, tiles.Grid(-180.0, 90.0, step, 16), 0.0, tcols=(1439,), trows=(0, 1))
    layer = stacked.Layer(west.cells.unionByName(east.cells), west.grid, 0.0, 4326, west.vertices.unionByName(east.vertices))
    centres = [(1, 89.6, 179.95), (2, 89.7, -179.99), (3, 89.99, 20.0), (4, 89.6, 0.0)]
    at = spark.createDataFrame(centres, "centre_id long, lat double, lon double")
    spots = layer.vertices.select((90 - F.col("row") * step).alias("la"), (-180 + F.col("col") * step).alias("lo")).distinct()
    d = geodesic(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))["distance"]
    want = {(r.centre_id, r.la, r.lo) for r in at.crossJoin(spots).filter(d <= 3000).collect()}
    found = stacked.grid_points(at, [layer], 3000.0).collect()
    assert {(r.centre_id, r.lat, r.lon) for r in found} == want and len(found) == len(want)
    assert {r[0] for r in want} == {1, 2, 3} and {r[2] > 0 for r in want if r[0] == 1} == {True, False}


def test_stack_range_and_fallback(spark):
    fine, coarse = tiles.Grid(0.0, 0.0, 10.0, 16), tiles.Grid(1000.0, 0.0, 20.0, 16)
    keys = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (0, 0, 0), (0, 0, 1)], "priority int, trow long, tcol long")
    at = spark.createDataFrame([(1, 80.0, -80.0), (2, 700.0, -80.0), (3, 9000.0, 0.0)], "observer_id long, x double, y double")
    near = catalogue.tiles_in_range(keys, at, {0: coarse, 1: fine}, 400.0, 3)
    got = [tuple(r) for r in near.select("observer_id", "rank", "priority", "tcol", "own", "distance").orderBy("observer_id", "rank").collect()]
    assert got == [(1, 1, 1, 0, True, 0.0), (1, 2, 1, 1, False, 80.0), (2, 1, 0, 0, False, 300.0), (2, 2, 1, 1, False, 380.0)]
    rects = spark.createDataFrame([(0, 0, 0, 4, 2, 8, 4), (0, 0, 0, 0, 6, 16, 2), (1, 0, 1, 0, 0, 16, 16)], "priority int, trow long, tcol long, column int, row int, width int, height int")
    assert [tuple(r) for r in catalogue.stack_fallback(near, rects, {0: coarse, 1: fine}).collect()] == [(2, 0, 0, 0, 1160.0, -240.0)]


def test_ground_holes_and_priority(spark):
    top, below = flat(spark, skip={(7, r) for r in range(17)}, tcols=(0,)), flat(spark, 990.0, tcols=(0, 1))
    upper, lower = tiles.usable_cells(top), tiles.usable_cells(below)
    pts = spark.createDataFrame([(1, 20.0, -20.0), (2, 71.0, -20.0), (3, 200.0, -20.0), (4, 500.0, -20.0)], "point_id long, x double, y double")
    both = upper.select(F.lit(0).alias("dataset_id"), "trow", "tcol", "y", "x").unionByName(lower.select(F.lit(1).alias("dataset_id"), "trow", "tcol", "y", "x"))
    assert {r.point_id: r.dataset_id for r in catalogue.locate(pts, both, {0: GRID, 1: GRID}).collect()} == {1: 0, 2: 1, 3: 1, 4: None}
    keep = catalogue.owned_cells(lower, GRID, upper, GRID)
    assert keep.filter("tcol = 1").count() == 256 and keep.filter("tcol = 0").count() == 32
    fine = tiles.Grid(5.0, -5.0, 5.0, 16)
    tiny = tiles.usable_cells(flat(spark, tcols=(0,), grid=fine))
    assert lower.count() - catalogue.owned_cells(lower, GRID, tiny, fine).count() == 49


def view(spark, x, y, z, az=(0.0, 2 * math.pi), el=(-0.2, -1.2), size=(24, 8), tmax=400.0):
    return spark.createDataFrame([(1, x, y, z, size[0], size[1], az[0], az[1], el[0], el[1], tmax)],
                                 "view_id long, x double, y double, z double, width int, height int, az0 double, az1 double, el0 double, el1 double, tmax double")


@pytest.mark.parametrize("surface", ["bilinear", "triangles"])
def test_trace_equals_a_dense_march(spark, surface):
    wave = lambda e, n: round(10 * (1000 + 70 * math.sin(0.017 * e) * math.cos(0.011 * n))) / 10
    rows = [(tr, tc, y, x, wave((tc * 16 + x) * 10, -(tr * 16 + 16 - y) * 10)) for tr in range(-1, 2) for tc in (-1, 0, 2) for y in range(17) for x in range(17)]
    cells = tiles.usable_cells(spark.createDataFrame(rows, VERTEX))
    manifest = cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    got = trace.trace(view(spark, 63.0, -71.0, 1095.0, el=(0.05, -1.3)), cells, manifest, GRID, surface).collect()
    ground = {(r.tcol * 16 + r.x, -(r.trow + 1) * 16 + r.y): (r.z00, r.z01, r.z10, r.z11) for r in cells.collect()}

    def height(px, py):
        c = (math.floor(px / 10), math.floor(py / 10))
        if c not in ground:
            return None
        a, b, cc, d = ground[c]
        sx, sy = px / 10 - c[0], py / 10 - c[1]
        if surface == "bilinear":
            return a + (b - a) * sx + (cc - a) * sy + (a - b - cc + d) * sx * sy
        if abs(a - d) < abs(b - cc):
            return a + (b - a) * sx + (d - b) * sy if sx > sy else a + (d - cc) * sx + (cc - a) * sy
        return a + (b - a) * sx + (cc - a) * sy if sx + sy < 1 else (b + cc - d) + (d - cc) * sx + (d - b) * sy

    from crestline.operators.rays import CURVATURE

    assert len(got) == 24 * 8
    hits = 0
    for r in got:
        # a ray that comes out of a gap below the ground meets it where it next crosses it
        t, found, above = 0.0, None, True
        while t < 400 and found is None:
            h = height(63 + r.dx * t, -71 + r.dy * t)
            z = 1095 + r.slope * t + CURVATURE * t * t
            now = None if h is None else z > h
            if now is not None and above is not None and now != above:
                found = t
            above = now
            t += 0.01
        if found is None or r.distance is None:
            assert found is None and r.distance is None
        else:
            hits += 1
            assert abs(found - r.distance) < 0.03
    assert hits > 60


def test_stack_of_misaligned_plains_is_one_plain(spark):
    """Fine ground on top of coarse ground with another origin: the same distances as one flat dataset."""
    fine = tiles.usable_cells(flat(spark, tcols=(0,)))
    wide = tiles.Grid(-317.0, 203.0, 20.0, 16)
    coarse = tiles.usable_cells(flat(spark, tcols=(0, 1, 2), grid=wide))
    at = view(spark, 45.0, -75.0, 1020.0, el=(0.0, -1.2))
    got = {(r.px, r.py): r for r in stacked.trace_stack(at, [stacked.Layer(fine, GRID), stacked.Layer(coarse, wide)]).collect()}
    plain = tiles.Grid(-2000.0, 2000.0, 40.0, 100)
    one = spark.range(10000).selectExpr("0L as trow", "0L as tcol", "cast(id div 100 as int) as y", "cast(id % 100 as int) as x", *[f"1000D as {c}" for c in stacked.HEIGHTS])
    want = trace.trace(at, one, one.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax")), plain).collect()
    inside = [r for r in want if r.distance is not None and -317 < 45 + r.dx * r.distance < 640 and -117 < -75 + r.dy * r.distance < 203]
    assert len(inside) > 100 and all(abs(got[r.px, r.py].distance - r.distance) < 0.01 for r in inside)
    assert {r.dataset_id for r in got.values()} >= {0, 1}


def test_stack_equals_a_dense_march(spark):
    """Two layers with holes, the lower one raised: owner, root after a hidden root, and steps only where the ground is continuous."""
    rng = random.Random(5)
    low_grid = tiles.Grid(-83.0, 71.0, 15.0, 16)

    def layer(cells_of, base):
        rows = [(tr, tc, y, x, None if rng.random() < 0.02 else base + rng.uniform(-12, 12)) for tr in range(0, 2) for tc in cells_of for y in range(17) for x in range(17)]
        return spark.createDataFrame(rows, VERTEX)

    top, below = tiles.usable_cells(layer((0,), 1000.0)), tiles.usable_cells(layer((0, 1), 1004.0))
    got = stacked.trace_stack(view(spark, 63.0, -71.0, 1050.0, el=(-0.1, -1.3), size=(32, 12), tmax=260.0), [stacked.Layer(top, GRID), stacked.Layer(below, low_grid, 9.0)]).collect()
    ground = []
    for cells, grid, up in ((top, GRID, 0.0), (below, low_grid, 9.0)):
        ground.append((grid, up, {(r.tcol * 16 + r.x, -(r.trow + 1) * 16 + r.y): (r.z00, r.z01, r.z10, r.z11) for r in cells.collect()}))

    def surface(px, py):
        for k, (grid, up, cells) in enumerate(ground):
            gx, gy = (px - grid.origin_x) / grid.cell, (py - grid.origin_y) / grid.cell
            c = cells.get((math.floor(gx), math.floor(gy)))
            if c:
                sx, sy = gx % 1, gy % 1
                return k, up + c[0] + (c[1] - c[0]) * sx + (c[2] - c[0]) * sy + (c[0] - c[1] - c[2] + c[3]) * sx * sy
        return None

    from crestline.operators.rays import CURVATURE

    hits, owners = 0, set()
    for r in got:
        t, found, before, covered = 0.0, None, None, True
        while t < 260 and found is None:
            s = surface(63 + r.dx * t, -71 + r.dy * t)
            covered = covered and s is not None
            above = s and 1050 + r.slope * t + CURVATURE * t * t > s[1]
            # a change of side within a layer is a root, one between layers a step
            if s and before and above != before[1] and (s[0] == before[0] or (covered and not above)):
                found = (t, s[0])
            before = s and (s[0], above)
            t += 0.01
        if found is None or r.distance is None:
            assert found is None and r.distance is None
        else:
            hits += 1
            owners.add(found[1])
            assert abs(found[0] - r.distance) < 0.03 and found[1] == r.dataset_id
    assert hits > 200 and owners == {0, 1}


def test_gaps_and_far_face(spark):
    """Flat ground with a gap, then a rise: steep rays hit near, shallow ones the face beyond the gap."""
    v = flat(spark, spikes={(c, r): 1040.0 for c in range(10, 33) for r in range(17)}, skip={(c, r) for c in range(7, 9) for r in range(17)})
    cells = tiles.usable_cells(v)
    manifest = cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    at = view(spark, 45.0, -75.0, 1020.0, az=(math.pi / 2 - 0.001, math.pi / 2 + 0.001), el=(0.0, -1.2), size=(1, 24), tmax=250.0)
    got = {r.py: r.distance for r in trace.trace(at, cells, manifest, GRID).collect()}
    assert got[23] is not None and got[23] < 12
    assert 45 < got[0] < 60
    assert any(d is None for d in got.values())  # into the gap
    short = trace.trace(at.withColumn("tmax", F.lit(40.0)), cells, manifest, GRID).filter("py = 0").first()
    assert short.distance is None


def test_shadows(spark):
    v = flat(spark, spikes={(20, r): 1100.0 for r in range(17)})
    cells = tiles.usable_cells(v)
    manifest = cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    hits = trace.trace(view(spark, 100.0, -80.0, 1010.0, el=(-0.5, -1.2)), cells, manifest, GRID).filter("distance is not null").withColumns({"grad_e": F.lit(0.0), "grad_n": F.lit(0.0)})
    lit = lambda az, el: {r.lit for r in trace.shadow_visibility(hits, cells, manifest, GRID, az, el, 300.0).collect()}
    assert lit(math.pi / 2, math.atan(0.1)) == {False} and lit(math.pi / 2, math.atan(4.0)) == {True}
    assert lit(math.pi / 2, -0.1) == {False} and lit(0.0, math.pi / 2) == {True} and lit(3 * math.pi / 2, math.atan(0.1)) == {True}


def test_recovered_step_needs_continuous_ground(spark):
    rows = [(1, 0, 0, 0.0, 5.0, None, False), (1, 0, 0, 5.0, 9.0, None, True), (2, 0, 0, 0.0, 5.0, None, False), (2, 0, 0, 6.0, 9.0, None, True), (3, 0, 0, 0.0, 5.0, 4.0, False)]
    got = trace.recovered_steps(spark.createDataFrame(rows, "view_id long, px int, py int, t0 double, t1 double, t_hit double, entry_below boolean")).groupBy("view_id").agg(F.min("hit").alias("h")).collect()
    assert {r.view_id: r.h for r in got} == {1: 5.0, 2: None, 3: 4.0}


def test_occlusion_and_peaks(spark):
    v = flat(spark, spikes={(20, r): 1030.0 for r in range(17)}, tcols=(0, 1, 2))
    cells = tiles.usable_cells(v)
    manifest = cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    from crestline.operators import rays

    cam = spark.createDataFrame([(1, 50.0, -85.0, 1015.0, 400.0, 60, 40, math.pi / 2, -0.05, 0.0, 40.0, 40.0, 30.0, 20.0, 0.025)],
                                "view_id long, x double, y double, z double, tmax double, width int, height int, heading double, pitch double, roll double, fx double, fy double, cx double, cy double, pixel_size double")
    r = rays.camera_rays(cam).join(cam.select("view_id", "x", "y", "z", "tmax"), "view_id")
    hits = trace.first_hits(r, cells, manifest, GRID)
    t = spark.createDataFrame([(1, 1, 150.0, 0.0, 14.5, 30.0, 1030.0), (1, 2, 300.0, 0.0, -15.0, 90.0, 1000.0), (1, 3, -100.0, 0.0, 0.0, 10.0, 1000.0), (1, 4, 900.0, 0.0, 0.0, 10.0, 1000.0)],
                              "view_id long, target_id long, east double, north double, dz double, prominence double, elevation double")
    assert [r.target_id for r in points.visible_peaks(cam, hits, t).collect()] == [1]
    seen = points.projected(cam, t.drop("prominence", "elevation")).withColumn("distance", F.hypot("east", "north"))
    assert {r.target_id: r.occluded for r in points.target_occluded(seen, hits).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_track_stream_equals_batch(spark):
    from crestline.streaming.track import stream_track_clearance

    cells = tiles.usable_cells(flat(spark))
    track = spark.createDataFrame([(1, 20.0, -20.0, "FollowTerrain", 0.0), (2, 20.0, -20.0, "HoldAltitude", 1000.4), (3, 20.0, -20.0, "HoldAltitude", 1000.5), (4, 9999.0, 0.0, "FollowTerrain", 5000.0)],
                                  "id long, x double, y double, mode string, height double")
    want = {1: (1050.0, True), 2: (1000.4, False), 3: (1000.5, True), 4: (None, False)}
    for df in (points.track_clearance(track, cells, GRID), stream_track_clearance(track, cells, GRID)):
        assert {r.id: (r.z, r.accepted) for r in df.collect()} == want


def rough(spark, trows=range(2), tcols=range(2), cells=128, void=0.02, seed=5, grid=None):
    """Vertices of tiles of many cells: hills, and some voids."""
    import random

    draw = random.Random(seed)
    high = {}
    for gy in range(len(trows) * cells + 1):
        for gx in range(len(tcols) * cells + 1):
            z = 1000 + 60 * math.sin(gx * 0.045) * math.cos(gy * 0.06) + 8 * math.sin(gx * 0.5 + gy * 0.3)
            high[gy, gx] = None if draw.random() < void else z
    rows = [(r, c, y, x, high[r * cells + cells - y, c * cells + x]) for r in trows for c in tcols for y in range(cells + 1) for x in range(cells + 1)]
    return spark.createDataFrame(rows, VERTEX)


ROUGH = tiles.Grid(2600000.0, 1200000.0, 10.0, 128)


def rough_views(spark, n, tmax, el=(0.3, -0.7), size=(9, 14)):
    rows = [(k, 2600000.0 + 37.3 + k * 411.7 % 2400, 1200000.0 - 63.1 - k * 713.3 % 2400, 1010.0 + 35 * (k % 4), size[0], size[1], 0.07 * k, 0.07 * k + 2 * math.pi, *el, tmax) for k in range(n)]
    return spark.createDataFrame(rows, "view_id long, x double, y double, z double, width int, height int, az0 double, az1 double, el0 double, el1 double, tmax double")


def by_ray(hits):
    return {(r.view_id, r.px, r.py): (r.distance, r.elevation, r.trow, r.tcol, r.cy, r.cx) for r in hits.collect()}


@pytest.mark.parametrize("surface,void", [("bilinear", 0.0), ("triangles", 0.02)])
def test_block_cull_stop_and_bands_change_no_hit(spark, surface, void):
    """Blocks of 64 and 8 cells, 600 km of range with rays that rise, bands and stored cells: the hits are those of a plain manifest."""
    cells = store.written(tiles.usable_cells(rough(spark, void=void)), "rough")
    plain = cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    views = rough_views(spark, 4, 600000.0)
    want = by_ray(trace.trace(views, cells, plain, ROUGH, surface))
    assert sum(v[0] is None for v in want.values()) > 50 < sum(v[0] is not None for v in want.values())
    stored, index = store.write_cells(cells, scratch_path(spark, "stored"), ROUGH)
    for got in (trace.trace(views, stored, index, ROUGH, surface), trace.trace(views, stored, index, ROUGH, surface, bands=(0.0005, 0.002))):
        got = by_ray(got)
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k][2:] == w[2:] and (got[k][0] == pytest.approx(w[0], abs=1e-6) if w[0] is not None else got[k][0] is None)


def test_rows_fall_with_each_level(spark):
    """Pieces after tiles, blocks of 64, blocks of 8 and cells: the cull leaves fewer cells than the flat path has."""
    cells = store.written(tiles.usable_cells(rough(spark, void=0.0)), "rough")
    index = store.written(tiles.tile_index(cells, ROUGH), "index")
    paths = trace.paths_of(rough_views(spark, 4, 4000.0, el=(0.3, -0.02)))
    flat = trace.cell_path(trace.cull_tiles(trace.tile_path(paths, ROUGH), index, F.col("low_slope")), ROUGH).count()
    met = trace.pieces_of(paths, index, ROUGH, F.col("low_slope"))
    left = met.filter("not over").count()
    assert 0 < left < 0.5 * flat
    length = lambda rows: rows.agg(F.sum(F.col("t1") - F.col("t0"))).first()[0]
    # without voids what is over and what is cut is the whole path over the culled tiles
    whole = trace.tile_path(paths, ROUGH).join(index.select("trow", "tcol"), ["trow", "tcol"])
    assert length(met) == pytest.approx(length(whole), rel=1e-9)


def test_levels_of_detail(spark):
    """Scale 0 is level 1 everywhere; else far tiles are coarse, fewer cells are tested and distances stay close; a tile with a void keeps level 1."""
    grid = tiles.Grid(2600000.0, 1200000.0, 10.0, 32)
    base = rough(spark, range(6), range(6), cells=32, void=0.0)
    holed = base.withColumn("z", F.when(~((F.col("trow") == 3) & (F.col("tcol") == 3) & (F.col("x") == 9) & (F.col("y") == 9)), F.col("z")))
    cells = store.written(levels.level_cells(holed, grid, 3), "cells")
    index = store.written(levels.level_index(cells, grid), "index")
    views = rough_views(spark, 3, 3000.0, el=(0.02, -0.3), size=(12, 12)).withColumn("footprint", F.lit(0.03))
    native = cells.filter("lod = 1").drop("lod")
    one = {(r.view_id, r.px, r.py): r for r in trace.trace(views, native, tiles.tile_index(native, grid), grid).collect()}
    none = {(r.view_id, r.px, r.py): r for r in levels.trace_levels(views, cells, index, grid, 3, 0.0).collect()}
    some = {(r.view_id, r.px, r.py): r for r in levels.trace_levels(views, cells, index, grid, 3, 3.0).collect()}
    assert {r.lod for r in none.values()} <= {1, None}
    assert all((none[k].distance is None) == (one[k].distance is None) and none[k].distance == pytest.approx(one[k].distance, abs=1e-6) for k in one if one[k].distance is not None)
    assert {r.lod for r in some.values()} >= {1, 2, 3}
    assert {r.lod for r in some.values() if (r.trow, r.tcol) == (3, 3)} <= {1}
    hit = [k for k in one if one[k].distance is not None and some[k].distance is not None]
    assert len(hit) > 100
    # waves of 126 m length and 8 m height: a cell of 40 m is off by 2 m at most, which a ray that sinks at 0.1 turns into some 20 m
    off = sorted(abs(one[k].elevation - some[k].elevation) for k in hit)
    assert off[len(off) // 2] < 2 and off[int(len(off) * 0.9)] < 12
    assert sum(r.n_cells for r in some.values()) < 0.8 * sum(r.n_cells for r in one.values())


def test_where_rays_rise_over_all(spark):
    from crestline.operators.rays import CURVATURE

    rows = [(k, s, z) for k, (s, z) in enumerate([(0.1, 900.0), (0.0, 900.0), (-0.01, 2000.0), (-0.2, 1500.0), (0.1, 2000.0), (-1e-5, 1100.5), (0.5, 1101.0), (1e-9, 1100.0)])]
    got = spark.createDataFrame(rows, "k int, s double, z double").withColumn("t", trace.over_all_from(F.col("s"), F.col("z"), F.lit(1100.0))).collect()
    for r in got:
        height = lambda t, r=r: r.z + r.s * t + CURVATURE * t * t
        assert r.t >= 0
        # above for good from t on, and not before it
        assert all(height(r.t + d) >= 1101.0 - 1e-6 for d in (0, 1, 1000, 1e6))
        assert r.t == 0 or height(r.t * (1 - 1e-6)) < 1101.0
    assert [r.k for r in got if r.t == 0] == [2, 4, 6]


def test_stored_cells_are_read_by_need(spark):
    """One short view reads a folder, not all; the plan prunes partitions at run time."""
    cells = tiles.usable_cells(flat(spark, trows=(0, 9, 18, 27), tcols=(0, 9, 18, 27)))
    stored, index = store.write_cells(cells, scratch_path(spark, "stored"), GRID)
    assert stored.select("brow", "bcol").distinct().count() == 16
    one = view(spark, 50.0, -50.0, 1020.0)
    found = trace.trace(one, stored, index, GRID)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    hits = found.filter("distance is not null").count()
    assert hits == trace.trace(one, cells, cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax")), GRID).filter("distance is not null").count() > 0
    need = trace.cells_by_need(stored, trace.paths_of(one), index, GRID, F.col("low_slope"))
    need.collect()
    read = scanned_files(need)
    assert read == 1 and scanned_files(stored, run=True) == 16


def scanned_files(df, run=False):
    """Files that the scan of an executed plan has read."""
    if run:
        df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet") and node.output().mkString(",").find("z00") >= 0:
            found.append(node.metrics().apply("numFiles").value())
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in name:
            walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return sum(found)


def test_a_stopped_overwrite_changes_nothing(spark, monkeypatch):
    """Between tiles and manifest, and between manifest and commit: readers see the old tile and its bounds, the next write goes on."""
    v = lambda z: spark.createDataFrame([(0, c, y, x, z) for c in range(2) for y in range(3) for x in range(3)], VERTEX).withColumn("lod", F.lit(1))
    path = scratch_path(spark, "tiles")
    store.write_tiles(v(100.0), path)

    def seen():
        tops = {r.z for r in store.read_tiles(spark, path).select("z").distinct().collect()}
        bounds = {round(r.zmax, 1) for r in store.read_manifest(spark, path).collect()}
        return tops, bounds

    for stop in ("_rescanned", "_last_commit"):
        calls = []

        def stopped(*args, stop=stop, calls=calls, real=getattr(store, stop)):
            calls.append(1)
            if stop == "_rescanned" or len(calls) > 2:
                raise KeyboardInterrupt
            return real(*args)

        with monkeypatch.context() as m:
            m.setattr(store, stop, stopped)
            if stop == "_last_commit":  # stop in the commit itself, before its row
                m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                store.write_tiles(v(2000.0), path, overwrite=True)
        assert seen() == ({100.0}, {100.0})
    assert tuple(store.write_tiles(v(2000.0), path).first())[:2] == (0, 2)
    assert seen() == ({100.0}, {100.0})
    assert tuple(store.write_tiles(v(2000.0), path, overwrite=True).first())[:2] == (2, 0)
    assert seen() == ({2000.0}, {2000.0})


def test_rows_without_bounds_are_rescanned(spark):
    v = spark.createDataFrame([(0, c, y, x, 10.0 * c + y) for c in range(3) for y in range(3) for x in range(3)], VERTEX).withColumn("lod", F.lit(1))
    path = scratch_path(spark, "tiles")
    store.write_tiles(v, path)
    whole = sorted(map(str, store.read_manifest(spark, path).collect()))
    last = store._last_commit(spark, path)
    lame = store._manifest(spark, path).withColumns({"zmax": F.when(F.col("tcol") != 1, F.col("zmax")), "coverage": F.when(F.col("tcol") != 2, F.col("coverage"))})
    store._commit(lame, path, "g-lame", last.seq + 1)
    assert store._manifest(spark, path).filter("zmax is null or coverage is null").count() == 2
    assert sorted(map(str, store.read_manifest(spark, path).collect())) == whole
    # the next write completes them
    more = spark.createDataFrame([(7, 7, y, x, 1.0) for y in range(3) for x in range(3)], VERTEX).withColumn("lod", F.lit(1))
    store.write_tiles(more, path)
    assert store._manifest(spark, path).filter("zmax is null or coverage is null").count() == 0
    assert sorted(map(str, store.read_manifest(spark, path).filter("trow = 0").collect())) == whole


def test_of_two_writers_one_fails(spark):
    v = spark.createDataFrame([(0, 0, y, x, 1.0) for y in range(3) for x in range(3)], VERTEX).withColumn("lod", F.lit(1))
    path = scratch_path(spark, "tiles")
    store.write_tiles(v, path)
    listed = store._manifest(spark, path)
    store._commit(listed, path, "g-a", 2)
    with pytest.raises(RuntimeError):
        store._commit(listed, path, "g-b", 2)
    assert store._last_commit(spark, path).gen == "g-a"


def test_peak_search_by_index_equals_substring_search(spark):
    """Texts of one letter to whole names, accents, ligatures, nothing found; an equi-join, no nested loop, whatever the sizes."""
    draw = random.Random(3)
    names = ["".join(draw.choice(["a", "b", "É", "s", " ", "ö"]) for _ in range(draw.randrange(0, 9))) for _ in range(300)] + ["Straße", "Ärmeĺ", "Łódź", None]
    asked = ["a", "É", "ab", "B ", "aé", "sss", "aBa", "bös", "  ess ", "strass", "armel", "lodz", "zzz", "", " ", None, "aaaaaaaaaaaa", *[n for n in names[:40] if n]]
    peaks = spark.createDataFrame([(k, 46.0 + k / 1000, 7.0, n) for k, n in enumerate(names)], "peak_id long, lat double, lon double, name string")
    queries = spark.createDataFrame([(k, t, 46.0, 7.0) for k, t in enumerate(asked)], "query_id long, text string, lat double, lon double")
    import unicodedata

    def fold(t):
        plain = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        return plain.replace("ß", "ss").replace("ł", "l")

    want = set()
    for q, t in enumerate(asked):
        w = fold((t or "").strip(" "))
        hits = sorted((0 if fold(n) == w else 1 if fold(n).startswith(w) else 2, k) for k, n in enumerate(names) if n is not None and w and w in fold(n))
        want |= {(q, r + 1, k, m) for r, (m, k) in enumerate(hits[:6])}
    found = points.search_peaks(queries, peaks)
    assert {(r.query_id, r.rank, r.peak_id, r.match) for r in found.collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = points.search_peaks(queries, peaks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan


def swiss_and_french(spark, order, seed=11):
    """Two rough layers with holes near Geneva, one in EPSG 2056 and a wider one in 2154, the lower one raised."""
    from crestline.functions.geodesy import from_crs, to_crs

    rng = random.Random(seed)
    x, y = 2500500.0, 1117500.0
    at = spark.range(1).select(from_crs(F.lit(x), F.lit(y), 2056).alias("p")).select(to_crs(F.col("p.lon"), F.col("p.lat"), 2154).alias("q")).first().q
    swiss, french = tiles.Grid(x - 80.0, y + 80.0, 10.0, 16), tiles.Grid(at.x - 240.0, at.y + 240.0, 15.0, 16)

    def layer(n, base):
        z = {(gx, gy): None if rng.random() < 0.01 else base + 10 * math.sin(gx * 0.9) + 8 * math.cos(gy * 0.7) + rng.uniform(-2, 2) for gx in range(16 * n + 1) for gy in range(16 * n + 1)}
        rows = [(tr, tc, py, px, z[tc * 16 + px, tr * 16 + 16 - py]) for tr in range(n) for tc in range(n) for py in range(17) for px in range(17)]
        return store.written(tiles.usable_cells(spark.createDataFrame(rows, VERTEX)), "layer")

    both = {"swiss": (layer(1, 1000.0), swiss, 2056), "french": (layer(2, 1004.0), french, 2154)}
    return [stacked.Layer(both[k][0], both[k][1], 9.0 * n, both[k][2]) for n, k in enumerate(order)], (x, y)


@pytest.mark.parametrize("order", [("swiss", "french"), ("french", "swiss")])
def test_layers_of_two_systems_equal_a_dense_march(spark, order):
    """A stack in the frame of 2056: hits, owners and gradients against points sampled every 10 cm by latitude and longitude."""
    from crestline.functions.geodesy import from_crs
    from crestline.operators.rays import CURVATURE

    layers, (x, y) = swiss_and_french(spark, order)
    at = view(spark, x + 3.3, y - 4.1, 1060.0, el=(-0.2, -1.2), size=(11, 6), tmax=240.0)
    hits = store.written(trace_gradients(at, layers), "hits")
    rays = store.written(trace.rays_of(at).select("px", "py", "x", "y", "z", "dx", "dy", "slope"), "rays")

    def heights(points):
        placed = points.withColumn("_p", from_crs(F.col("ax"), F.col("ay"), 2056)).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")}).drop("_p")
        return stacked.sample_stack(placed, layers)

    march = rays.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2400)))).withColumn("t", F.col("t") * 0.1)
    march = heights(march.withColumns({"ax": F.col("x") + F.col("dx") * F.col("t"), "ay": F.col("y") + F.col("dy") * F.col("t")}))
    over = F.col("z") + F.col("slope") * F.col("t") + CURVATURE * F.col("t") * F.col("t") - F.col("ground")
    by_ray_march = {}
    for r in march.select("px", "py", "t", "dataset_id", over.alias("over")).orderBy("px", "py", "t").toPandas().itertuples(index=False):
        by_ray_march.setdefault((r.px, r.py), []).append((r.t, None if math.isnan(r.over) else r.over, None if math.isnan(r.dataset_id) else int(r.dataset_id)))
    want = {}
    for k, steps in by_ray_march.items():
        before, covered = None, True
        for t, above, owner in steps:
            covered = covered and above is not None
            if above is not None and before is not None and (above > 0) != (before[0] > 0) and (owner == before[1] or (covered and above <= 0)):
                want[k] = (t, owner)
                break
            before = None if above is None else (above, owner)
    got = {(r.px, r.py): r for r in hits.collect()}
    owners, far = set(), 0
    for k in by_ray_march:
        if (k in want) != (k in got):
            far += 1
        elif k in want:
            far += abs(want[k][0] - got[k].distance) > 0.25 or want[k][1] != got[k].dataset_id
            owners.add(got[k].dataset_id)
    # rays that graze an edge of a hole or of a layer by centimetres may go either way
    assert owners == {0, 1} and len(want) > 45 and far <= 1
    # gradients: by differences of 10 cm along the frame's axes, where those stay in the cell
    spots = hits.filter("sx between 0.05 and 0.95 and sy between 0.05 and 0.95").select(
        "px", "py", "dataset_id", "grad_e", "grad_n", (F.col("x") + F.col("dx") * F.col("distance")).alias("hx"), (F.col("y") + F.col("dy") * F.col("distance")).alias("hy"))
    near = {}
    for name, ex, ey in (("e", 0.1, 0.0), ("w", -0.1, 0.0), ("n", 0.0, 0.1), ("s", 0.0, -0.1)):
        moved = heights(spots.select("px", "py", (F.col("hx") + ex).alias("ax"), (F.col("hy") + ey).alias("ay")))
        near[name] = {(r.px, r.py): (r.ground, r.dataset_id) for r in moved.collect()}
    checked = 0
    for r in spots.collect():
        e, w, n, s = (near[c][r.px, r.py] for c in "ewns")
        if {e[1], w[1], n[1], s[1]} == {r.dataset_id}:
            checked += r.dataset_id == order.index("french")
            assert (e[0] - w[0]) / 0.2 == pytest.approx(r.grad_e, abs=0.02) and (n[0] - s[0]) / 0.2 == pytest.approx(r.grad_n, abs=0.02)
    assert checked > 5


def trace_gradients(views, layers):
    return stacked.stack_gradients(stacked.trace_stack(views, layers, frame_epsg=2056, residual=0.02), layers)


def test_inspect_with_place_and_true_north(spark):
    """Aspects against points moved downhill by the geodesic: they are lower, and lowest among directions."""
    from crestline.functions.geodesy import from_crs

    rows = [(1, k, 0, 2500000.0 + 1000 * k, 1110000.0, 0.6, 0.8, 50.0, 900.0, 0.3 * math.cos(k), 0.3 * math.sin(k)) for k in range(8)] + [(1, 8, 0, 2500000.0, 1110000.0, 0.6, 0.8, None, None, None, None), (1, 9, 0, 2500000.0, 1110000.0, 1.0, 0.0, 9.0, 1.0, 0.0, 0.0)]
    hits = spark.createDataFrame(rows, "view_id long, px int, py int, x double, y double, dx double, dy double, distance double, elevation double, grad_e double, grad_n double")
    pixels = hits.select("view_id", "px", "py")
    plain = {r.px: r for r in points.inspect(hits, pixels).collect()}
    got = {r.px: r for r in points.inspect(hits, pixels, 2056).collect()}
    assert got.keys() == plain.keys() == set(range(8)) | {9} and got[9].aspect_deg is None
    for k in range(8):
        at = spark.range(1).select(from_crs(F.lit(rows[k][3] + 30.0), F.lit(rows[k][4] + 40.0), 2056).alias("p")).first().p
        assert (got[k].lat, got[k].lon) == pytest.approx((at.lat, at.lon), abs=1e-12) and got[k].slope_deg == pytest.approx(math.degrees(math.atan(0.3)))
        # west of the system's meridian its north lies west of true north by the same angle everywhere here
        turn = (got[k].aspect_deg - plain[k].aspect_deg + 180) % 360 - 180
        assert 0.5 < abs(turn) < 1.5 and turn * ((got[0].aspect_deg - plain[0].aspect_deg + 180) % 360 - 180) > 0


def test_tiles_in_wide_circles(spark):
    """Circles over many blocks of tiles, few of which are there: the rows of a plain search, and few keys on the way."""
    draw = random.Random(9)
    keys = {(draw.randrange(-300, 300), draw.randrange(-300, 300)) for _ in range(300)} | {(r, c) for r in range(20) for c in range(20)}
    tiles_ = spark.createDataFrame([(*k, 0) for k in keys], "trow long, tcol long, priority int")
    seen = [(k, draw.uniform(-40000, 40000), draw.uniform(-40000, 40000)) for k in range(12)] + [(99, 85.0, -85.0)]
    observers = spark.createDataFrame(seen, "observer_id long, x double, y double")
    for radius in (0.0, 500.0, 30000.0):
        got = {(r.observer_id, r.trow, r.tcol) for r in catalogue.tiles_in_range(tiles_, observers, GRID, radius, 10**6).collect()}
        want = set()
        for o, x, y in seen:
            for r, c in keys:
                dx, dy = max(c * 160 - x, x - c * 160 - 160, 0), max(-(r + 1) * 160 - y, y + r * 160, 0)
                if math.hypot(dx, dy) <= radius or (math.floor(-y / 160), math.floor(x / 160)) == (r, c):
                    want.add((o, r, c))
        assert got == want
    here = observers.withColumns({"_r": F.floor(-F.col("y") / 160), "_c": F.floor(F.col("x") / 160)})
    # a square of keys would have (2 * 188 + 1)^2 an observer
    assert catalogue.in_circles(here, tiles_, GRID, 30000.0).count() < 13 * 377**2 / 4


def test_ascii_grids_by_splits_and_in_archives(spark, tmp_path):
    """A grid cut into many splits, lines broken anywhere, CRLF, no final newline; members of archives; each sample at its place."""
    import zipfile

    draw = random.Random(2)
    want = {}
    for name, cols, rows, sep in (("a.asc", 37, 90, "\n"), ("b.asc", 5, 400, "\r\n"), ("c.asc", 1, 3, "\n")):
        values = [round(draw.uniform(-50, 4000), 2) for _ in range(cols * rows)]
        want[name] = {(k // cols, k % cols): v for k, v in enumerate(values)}
        text, k = f"NCOLS {cols}{sep}nrows {rows}{sep} xllcenter 10.5{sep}yllcorner -20{sep}CellSize 2e1{sep}NODATA_value -9999{sep}", 0
        while k < len(values):  # lines of any length, not the raster's rows
            n = draw.randrange(1, 60)
            text += " " * draw.randrange(2) + " ".join(map(str, values[k : k + n])) + (sep if k + n < len(values) else "")
            k += n
        (tmp_path / name).write_text(text, newline="")
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name in want:
            z.write(tmp_path / name, f"in/{name.upper()}")
    (tmp_path / "e.asc").write_text("ncols 2\nnrows 0\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = rasters.read_asc(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path), pathGlobFilter="a.asc").rdd.getNumPartitions() > 3
        found = {}
        for r in got.collect():
            found.setdefault(r.source, {})[r.row, r.col] = r.value
            assert (r.x0, r.y0, r.cell, r.no_data) == (10.5, -20.0, 20.0, -9999.0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == want
    zipped = {}
    for r in rasters.read_zipped_asc(spark, str(tmp_path)).collect():
        zipped.setdefault(r.member, {})[r.row, r.col] = r.value
        assert (r.source, r.x0, r.cell) == ("z.zip", 10.5, 20.0)
    assert zipped == {f"in/{k.upper()}": v for k, v in want.items()}


def test_srtm_source_writes_and_reads(spark, tmp_path):
    from crestline.sources import srtm

    rows = [(46, 7, 0, 0, 100.4), (46, 7, 1200, 1200, -430.0), (46, 7, 5, 9, None), (-1, -10, 3, 4, 32767.0)]
    samples = spark.createDataFrame(rows, "lat int, lon int, col long, row long, value double")
    srtm.write_hgt(samples, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["N46E007.hgt", "S01W010.hgt"]
    got = {(r.lat, r.lon, r.col, r.row): r.value for r in srtm.read_srtm(spark, f"{tmp_path}/out", voids=False).collect()}
    assert got == {(46, 7, 0, 0): 100.0, (46, 7, 1200, 1200): -430.0, (-1, -10, 3, 4): 32767.0}
    whole = srtm.read_srtm(spark, f"{tmp_path}/out")
    assert whole.rdd.getNumPartitions() == 2 and whole.count() == 2 * 1201**2
    # the reader that goes through Spark's own file readers sees the same
    other = rasters.read_hgt(spark, f"{tmp_path}/out").filter("mask = 1")
    assert {(r.lat, r.lon, r.col, r.row): r.value for r in other.collect()} == got
    for bad in ([(46, 7, 1201, 0, 1.0)], [(46, 7, 0, 0, 1e6)]):
        with pytest.raises(Exception, match="can't hold"):
            srtm.write_hgt(spark.createDataFrame(bad, samples.schema), f"{tmp_path}/bad")
    assert not any(p.suffix == ".hgt" for p in (tmp_path / "bad").iterdir()) if (tmp_path / "bad").exists() else True


def test_footprints_and_patches(spark):
    """Corners by the projection; patches tile the tile, are within the residual at every node of a fine net, and are as large as that allows."""
    from crestline.functions.columns import let
    from crestline.functions.geodesy import from_crs, to_crs

    grid = tiles.Grid(2500000.0, 1120000.0, 250.0, 64)
    keys = spark.createDataFrame([(0, 0), (3, 2)], "trow long, tcol long")
    for r in catalogue.coverage_footprints(keys, grid, lambda x, y: from_crs(x, y, 2056)).collect():
        for c, (i, j) in zip(r.corners, ((0, 0), (1, 0), (1, 1), (0, 1)), strict=True):
            x, y = 2500000.0 + (r.tcol + i) * 16000, 1120000.0 - (r.trow + 1 - j) * 16000
            p = spark.range(1).select(from_crs(F.lit(x), F.lit(y), 2056).alias("p")).first().p
            assert (c.lat, c.lon) == pytest.approx((p.lat, p.lon), abs=1e-12)

    def place_of(trow, tcol):
        return lambda col, row: let(from_crs(grid.origin_x + tcol * grid.width + col * grid.cell, grid.origin_y - (trow + 1) * grid.width + row * grid.cell, 2056), lambda p: to_crs(p["lon"], p["lat"], 2154))

    patches = catalogue.tile_patches(keys, grid.cells, place_of, 0.25)
    mapped = store.written(patches.withColumn("m", catalogue.patch_map(F.col("col0"), F.col("row0"), F.col("size"), place_of(F.col("trow"), F.col("tcol")))), "patches")
    area = {(r.trow, r.tcol): r.a for r in mapped.groupBy("trow", "tcol").agg(F.sum(F.col("size") ** 2).alias("a")).collect()}
    assert area == {(0, 0): 64.0**2, (3, 2): 64.0**2}
    net = mapped.withColumn("i", F.explode(F.array(*[F.lit(k / 4) for k in range(5)]))).withColumn("j", F.explode(F.array(*[F.lit(k / 4) for k in range(5)])))
    col, row = F.col("col0") + F.col("i") * F.col("size"), F.col("row0") + F.col("j") * F.col("size")
    true = place_of(F.col("trow"), F.col("tcol"))(col, row)
    off = net.select(true.alias("p"), (F.col("m.x0") + col * F.col("m.ax") + row * F.col("m.bx")).alias("x"), (F.col("m.y0") + col * F.col("m.ay") + row * F.col("m.by")).alias("y"))
    assert off.agg(F.max(F.hypot(F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y")))).first()[0] < 0.26
    sizes = {r.size for r in mapped.select("size").distinct().collect()}
    assert max(sizes) > 1
    # one a quarter as large would do for none: the patch above each was too coarse
    parent = mapped.filter("size < 64").select("trow", "tcol", *[(F.floor(F.col(c) / (2 * F.col("size"))) * 2 * F.col("size")).alias(c) for c in ("col0", "row0")], (2 * F.col("size")).alias("size"))
    worst = parent.withColumn("r", catalogue.patch_residual(F.col("col0"), F.col("row0"), F.col("size"), place_of(F.col("trow"), F.col("tcol")))).agg(F.min("r")).first()[0]
    assert worst is None or worst > 0.25


def test_products_and_their_rules(spark):
    hits = spark.createDataFrame([(1, 0, 0, 5.0, 900.0, 0.1, 0.2, 3, 2)], "view_id long, px int, py int, distance double, elevation double, grad_e double, grad_n double, n_steps long, n_cells long")
    path = scratch_path(spark, "products")
    store.write_products(hits, path, list(store.DIAGNOSTICS))
    assert spark.read.parquet(f"{path}/steps").collect() == [(1, 0, 0, 3)] and spark.read.parquet(f"{path}/normals").columns == ["view_id", "px", "py", "grad_e", "grad_n"]
    grey = [*hits.columns, "grey"]
    store.check_products(["synthetic"], grey, "elevation", (0.0, 1.0))
    no_normals, no_heights = [c for c in grey if "grad" not in c], [c for c in grey if c != "elevation"]
    for bad in (([], grey), (["pictures"], grey), (["steps"], ["view_id"]), (["synthetic"], no_normals), (["synthetic"], no_heights, "elevation"), (["distances"], grey, "distance"), (["synthetic"], grey, "red"),
                (["distances"], grey, "white", (2.0, 1.0)), (["distances"], grey, "white", (0.0, float("nan"))), (["synthetic"], grey, "white", (0.0, 1.0))):
        with pytest.raises(ValueError):
            store.check_products(*bad)


def test_steps_of_rays(spark):
    """On a plain every cell of a path is tested or hidden, so a ray's steps are the pieces of its path up to the hit."""
    cells = tiles.usable_cells(flat(spark))
    manifest = cells.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    at = view(spark, 55.0, -85.0, 1015.0, el=(-0.05, -1.0), size=(8, 6))
    hits = [r for r in trace.trace(at, cells, manifest, GRID).collect() if r.distance is not None]
    pieces = trace.cell_path(trace.tile_path(trace.paths_of(at), GRID), GRID).join(cells.select("trow", "tcol", F.col("y").alias("cy"), F.col("x").alias("cx")), ["trow", "tcol", "cy", "cx"])
    begins = {}
    for r in pieces.select("px", "t0").collect():
        begins.setdefault(r.px, []).append(r.t0)
    assert len(hits) > 20
    for r in hits:
        assert r.n_steps in {sum(t < r.distance + d for t in begins[r.px]) for d in (-1e-6, 1e-6)} and r.n_cells >= 1

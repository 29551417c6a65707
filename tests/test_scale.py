"""What keeps figures from growing faster than the input: tasks, broadcasts, work that is done once."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import catalogue, points, rays, tiles, trace
from crestline.plans.all import QUERIES
from crestline.storage import written

GRID = tiles.Grid(0.0, 0.0, 10.0, 16)
CELL = "trow long, tcol long, y int, x int, z00 double, z01 double, z10 double, z11 double, zmax double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def first_plan(df):
    """The plan before it is run, in which each step is named once."""
    text = df.select("*")._jdf.queryExecution().executedPlan().toString()
    return text[text.index("Initial Plan"):] if "Initial Plan" in text else text


@pytest.fixture(scope="module")
def ground(spark):
    rng = random.Random(5)
    rows = [(0, 0, y, x, *(z := [rng.uniform(0, 5) for _ in range(4)]), max(z)) for y in range(16) for x in range(16)]
    return spark.createDataFrame(rows, CELL)


@pytest.fixture(scope="module")
def looking(spark):
    rows = [(v, 20.0 + 9 * v, -30.0 - 7 * v, 9.0 + v, 4, 3, 0.1, 6.3, -0.1, -0.6, 90.0) for v in range(10)]
    return spark.createDataFrame(rows, "view_id long, x double, y double, z double, width int, height int, az0 double, az1 double, el0 double, el1 double, tmax double").coalesce(1)


CAMERA = {"heading": 0.3, "pitch": -0.4, "roll": 0.0, "fx": 4.0, "fy": 4.0, "cx": 2.0, "cy": 1.5}


def camera(views):
    return views.withColumns({k: F.lit(v) for k, v in CAMERA.items()})


def test_views_of_one_file_are_traced_by_all_tasks(spark, looking):
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert looking.rdd.getNumPartitions() == 1
    assert rays.angular_columns(looking).rdd.getNumPartitions() == many > 1
    assert rays.camera_rays(camera(looking)).rdd.getNumPartitions() == many


def test_pixels_are_undistorted_once(looking):
    lens = {"k1": F.when(F.col("view_id") % 5 == 0, -0.6).otherwise(0.05), "k2": F.lit(-0.01), "k3": F.lit(0.001), "p1": F.lit(0.002), "p2": F.lit(-0.001)}
    every = rays.camera_rays(camera(looking).withColumns({**lens, "fx": F.lit(0.9), "fy": F.lit(0.9)}))
    bad = {r.view_id for r in every.filter("slope is null").collect()}
    left = rays.without_bad_views(every)
    assert "Join" not in plan(left)
    assert bad and {r.view_id for r in left.collect()} == set(range(10)) - bad and left.columns == every.columns


def test_paths_are_not_broadcast(looking, ground):
    """r9, r16: the cells that paths cross are many times the table that the views come from."""
    entries = trace.entries(rays.angular_rays(looking), ground, GRID)
    assert "BroadcastHashJoin" not in plan(entries)
    assert entries.count() > 100
    manifest = ground.groupBy("trow", "tcol").agg(F.max("zmax").alias("zmax"))
    assert "BroadcastHashJoin" not in plan(trace.cull_tiles(trace.tile_path(rays.angular_columns(looking), GRID), manifest, F.lit(-0.2)))
    assert "BroadcastHashJoin" not in plan(trace.crossed_cells(rays.angular_rays(looking), ground, manifest, GRID))


def test_spots_and_targets_are_not_broadcast(spark, looking):
    """p2, p3: as many targets and hits as views, pixels and tiles make."""
    views = camera(looking).withColumn("pixel_size", F.lit(0.2))
    targets = spark.range(40).select((F.col("id") % 10).alias("view_id"), F.col("id").alias("target_id"), (F.col("id") * 3.0 + 50).alias("east"), F.lit(60.0).alias("north"),
                                     F.lit(-20.0).alias("dz"), F.lit(1.0).alias("prominence"), F.lit(1.0).alias("elevation"))
    assert "BroadcastHashJoin" not in plan(points.projected(views, targets))
    hits = rays.angular_rays(looking).withColumns({"distance": F.lit(60.0), "elevation": F.lit(0.0)})
    assert "BroadcastHashJoin" not in plan(points.visible_peaks(views, hits, targets))


@pytest.fixture(scope="module")
def stored_views(spark, looking, tmp_path_factory):
    """Views as a table has them: Spark knows that it is small."""
    path = str(tmp_path_factory.mktemp("views") / "views")
    looking.write.parquet(path)
    return spark.read.parquet(path)


def test_rays_are_not_broadcast_where_hits_alone_are_asked(stored_views, ground):
    """h4-h7, p6, r14. A filter made the outer join of rays and hits an inner one, and all rays went through the driver."""
    manifest = tiles.tile_index(ground, GRID)
    every = trace.trace(stored_views, ground, manifest, GRID, keep=("z00",))
    met = every.filter("distance is not null")
    assert "Broadcast" not in first_plan(met)
    want = sorted(tuple(r) for r in every.collect() if r.distance is not None)
    assert len(want) > 50 and sorted(map(tuple, met.collect())) == want


def test_suns_are_not_broadcast(spark, stored_views, ground):
    """a5's suns are their views' table widened by instants, of whose rows Spark knew a third."""
    manifest = tiles.tile_index(ground, GRID)
    found = trace.trace(stored_views, ground, manifest, GRID, keep=("z00", "z01", "z10", "z11")).filter("distance is not null")
    e, n = trace.gradient_bilinear(F.col("sx"), F.col("sy"), GRID.cell)
    hits = written(found.withColumns({"grad_e": e, "grad_n": n}), "hits")
    suns = stored_views.select("view_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("instant")).withColumns(
        {"azimuth": F.col("instant") + 0.5, "elevation": 0.5 - 0.3 * F.col("instant")})
    lit = trace.sunlit_hits(hits, suns, ground, manifest, GRID, 300.0)
    assert "Broadcast" not in first_plan(lit)
    alone = [trace.shadow_visibility(hits, ground, manifest, GRID, k + 0.5, 0.5 - 0.3 * k, 300.0).withColumn("instant", F.lit(k)) for k in range(3)]
    key = lambda df: sorted(map(tuple, df.select("view_id", "px", "py", "instant", "lit").collect()))
    got = key(lit)
    assert len(got) > 150 and {r[-1] for r in got} == {True, False} and got == [r for r in sorted(sum(map(key, alone), []))]


def test_products_are_not_broadcast(spark):
    """of s9's sorted tables the counts of steps take 1.5 bytes a row, so Spark took millions of rows for small."""
    back = QUERIES["s9_write_products"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in first_plan(back)
    assert back.count() == 10


def test_centres_are_dealt_and_not_broadcast(spark):
    centres = spark.range(50).select(F.col("id").alias("centre_id"), (F.col("id") * 3.0).alias("x"), (F.col("id") * -2.0).alias("y")).coalesce(1)
    vertices = spark.createDataFrame([(0, 0, c, r, float(c + r)) for c in range(17) for r in range(17)], "trow long, tcol long, col long, row long, z double")
    near = points.near_vertices(centres, vertices, GRID, 25.0)
    assert "BroadcastHashJoin" not in plan(near)
    want = sum(1 for k in range(50) for c in range(17) for r in range(17) if ((c * 10 - 3 * k) ** 2 + (2 * k - r * 10) ** 2) ** 0.5 <= 25)
    assert points.grid_points(centres, vertices, GRID, 25.0).count() == want


def test_compiled_root_is_that_of_the_expression(looking, ground):
    met = trace.crossed_cells(rays.angular_rays(looking), ground, None, GRID)
    both = trace.solved(met, GRID).withColumn("u", trace.hit_bilinear(F.col("slope"), GRID)).select("t", "u").collect()
    assert sum(r.t is not None for r in both) > 20 and sum(r.t is None for r in both) > 20
    assert all(r.t == r.u for r in both)


def test_peaks_alike_are_measured_once(spark, monkeypatch):
    """p1: many queries of few texts, many peaks of few names; what is compared does not grow with their product."""
    rng = random.Random(3)
    names = ["Piz Bernina", "Piz Palü", "Bernina-Nord", "Monte Rosa"]
    peaks = [(i, names[i % 4], 46.0 + i % 3 / 10, 7.0 + i % 5 / 10) for i in range(1200)]
    asked = [(q, rng.choice(["bernina", "piz", "rosa", "PIZ PALU", "zz", "o"]), 46.0, 7.0 + q % 2 / 10) for q in range(300)]
    stored, was = [], points.written

    def counted(df, what):
        found = was(df, what)
        stored.append(found.count())
        return found

    monkeypatch.setattr(points, "written", counted)
    got = points.search_peaks(spark.createDataFrame(asked, "query_id long, text string, lat double, lon double"), spark.createDataFrame(peaks, "peak_id long, name string, lat double, lon double")).collect()
    # 12 questions at most, of 4 names at 15 places with 6 peaks each
    assert stored[0] <= 12 * 4 * 15 * 6
    fold = lambda s: s.lower().replace("ü", "u")
    for q, text, lat, lon in asked:
        mine = sorted((r["rank"], r.peak_id) for r in got if r.query_id == q)
        want = fold(text)
        every = [(0 if fold(n) == want else 1 if fold(n).startswith(want) else 2, round(((la - lat) * 111.2) ** 2 + ((lo - lon) * 77.2) ** 2, 3), i) for i, n, la, lo in peaks if want in fold(n)]
        assert [p for _, p in mine] == [i for *_, i in sorted(every)[:6]], text


def test_distances_in_batches_are_geodesics(spark):
    """p8, p9: the same metres as geodesic(), near by, over the date line, at poles and on the other side."""
    from crestline.functions.geodesy import distances, geodesic

    rng = random.Random(9)
    rows = [(a := rng.uniform(-90, 90), b := rng.uniform(-180, 180), a + rng.uniform(-1e-3, 1e-3), b + rng.uniform(-1e-3, 1e-3)) for _ in range(200)]
    rows += [tuple(rng.uniform(-s, s) for s in (90, 180, 90, 180)) for _ in range(200)]
    rows += [(10.0, 179.9, 10.1, -179.9), (90.0, 0.0, 89.9, 50.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.3, 179.8), (5.0, 5.0, -5.0, -175.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    both = df.select(distances(*map(F.col, "abcd")).alias("t"), geodesic(*map(F.col, "abcd"))["distance"].alias("u")).collect()
    assert all(abs(r.t - r.u) < 1e-6 for r in both)


def flat_crossings(x, y, dx, dy, t0, t1, step):
    ts = [t0, t1]
    for p, d in ((x, dx), (y, dy)):
        if abs(d) > 1e-12:
            ts += [t for k in range(-60, 61) if t0 < (t := (k * step - p) / d) < t1]
    ts.sort()
    return [(a, b) for a, b in zip(ts, ts[1:]) if b - a > trace.NUDGE]


def test_paths_are_cut_by_compiled_columns(spark, ground, looking):
    """lambdas over arrays of crossings took most of a trace's time."""
    rng = random.Random(11)
    rows = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), *rng.choice([(0.6, 0.8), (-0.8, 0.6), (1.0, 0.0), (0.0, -1.0), (-0.6, -0.8), (2**-0.5, 2**-0.5)]), rng.uniform(0, 5), rng.uniform(5, 90)) for i in range(60)]
    rows += [(60, 0.0, 0.0, 0.6, 0.8, 0.0, 50.0), (61, 0.0, 0.0, 2**-0.5, 2**-0.5, 0.0, 50.0), (62, 5.0, 5.0, 0.0, 1.0, 1.0, 2.0), (63, 10.0, -10.0, -1.0, 0.0, 0.0, 30.0)]
    at = spark.createDataFrame(rows, "i int, x double, y double, dx double, dy double, t0 double, t1 double")
    cut = trace.cut_at(at, *[F.col(c) for c in ("x", "y", "dx", "dy", "t0", "t1")], 10.0)
    found = {}
    for r in cut.collect():
        found.setdefault(r.i, []).append((r._a, r._b))
    for i, *path in rows:
        want = flat_crossings(*path, 10.0)
        assert len(found[i]) == len(want) and [t for ab in sorted(found[i]) for t in ab] == pytest.approx([t for ab in want for t in ab], abs=1e-9)
    assert set(at.columns) | {"_a", "_b"} == set(cut.columns)
    manifest = tiles.tile_index(ground, GRID)
    assert "lambda" not in plan(trace.pieces_of(trace.paths_of(looking), manifest, GRID, F.col("low_slope")))


def longest_method(df):
    """Bytes of the longest method in the code that Spark compiles for df; the JVM interprets those of more than 8,000."""
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_code_of_traces_is_compiled_by_the_jvm(looking, ground):
    """Paths were cut in a method of 26,145 bytes, interpreted for every piece."""
    manifest = tiles.tile_index(ground, GRID)
    paths = trace.stop_rising(trace.paths_of(looking), manifest, F.col("low_slope"))
    assert 0 < longest_method(trace.pieces_of(paths, manifest, GRID, F.col("low_slope"))) < 8000
    assert 0 < longest_method(trace.trace(looking, ground, manifest, GRID)) < 8000
    shadows = rays.angular_rays(looking).limit(50)
    assert 0 < longest_method(trace.crossed_cells(shadows, ground, manifest, GRID)) < 8000


def test_cells_of_folders_are_those_of_vertices(spark):
    """samples on the lines between folders, voids, ties of rank; cells and index as from vertices one by one."""
    rng = random.Random(21)
    at = [(c, r) for c in range(120, 150) for r in range(117, 143)] + [(c, r) for c in range(4) for r in range(3)]
    rows = [(c, r, rng.randrange(3), rng.randrange(2), float(rng.randrange(900))) for c, r in at for _ in range(rng.choice([0, 1, 3, 4, 4, 4, 4, 4]))]
    samples = spark.createDataFrame(rows, "col long, row long, source_id int, o long, z double")
    rank = ["source_id", "o", "z"]
    vertices = tiles.assign_tiles(tiles.mosaic(samples, rank), 16).filter("trow >= 0 and tcol >= 0")
    want = tiles.usable_cells(vertices)
    got = tiles.folder_cells(samples, rank, 16)
    key = lambda df: sorted(map(tuple, df.select("trow", "tcol", "y", "x", "z00", "z01", "z10", "z11", "zmax").collect()))
    assert key(got) == key(want) and len({(r.brow, r.bcol) for r in got.collect()}) == 4
    assert got.filter("brow <> trow div 8 or bcol <> tcol div 8").count() == 0
    index = {(r.trow, r.tcol): r for r in tiles.tile_index(got, GRID).collect()}
    for (trow, tcol), r in index.items():
        mine = [c for c in key(got) if c[:2] == (trow, tcol)]
        assert r.zmax == max(c[-1] for c in mine) and r.full == (len(mine) == 256) and len(r.b8) == 4
        for k, b in enumerate(r.b8):
            block = [c[-1] for c in mine if (c[2] // 8, c[3] // 8) == divmod(k, 2)]
            assert (b is None) == (not block) and (not block or (b.top, b.full) == (max(block), len(block) == 64))


def rough_samples(spark, seed=3):
    rng = random.Random(seed)
    rows = [(c, r, rng.randrange(3), rng.randrange(2), rng.uniform(0.0, 6.0)) for c in range(60) for r in range(50) for _ in range(rng.choice([0, 1, 2, 4, 4, 4, 4, 4]))]
    return spark.createDataFrame(rows, "col long, row long, source_id int, o long, z double")


RANKED = ["source_id", "o", "z"]


def test_tiles_with_heights_are_the_index_of_their_cells(spark, monkeypatch):
    """Samples in pieces of a few rows, NULL in the rank; index, cells and heights as from vertices one by one."""
    samples = rough_samples(spark).withColumn("o", F.when(F.col("z") > 1, F.col("o")))
    vertices = tiles.assign_tiles(tiles.mosaic(samples, RANKED), 16).filter("trow >= 0 and tcol >= 0")
    cells = tiles.usable_cells(vertices)
    want = {(r.trow, r.tcol): r for r in tiles.tile_index(cells, GRID).collect()}
    monkeypatch.setattr(tiles, "SAMPLES_AT_ONCE", 90)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = tiles.folder_tiles(samples, RANKED, 16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    got = {(r.trow, r.tcol): r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all((got[k].zmax, got[k].full, got[k].b8) == (w.zmax, w.full, w.b8) for k, w in want.items())
    at = {(v.trow, v.tcol, v.y, v.x): v.z for v in vertices.collect()}
    assert all(r.heights[17 * y + x] == at.get((r.trow, r.tcol, y, x)) for r in rows for y in range(17) for x in range(17))
    schema = tiles.folder_tiles(samples, RANKED, 16).schema
    key = lambda df: sorted(map(tuple, df.select("trow", "tcol", "y", "x", "z00", "z01", "z10", "z11", "zmax").collect()))
    assert key(tiles.cells_of(spark.createDataFrame(rows, schema), 16)) == key(cells)


def test_cells_are_found_in_the_heights_of_their_tile(spark, looking):
    """Pieces of paths were joined to cells, both shuffled; with heights in the index no cell is asked, and all columns are the same."""
    samples = rough_samples(spark)
    cells = tiles.folder_cells(samples, RANKED, 16).drop("brow", "bcol")
    index = tiles.folder_tiles(samples, RANKED, 16)
    views = looking.withColumns({"x": F.col("x") + 150, "y": F.col("y") - 170, "tmax": F.lit(400.0)})
    keep = ("z00", "z01", "z10", "z11")
    want = trace.trace(views, cells, tiles.tile_index(cells, GRID), GRID, keep=keep)
    got = trace.trace(views, cells.filter("false"), index, GRID, keep=keep)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.filter("distance is not null").count() > 50
    # of the index and of all rays; that of cells is gone
    assert first_plan(got).count("Join") == 2 < first_plan(want).count("Join")
    assert 0 < longest_method(got) < 8000
    shadows = rays.angular_rays(views)
    keyed = lambda df: sorted(map(tuple, df.select("view_id", "px", "py", "t0", "t1", *keep, "zmax").collect()))
    assert keyed(trace.crossed_cells(shadows, cells, index, GRID)) == keyed(trace.crossed_cells(shadows, cells, tiles.tile_index(cells, GRID), GRID))


def test_nearest_hits_are_not_sorted(looking, ground):
    """The minimum of a struct made Spark sort every tested cell of every ray."""
    text = first_plan(trace.trace(looking, ground, tiles.tile_index(ground, GRID), GRID))
    nearest = [line for line in text.split("\n") if "min_by" in line]
    assert nearest and all("HashAggregate" in line for line in nearest if "Aggregate" in line)


def test_tiles_are_asked_once_for_their_patches(ground):
    """the filter on a patch's residual went below distinct(), to each of a tile's cells."""
    place_of = lambda r, c: lambda col, row: F.struct((col * 3 + c * 9).alias("x"), (row * 2 + r * 9).alias("y"))
    found = catalogue.tile_patches(ground.select("trow", "tcol").distinct(), 16, place_of)
    assert "LocalTableScan" not in plan(found) and "Scan ExistingRDD" not in plan(found)
    assert [(r.trow, r.tcol, r.size) for r in found.collect()] == [(0, 0, 16.0)]

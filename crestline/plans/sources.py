"""Queries of sources and sinks (S): tables go out as files and come back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rays
from ..sources import gazetteer, rasters, srtm
from ..sources import tiles as store
from ..storage import scratch_path, written
from . import terrain, tracing
from .registry import query, r3, r3_sql, table
from .terrain import CELLS_SQL, MOSAIC_SQL


@query("s1_discover_sources", "SELECT '.txt' AS kind, count(*) AS count FROM (SELECT s_suppkey FROM supplier UNION SELECT l_suppkey FROM lineitem) HAVING count(*) > 0")
def discover_sources(spark, sf):
    """A grid of each supplier's samples, one below the other, as files in folders; the output folder is left out."""
    path = scratch_path(spark, "rasters")
    values = terrain.samples(spark, sf).select(F.col("source_id").alias("k"), F.when(F.col("mask") != 0, F.format_string("%.2f", F.col("value").cast("double"))).otherwise("-9999").alias("value"))
    sizes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0).alias("n")).unionByName(values.select("k", F.lit(1).alias("n"))).groupBy("k").agg(F.sum("n").alias("n"))
    heads = sizes.select("k", F.format_string("ncols 1\nnrows %d\nxllcorner 2600000\nyllcorner 1200000\ncellsize 10\nNODATA_value -9999", "n").alias("value"))
    rows = heads.withColumn("part", F.lit(0)).unionByName(values.withColumn("part", F.lit(1)))
    rows.repartition("k").sortWithinPartitions("k", "part").drop("part").write.partitionBy("k").text(f"{path}/in")
    heads.select("value").write.text(f"{path}/out")
    return rasters.discover_sources(spark, path, f"{path}/out", suffixes=(".txt",)).select("kind").groupBy("kind").count()


@query("s2_read_hgt", f"""WITH {MOSAIC_SQL} SELECT (46 - row // 400)::INT AS lat, (7 + col // 400)::INT AS lon, row % 400 * 3 AS row, col % 400 * 3 AS col, round(z)::DOUBLE AS value FROM m""")
def read_hgt(spark, sf):
    """The mosaic's vertices as SRTM grids, every third sample of a row and every third row, and back."""
    row, col = F.col("row"), F.col("col")
    path = scratch_path(spark, "srtm")
    spots = terrain.mosaic(spark, sf).select((46 - F.floor(row / 400)).cast("int").alias("lat"), (7 + F.floor(col / 400)).cast("int").alias("lon"), (row % 400 * 3).alias("row"), (col % 400 * 3).alias("col"), F.round("z").alias("value"))
    srtm.write_hgt(spots, path)
    return srtm.read_srtm(spark, path, voids=False).select("lat", "lon", "row", "col", "value")


@query("s3_read_asc", f"""WITH {MOSAIC_SQL} SELECT (row // 32)::BIGINT AS strip, col, (row % 32)::BIGINT AS row, floor(z * 100 + 0.37) / 100 AS value FROM m""")
def read_asc(spark, sf):
    """The mosaic as ASCII grids of 32 rows each, and back."""
    n = terrain.side(spark, sf)
    every = spark.range(n * n).select((F.col("id") % n).alias("col"), F.floor(F.col("id") / n).alias("row")).join(terrain.mosaic(spark, sf), ["col", "row"], "left")
    value = F.when(F.col("z").isNull(), "-9999").otherwise(F.format_string("%.2f", F.floor(F.col("z") * 100 + 0.37) / 100))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))), lambda s: s["v"]), " ")
    lines = every.groupBy("row").agg(line.alias("line"))
    strips = lines.groupBy(F.floor(F.col("row") / 32).alias("strip")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("body"))
    head = f"ncols {n}\nnrows 32\nxllcorner 2600000\nyllcorner 1200000\ncellsize 10\nNODATA_value -9999\n"
    filled = strips.filter(F.col("body").rlike("[.]")).withColumn("text", F.concat(F.lit(head), F.col("body")))
    path = scratch_path(spark, "asc")
    filled.select(F.col("text").alias("value"), "strip").repartition("strip").write.partitionBy("strip").text(path)
    found = rasters.read_asc(spark, path, "*.txt")
    return found.filter("value <> no_data").select(F.col("strip").cast("long").alias("strip"), "col", "row", "value")


@query("s4_epsg_from_gml", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 2056 ELSE 27700 END AS epsg FROM supplier")
def epsg_from_gml(spark, sf):
    number = F.when(F.col("s_suppkey") % 2 == 0, "2056").otherwise("27700")
    text = F.concat(F.lit('<a srsName="urn:ogc:def:crs:EPSG::'), number, F.lit('"/><b srsName="urn:ogc:def:crs:EPSG::'), number, F.lit('"/>'))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), rasters.epsg_from_gml(text).alias("epsg"))


@query("s5_read_dem_samples", f"""WITH {terrain.SAMPLES_SQL} SELECT source_id::VARCHAR AS source, count(*) AS n, {r3_sql('min(value)')} AS lo FROM s WHERE mask <> 0 GROUP BY 1""")
def read_dem_samples(spark, sf):
    path = scratch_path(spark, "samples")
    terrain.samples(spark, sf).select(F.col("source_id").cast("string").alias("source"), "col", "row", "value", "mask").write.parquet(path)
    return rasters.read_dem_samples(spark, path).filter("mask <> 0").groupBy("source").agg(F.count(F.lit(1)).alias("n"), r3(F.min("value")).alias("lo"))


@query("s6_read_peaks", "SELECT p_retailprice AS elevation, p_size::DOUBLE AS prominence, CASE p_partkey % 3 WHEN 0 THEN p_name || ', \"x\"' WHEN 1 THEN p_name || ' \"y' ELSE p_name END AS name, count(*) AS n FROM part GROUP BY ALL")
def read_peaks(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(', "x"'))).when(k % 3 == 1, F.concat("p_name", F.lit(' "y'))).otherwise(F.col("p_name"))
    path = scratch_path(spark, "peaks")
    gazetteer.write_peaks(table(spark, sf, "part").select((k % 90).cast("double").alias("lat"), (k % 180).cast("double").alias("lon"), F.col("p_retailprice").alias("elevation"),
                                                          F.col("p_size").cast("double").alias("prominence"), name.alias("name")), path)
    found = gazetteer.read_peaks(spark, path)
    # as many ids as rows, from 0 on
    return found.groupBy("elevation", "prominence", "name").agg(F.count_distinct("peak_id").alias("n"))


@query("s7_read_manifest", f"""WITH {CELLS_SQL} SELECT trow, tcol, {r3_sql('min(z)')} AS zmin, {r3_sql('max(z)')} AS zmax FROM v SEMI JOIN c USING (trow, tcol) GROUP BY 1, 2""")
def read_manifest(spark, sf):
    path = scratch_path(spark, "tiles")
    store.write_tiles(written(terrain.vertices(spark, sf).withColumn("lod", F.lit(1)), "vertices"), path)
    eps = 4 * 2.0**-23
    # the bounds are widened by rounding's worst case; undone here
    return store.read_manifest(spark, path).select("trow", "tcol", r3(F.col("zmin") + F.col("zmax") * eps / (1 + eps)).alias("zmin"), r3(F.col("zmax") / (1 + eps)).alias("zmax"))


@query("s8_write_tiles", f"""WITH {CELLS_SQL}, k AS (SELECT DISTINCT trow, tcol FROM c), n AS (SELECT count(*) AS n FROM k)
SELECT 1 AS run, least(n, 3) AS written, 0 AS skipped FROM n UNION ALL SELECT 2, n - least(n, 3), least(n, 3) FROM n UNION ALL SELECT 3, 0, least(n, 5) FROM n""")
def write_tiles(spark, sf):
    """Three tiles, then the rest, then five that are there already."""
    path = scratch_path(spark, "tiles")
    # stored, as a write reads its vertices several times
    vertices = written(terrain.vertices(spark, sf).withColumn("lod", F.lit(1)), "vertices")
    done = [store.write_tiles(vertices, path, max_tiles=limit).withColumn("run", F.lit(run)) for run, limit in ((1, 3), (2, None), (3, 5))]
    return done[0].unionByName(done[1]).unionByName(done[2]).select("run", "written", "skipped")


@query("s8_overwrite_tiles", f"""WITH {CELLS_SQL}, has AS (SELECT DISTINCT trow, tcol FROM c),
nv AS (SELECT trow, tcol, CASE WHEN (trow + tcol) % 2 = 0 THEN z + 500 ELSE z END AS z FROM v SEMI JOIN has USING (trow, tcol) WHERE trow % 3 <> 2)
SELECT trow, tcol, count(*) AS n_vertices, {r3_sql('min(z)')} AS zmin, {r3_sql('max(z)')} AS zmax FROM nv GROUP BY 1, 2""")
def overwrite_tiles(spark, sf):
    """All tiles stored; then every other one raised by 500 m and the rows 2, 5, 8, ... removed, by one overwrite. Heights from the tiles, checked against the manifest."""
    path = scratch_path(spark, "tiles")
    vertices = written(terrain.vertices(spark, sf).select("trow", "tcol", "y", "x", "z").withColumn("lod", F.lit(1)), "vertices")
    store.write_tiles(vertices, path)
    bare = F.col("trow") % 3 == 2
    changed = vertices.filter(bare | ((F.col("trow") + F.col("tcol")) % 2 == 0)).withColumn("z", F.when(~bare, F.col("z") + 500))
    store.write_tiles(changed, path, overwrite=True)
    heights = store.read_tiles(spark, path).groupBy("trow", "tcol").agg(F.count("z").alias("n_vertices"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    # a tile without its bounds, or with those of another height, is not in the result
    bounds = store.read_manifest(spark, path).select("trow", "tcol", "zmin", "zmax")
    fine = heights.join(bounds, ["trow", "tcol"]).filter("zmin <= lo and hi <= zmax and zmax - hi < 0.01 and lo - zmin < 0.01")
    return fine.select("trow", "tcol", "n_vertices", r3(F.col("lo")).alias("zmin"), r3(F.col("hi")).alias("zmax"))


@query("s9_write_products", f"WITH {tracing.GRAD_SQL} SELECT view_id, count(*) AS n_hits, {r3_sql('min(distance)')} AS nearest, {r3_sql('max(elevation)')} AS highest FROM gg GROUP BY 1")
def write_products(spark, sf):
    """All products of the traced views but images, and back: one row a view from five tables."""
    hits, _, _ = tracing.hits_with_gradients(spark, sf)
    path = scratch_path(spark, "products")
    chosen = list(store.DIAGNOSTICS)
    store.write_products(hits, path, chosen)
    back = spark.read.parquet(f"{path}/{chosen[0]}")
    for p in chosen[1:]:
        # counts of steps take 1.5 bytes a row in sorted files, by whose size Spark would broadcast them
        back = rays.widened(back).join(spark.read.parquet(f"{path}/{p}"), ["view_id", "px", "py"])
    return back.filter("n_steps >= 1 and n_cells >= 1 and grad_e is not null").groupBy("view_id").agg(
        F.count(F.lit(1)).alias("n_hits"), r3(F.min("distance")).alias("nearest"), r3(F.max("elevation")).alias("highest"))

"""Prepared tiles: Parquet by generation and block of tiles, with a manifest that is the data-skipping index.

A write stores its tiles under a new generation, then a manifest that says for each
tile in which generation it lies, then one row in commits that names both. Readers go
by the last commit, so they see the tiles and bounds of before or of after, never some
of each: what a stopped write has left is named by no commit. Writers that commit at
once are told apart: one of them fails. Generations that no manifest names any more
stay on disk until someone removes them.

Cells that traces read are stored likewise by folders of BLOCK x BLOCK tiles, with their
index (write_cells()).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import BLOCK_KEY, KEY, Grid, build_manifest, coverage_rects, elevation_range, in_blocks, tile_index, usable_cells
from ..storage import written

TILES = "trow long, tcol long, y int, x int, z double, lod int, gen string, brow int, bcol int"
RECTS = "array<struct<column: int, row: int, width: int, height: int>>"
MANIFEST = f"trow long, tcol long, zmin double, zmax double, coverage {RECTS}, gen string"
COMMITS = "seq long, gen string"
CELLS = "trow long, tcol long, y int, x int, z00 double, z01 double, z10 double, z11 double, zmax double, brow int, bcol int"


def _last_commit(spark: SparkSession, path: str):
    """The row (seq, gen) of the last commit, None before the first."""
    try:
        commits = spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return commits.orderBy(F.desc("seq"), "gen").first()


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows (trow, tcol, zmin, zmax, coverage, gen) of the last commit's manifest, None before the first."""
    last = _last_commit(spark, path)
    return None if last is None else spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{last.gen}")


def _commit(listed: DataFrame, path: str, gen: str, seq: int) -> None:
    """Store a manifest and, by one row in one file, make it the current one."""
    spark = listed.sparkSession
    listed.select(*[f.split()[0] for f in MANIFEST.split(", ")[:4]], "coverage", "gen").sortWithinPartitions(*KEY).write.parquet(f"{path}/manifest/{gen}")
    spark.createDataFrame([(seq, gen)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    if _last_commit(spark, path).gen != gen:
        raise RuntimeError("another write was committed meanwhile; this one doesn't count")


def _read(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """Vertices of manifest rows, each from its own generation; other folders aren't read."""
    keys = in_blocks(listed.select(*KEY, "gen"))
    stored = spark.read.schema(TILES).parquet(f"{path}/tiles")
    return stored.join(keys, [*KEY, "gen", *BLOCK_KEY], "left_semi").select(*KEY, "y", "x", "z", "lod")


def read_tiles(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Vertices (trow, tcol, y, x, z, lod) of the tiles that the manifest lists; with keys (trow, tcol) of those alone, whose folders alone are read."""
    listed = _manifest(spark, path)
    return _read(spark, path, listed if keys is None else listed.join(keys.select(*KEY).distinct(), KEY, "left_semi"))


def _rescanned(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """Manifest rows, those that lack a bound or coverage made anew from their tiles, which alone are read."""
    lacking = "zmin is null or zmax is null or coverage is null"
    vertices = _read(spark, path, listed.filter(lacking))
    made = elevation_range(vertices).withColumnsRenamed({"zmin": "made_min", "zmax": "made_max"}).join(_coverage(vertices.filter("lod = 1")).withColumnRenamed("coverage", "made"), KEY, "left")
    return listed.join(made, KEY, "left").select(
        *KEY, F.coalesce("zmin", "made_min").alias("zmin"), F.coalesce("zmax", "made_max").alias("zmax"), F.coalesce("coverage", "made").alias("coverage"), "gen")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(trow, tcol, zmin, zmax, coverage), unique keys; what is missing is made from the tile."""
    rows = _manifest(spark, path)
    counted = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("zmin", "zmax", "coverage", "gen")])
    unique = counted.withColumn("gen", F.when(F.col("n") > 1, F.raise_error(F.lit("a tile is listed twice")).cast("string")).otherwise(F.col("gen"))).drop("n")
    return _rescanned(spark, path, unique).drop("gen")


def _coverage(vertices: DataFrame) -> DataFrame:
    rects = F.array_sort(F.collect_list(F.struct("column", "row", "width", "height"))).cast(RECTS)
    return coverage_rects(usable_cells(vertices)).groupBy(*KEY).agg(rects.alias("coverage"))


def _before(edge) -> Column:
    return (F.col("trow") < edge.trow) | ((F.col("trow") == edge.trow) & (F.col("tcol") < edge.tcol))


def write_tiles(vertices: DataFrame, path: str, overwrite: bool = False, max_tiles: int | None = None) -> DataFrame:
    """Store tiles and list them in the manifest; returns one row of counts: written, skipped, partial, empty.

    Tiles are taken by their key. One that is stored is skipped, unless overwrite: then
    it is replaced, or removed if it has no usable cell any more. Tiles without a
    usable cell are empty and not stored; partial ones lack some. The run stops before
    more than max_tiles are written or skipped. Other stored tiles stay as they are; the
    manifest rows of those that lack bounds are completed. A write that stops on its
    way changes nothing.
    """
    spark = vertices.sparkSession
    base = vertices.filter("lod = 1")
    side = base.agg(F.max("x")).first()[0] or 0
    last, old = _last_commit(spark, path), _manifest(spark, path)
    old = spark.createDataFrame([], MANIFEST) if old is None else old
    usable = usable_cells(base).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    keys = vertices.select(*KEY).distinct().join(usable, KEY, "left").join(old.select(*KEY).withColumn("stored", F.lit(True)), KEY, "left")
    has, n = F.coalesce("stored", F.lit(False)), F.coalesce("n", F.lit(0))
    what = F.when(has & F.lit(not overwrite), "skipped").when(n == 0, "empty").otherwise("written")
    plan = written(keys.select(*KEY, what.alias("what"), (n < side * side).alias("part"), has.alias("stored")), "tile-plan")
    if max_tiles is not None:
        edge = plan.filter("what <> 'empty'").orderBy(*KEY).offset(max_tiles).limit(1).first()
        plan = plan.filter(_before(edge)) if edge is not None else plan
    todo = plan.filter("what = 'written'").select(*KEY)
    gone = plan.filter("what = 'empty' and stored").select(*KEY) if overwrite else todo.limit(0)
    gen = f"g-{uuid.uuid4().hex}"
    chosen = vertices.join(todo, KEY, "left_semi").select(*KEY, "y", "x", "z", "lod")
    (in_blocks(chosen).repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "lod", *KEY).write.partitionBy(*BLOCK_KEY).parquet(f"{path}/tiles/gen={gen}"))
    # from what is stored now, so that bounds are those of the tiles that will be read
    stored = spark.read.schema(TILES).parquet(f"{path}/tiles").filter(F.col("gen") == gen)
    own = _coverage(stored.filter("lod = 1")).withColumn("own_gen", F.lit(gen))
    merged = build_manifest(elevation_range(stored), old.join(gone, KEY, "left_anti"))
    both = merged.join(own.withColumnRenamed("coverage", "own"), KEY, "left").join(old.select(*KEY, "coverage", "gen"), KEY, "left")
    new = F.col("own_gen").isNotNull()
    listed = both.select(*KEY, "zmin", "zmax", F.when(new, F.col("own")).otherwise(F.col("coverage")).alias("coverage"), F.coalesce("own_gen", "gen").alias("gen"))
    _commit(_rescanned(spark, path, written(listed, "manifest-new")), path, gen, 1 if last is None else last.seq + 1)
    return plan.agg(F.count_if(F.col("what") == "written").alias("written"), F.count_if(F.col("what") == "skipped").alias("skipped"),
                    F.count_if((F.col("what") == "written") & F.col("part")).alias("partial"), F.count_if(F.col("what") == "empty").alias("empty"))


def write_cells(cells: DataFrame, path: str, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Cells by folders of tiles and their index by tile (operators.tiles.tile_index()), stored for traces and read back.

    Cells that bring their folders' numbers (brow, bcol) are taken to lie by them and are not shuffled; where they don't, a folder has more files.
    """
    spark = cells.sparkSession
    names = [f.split()[0] for f in CELLS.split(", ")]
    lying = cells.select(*names) if set(BLOCK_KEY) <= set(cells.columns) else in_blocks(cells).select(*names).repartition(*BLOCK_KEY)
    lying.sortWithinPartitions(*BLOCK_KEY, *KEY, "y", "x").write.partitionBy(*BLOCK_KEY).parquet(f"{path}/cells")
    stored = spark.read.schema(CELLS).parquet(f"{path}/cells")
    tile_index(stored, grid).write.parquet(f"{path}/index")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, index) of write_cells(). Traces read the folders of the cells that they can meet alone."""
    return spark.read.schema(CELLS).parquet(f"{path}/cells"), spark.read.parquet(f"{path}/index")


#: The columns of each product beside the pixel's.
PRODUCTS = {"distances": ["distance"], "elevations": ["elevation"], "normals": ["grad_e", "grad_n"], "steps": ["n_steps"], "evaluations": ["n_cells"], "synthetic": ["grey"]}
DIAGNOSTICS = ("distances", "elevations", "normals", "steps", "evaluations")


def check_products(products: list[str], columns: list[str], colour: str = "white", colour_range: tuple[float, float] | None = None) -> None:
    """S9's rules: ValueError for a choice of products that hits of those columns, or the ways to colour them, don't allow."""
    if not products:
        raise ValueError("no product is chosen")
    for p in products:
        if p not in PRODUCTS:
            raise ValueError(f"{p} is no product")
        missing = set(PRODUCTS[p]) - set(columns)
        if missing:
            raise ValueError(f"{p} needs {', '.join(sorted(missing))}")
    if colour not in ("white", "distance", "elevation"):
        raise ValueError(f"{colour} is no terrain colour")
    if "synthetic" not in products and colour != "white":
        raise ValueError("a terrain colour needs the synthetic product")
    if "synthetic" in products:
        if not {"grad_e", "grad_n"} <= set(columns):
            raise ValueError("synthetic needs normals")
        if colour == "elevation" and "elevation" not in columns:
            raise ValueError("elevation colour needs elevations")
    if colour_range is not None:
        low, high = colour_range
        if not (math.isfinite(low) and math.isfinite(high) and low < high):
            raise ValueError("the colour range's end must lie above its begin")
        if colour == "white" and not set(products) & set(DIAGNOSTICS):
            raise ValueError("a colour range needs diagnostics or a coloured terrain")


def write_products(hits: DataFrame, path: str, products: list[str], colour: str = "white", colour_range: tuple[float, float] | None = None) -> None:
    """Chosen products of hits, one table each, sorted by view: distances, elevations, normals, steps, evaluations, synthetic.

    Only the columns of what is asked are read. Views lie together, and Parquet's bounds
    by row group find them; a folder a view would be as many files as views.
    """
    check_products(products, hits.columns, colour, colour_range)
    for p in products:
        hits.select("view_id", "px", "py", *PRODUCTS[p]).repartitionByRange("view_id", "py", "px").sortWithinPartitions("view_id", "py", "px").write.parquet(f"{path}/{p}")

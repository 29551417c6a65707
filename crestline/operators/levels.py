"""Ray casting over levels of detail: each view sees each tile at the coarsest level that its pixels still cover.

The level is chosen in the row of a tile segment, so a trace reads the cells of the
chosen levels alone: a tile at level k has a 4^(k-1)th of the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import native_if_partial
from .rays import select_lod, widened
from .stacked import hits_or_steps
from .tiles import KEY, Grid, lod_pyramid, tile_distance, usable_cells
from .trace import OVER, descent, in_sight, nearest, on_cells, paths_of, stop_rising, tile_path

LEVEL_KEY = ["lod", *KEY]


def level_cells(vertices: DataFrame, grid: Grid, levels: int, method: str = "mean") -> DataFrame:
    """T4, T5: the cells of all levels (lod, trow, tcol, y, x, z00..z11, zmax); those of level k have 2^(k-1) times the side."""
    return usable_cells(lod_pyramid(vertices, grid.cells, levels, method), LEVEL_KEY)


def level_index(cells: DataFrame, grid: Grid) -> DataFrame:
    """Of each tile at each level: its highest ground and its number of cells."""
    return cells.groupBy(*LEVEL_KEY).agg(F.max("zmax").alias("zmax"), F.count(F.lit(1)).alias("n"))


def choose_levels(segments: DataFrame, index: DataFrame, grid: Grid, levels: int, scale: float) -> DataFrame:
    """Segments of views (x, y, footprint) in tiles with lod; a tile with a void keeps its own cells, one without ground goes."""
    native = index.filter("lod = 1").select(*KEY, F.col("n").alias("_n"))
    lod = select_lod(tile_distance(F.col("x"), F.col("y"), F.col("trow"), F.col("tcol"), grid), F.col("footprint"), F.lit(grid.cell), levels, scale)
    return widened(segments).join(native, KEY).withColumn("lod", native_if_partial(F.col("_n"), grid.cells, lod)).drop("_n")


def trace_levels(views: DataFrame, cells: DataFrame, index: DataFrame, grid: Grid, levels: int, scale: float) -> DataFrame:
    """R1-R13 at mixed levels: trace()'s columns and lod, that of the hit cell (cy and cx count its cells).

    views: as trace()'s, with footprint, the angle of a pixel (R5). cells, index: of
    level_cells() and level_index(). scale 0 is level 1 everywhere. Where tiles of
    different levels meet, the ground can have a step, and that counts as ground.
    """
    paths = stop_rising(paths_of(views), index, F.col("low_slope"))
    chosen = choose_levels(tile_path(paths, grid), index, grid, levels, scale)
    found = widened(chosen).join(index.select(*LEVEL_KEY, F.col("zmax").alias("tile_max"), F.col("n").alias("_n")), LEVEL_KEY)
    spread = F.pow(F.lit(2.0), F.col("lod") - 1)
    found = found.withColumns({"cell": grid.cell * spread, "tile_full": F.col("_n") == F.pow(F.lit(grid.cells) / spread, F.lit(2))}).drop("_n")
    own = Grid(grid.origin_x, grid.origin_y, F.col("cell"), F.lit(grid.width) / F.col("cell"))  # each segment has its level's cells
    cut = descent(found, own, F.col("low_slope"), [], voids=True)
    pieces = cut.withColumn("over", F.col("what") == OVER).drop("what")
    met = on_cells(pieces, cells, own, keep_over=True, more=("lod",))
    return nearest(views, hits_or_steps(in_sight(met, own), own), own, ("lod",))

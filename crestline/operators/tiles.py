"""Tile preparation: samples -> mosaic -> tiles with shared edges -> LODs, cells, coverage, codes, manifest.

Vertices of a tile are counted from its south-west corner (x east, y north); raster
rows run south. Every step is one shuffle on the tile or vertex key at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = ["dataset_id", "lod", "trow", "tcol"]
KEY = ["trow", "tcol"]
#: Tiles along the side of a folder of stored tiles, and the folder's numbers.
BLOCK = 8
BLOCK_KEY = ["brow", "bcol"]
SRTM_FLOOR = -2000.0
MAX_RELIEF_DM = 65534


@dataclass(frozen=True)
class Grid:
    """Destination grid: north-west origin, cell size in metres, cells along a tile's side."""

    origin_x: float
    origin_y: float
    cell: float
    cells: int

    @property
    def width(self) -> float:
        return self.cell * self.cells


def valid_sample(value: Column, no_data: Column, mask: Column) -> Column:
    """V2: finite, not the no-data value (compared as float32; NaN means NaN) and not masked out."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    differs = no_data.isNull() | F.isnan(no_data) | (value.cast("float") != no_data.cast("float"))
    return F.coalesce(finite & differs & (F.coalesce(mask, F.lit(1)) != 0), F.lit(False))


def above_floor(value: Column, is_srtm: Column, floor: float = SRTM_FLOOR) -> Column:
    """V3: SRTM samples below the floor are void; other sources are left alone."""
    return ~is_srtm | (value >= floor)


def scale_offset(value: Column, scale: Column, offset: Column) -> Column:
    """Value * scale + offset; an error where the result is no finite number."""
    z = value * F.coalesce(scale, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))
    return F.when(F.isnan(z) | (F.abs(z) == float("inf")), F.raise_error(F.lit("elevation can't be represented")).cast("double")).otherwise(z)


def mosaic(samples: DataFrame, rank: list[str], keys: list[str] | None = None) -> DataFrame:
    """Of several valid samples at one (col, row), or what else names a vertex, the first by rank wins."""
    return samples.groupBy(*(keys or ["col", "row"])).agg(F.min_by("z", F.struct(*rank)).alias("z"))


def floor_div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def assign_tiles(samples: DataFrame, cells: int) -> DataFrame:
    """Each sample to the 1, 2 or 4 tiles whose (cells + 1)^2 window holds it; adds trow, tcol, x, y."""
    c, r = floor_div(F.col("col"), cells), floor_div(F.col("row"), cells)
    cols = F.when(F.pmod("col", F.lit(cells)) == 0, F.array(c - 1, c)).otherwise(F.array(c))
    rows = F.when(F.pmod("row", F.lit(cells)) == 0, F.array(r - 1, r)).otherwise(F.array(r))
    placed = samples.withColumn("tcol", F.explode(cols)).withColumn("trow", F.explode(rows))
    return placed.withColumns({
        "x": (F.col("col") - F.col("tcol") * cells).cast("int"),
        "y": (cells - (F.col("row") - F.col("trow") * cells)).cast("int")})


def lod_step(fine: DataFrame, cells: int, method: str = "mean", keys: list[str] | None = None) -> DataFrame:
    """T4, one level: (keys, y, x, z) with `cells` cells a side -> half as many.

    point takes every other vertex. mean (weights 1-2-1) and max take the 3x3 around
    it, and need all nine; vertices on a tile's edge are always taken as they are, so
    that neighbours agree.
    """
    keys = keys or KEY
    even = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)
    half = {"x": (F.col("x") / 2).cast("int"), "y": (F.col("y") / 2).cast("int")}
    if method == "point":
        return fine.filter(even).withColumns(half)
    if method not in ("mean", "max"):
        raise ValueError(f"unknown method {method}")
    edge = F.col("x").isin(0, cells) | F.col("y").isin(0, cells)
    edges = fine.filter(even & edge).withColumns(half)

    def centres(v: str) -> Column:
        # even coordinates feed themselves, odd ones the two beside them; centres on the edge are not wanted
        both = F.when(F.col(v) % 2 == 0, F.array(F.struct(F.col(v).alias("at"), F.lit(2).alias("w")))).otherwise(
            F.array(F.struct((F.col(v) - 1).alias("at"), F.lit(1).alias("w")), F.struct((F.col(v) + 1).alias("at"), F.lit(1).alias("w"))))
        return F.filter(both, lambda s: (s["at"] > 0) & (s["at"] < cells))

    fed = fine.filter("z is not null").withColumn("cx", F.explode(centres("x"))).withColumn("cy", F.explode(centres("y")))
    weight = F.col("cx.w") * F.col("cy.w")
    value = F.sum(F.col("z") * weight) / F.sum(weight) if method == "mean" else F.max("z")
    inner = fed.groupBy(*keys, (F.col("cy.at") / 2).cast("int").alias("y"), (F.col("cx.at") / 2).cast("int").alias("x")).agg(
        value.alias("z"), F.count(F.lit(1)).alias("n")).filter("n = 9")
    return edges.select(*keys, "y", "x", "z").unionByName(inner.select(*keys, "y", "x", "z"))


def lod_pyramid(vertices: DataFrame, cells: int, levels: int, method: str = "mean") -> DataFrame:
    """T4: (trow, tcol, y, x, z) -> the same with lod from 1 to levels. A loop of log2(cells) steps at most."""
    level = vertices.select(*KEY, "y", "x", "z")
    found = level.withColumn("lod", F.lit(1))
    for lod in range(2, levels + 1):
        level = lod_step(level, cells >> (lod - 2), method)
        found = found.unionByName(level.withColumn("lod", F.lit(lod)))
    return found


def usable_cells(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """T5: a row for each cell with four valid corners, named by its south-west one: z00, z01 (east), z10 (north), z11.

    Each vertex goes to the up to four cells it is a corner of; one shuffle on the tile
    and cell, summed up before it.
    """
    keys = keys or KEY
    corners = F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(2 * dy + dx).alias("k"))
                                  for dy in (0, 1) for dx in (0, 1)]))
    fed = vertices.filter("z is not null").select(*keys, "z", corners.alias("c"))
    wide = fed.groupBy(*keys, F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(
        *[F.max(F.when(F.col("c.k") == k, F.col("z"))).alias(name) for k, name in enumerate(("z00", "z01", "z10", "z11"))])
    return wide.dropna(subset=["z00", "z01", "z10", "z11"]).withColumn("zmax", F.greatest("z00", "z01", "z10", "z11"))


def coverage_rects(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of usable cells in a row, merged with equal runs in the rows above: (column, row, width, height)."""
    keys = keys or KEY
    in_row = Window.partitionBy(*keys, "y").orderBy("x")
    runs = cells.select(*keys, "y", "x", (F.col("x") - F.row_number().over(in_row)).alias("run")).groupBy(*keys, "y", "run").agg(
        F.min("x").alias("column"), F.max("x").alias("to"))
    upward = Window.partitionBy(*keys, "column", "to").orderBy("y")
    stacked = runs.withColumn("stack", F.col("y") - F.row_number().over(upward))
    return stacked.groupBy(*keys, "column", "to", "stack").agg(F.min("y").alias("row"), F.count(F.lit(1)).alias("height")).select(
        *keys, "column", "row", (F.col("to") - F.col("column") + 1).alias("width"), F.col("height").cast("int").alias("height"))


def covers(points: DataFrame, rects: DataFrame) -> DataFrame:
    """Points (trow, tcol, px, py in cells from the south-west) inside a rectangle, half open; adds covered."""
    rows = rects.groupBy(*KEY).agg(F.collect_list(F.struct("column", "row", "width", "height")).alias("rects"))
    hit = F.exists("rects", lambda r: (F.col("px") >= r["column"]) & (F.col("px") < r["column"] + r["width"]) & (F.col("py") >= r["row"]) & (F.col("py") < r["row"] + r["height"]))
    return points.join(rows, KEY, "left").withColumn("covered", F.coalesce(hit, F.lit(False))).drop("rects")


def overlap_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area that a rectangle row (column, row, width, height) shares with a box."""
    w = F.least(x1, F.col("column") + F.col("width")) - F.greatest(x0, F.col("column"))
    h = F.least(y1, F.col("row") + F.col("height")) - F.greatest(y0, F.col("row"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def decimetres(z: Column) -> Column:
    """Half away from zero, as round() of a double does."""
    return F.round(z * 10).cast("long")


def quantize(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Codes above a base for each tile and LOD; 0 is void. Relief over 6553.4 m is an error."""
    keys = keys or KEY
    low = Window.partitionBy(*keys)
    dm = vertices.withColumn("dm", decimetres(F.col("z")))
    based = dm.withColumns({"base_dm": F.min("dm").over(low) - 1, "top": F.max("dm").over(low)})
    code = F.when(F.col("top") - F.col("base_dm") - 1 > MAX_RELIEF_DM, F.raise_error(F.lit("relief is over 6553.4 m")).cast("long")).when(
        F.col("dm").isNull(), F.lit(0)).otherwise(F.col("dm") - F.col("base_dm"))
    return based.select(*keys, "y", "x", "base_dm", code.cast("int").alias("code"))


def dequantize(base_dm: Column, code: Column) -> Column:
    """(base + code) / 10 metres; code 0 is NULL."""
    return F.when(code != 0, (base_dm + code) / 10.0)


def elevation_range(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lowest and highest vertex of a tile over all LODs, widened by four float32 epsilons."""
    keys = keys or KEY
    eps = 4 * 2.0**-23
    found = vertices.groupBy(*keys).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    wide = eps * F.greatest(F.lit(1.0), F.abs("lo"), F.abs("hi"))
    return found.select(*keys, (F.col("lo") - wide).alias("zmin"), (F.col("hi") + wide).alias("zmax"))


def build_manifest(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows win, old ones are kept where complete; rescan marks keys whose old row lacks a bound."""
    o = old.select(*KEY, F.col("zmin").alias("old_min"), F.col("zmax").alias("old_max"))
    both = new.join(o, KEY, "full_outer")
    return both.select(
        *KEY, F.coalesce("zmin", "old_min").alias("zmin"), F.coalesce("zmax", "old_max").alias("zmax"),
        (F.coalesce("zmin", "old_min").isNull() | F.coalesce("zmax", "old_max").isNull()).alias("rescan"))


def max_pyramid(cells: DataFrame, levels: int, keys: list[str] | None = None) -> DataFrame:
    """(level, by, bx, zmax, n): level 1 has the highest corner of each cell, each next one of 2x2 blocks; n: usable cells.

    Each level is made from the one below, so what is shuffled falls by four.
    """
    keys = keys or KEY
    level = cells.select(*keys, F.col("y").alias("by"), F.col("x").alias("bx"), "zmax", F.lit(1).cast("long").alias("n"))
    found = level.withColumn("level", F.lit(1))
    for k in range(2, levels + 1):
        level = level.groupBy(*keys, F.floor(F.col("by") / 2).cast("int").alias("by"), F.floor(F.col("bx") / 2).cast("int").alias("bx")).agg(F.max("zmax").alias("zmax"), F.sum("n").alias("n"))
        found = found.unionByName(level.withColumn("level", F.lit(k)))
    return found


#: Cells along the side of the blocks that a trace asks before it asks cells, and T12's level that has them.
BLOCK_LEVELS = {64: 7, 8: 4}


def block_sizes(grid: Grid) -> list[int]:
    return [size for size in BLOCK_LEVELS if size < grid.cells]


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (trow, tcol, ...) with the numbers of the folder that their tile is stored in."""
    return rows.withColumns({b: F.floor(F.col(k) / BLOCK).cast("int") for b, k in zip(BLOCK_KEY, KEY, strict=True)})


#: A cell and the folder it lies in.
CELL = "trow long, tcol long, y int, x int, z00 double, z01 double, z10 double, z11 double, zmax double, brow int, bcol int"
#: Samples of a folder that are looked at together at most, beside the first of each of its vertices.
SAMPLES_AT_ONCE = 1 << 17


def folder_tiles(samples: DataFrame, rank: list[str], cells: int) -> DataFrame:
    """T1, T2, T5 and the index at once, of valid samples (col, row from 0, z): a row for each tile with a usable cell, tile_index()'s columns and heights.

    heights: the tile's vertices, row by row from the south-west, NULL where there is none. Of a vertex's samples the first by rank
    wins. A sample goes to the folder that it lies in, and on a folder's first row or column to the one before: one shuffle.
    A folder's vertices, whose number is fixed, are made into tiles as arrays; its samples, whose number is not, are gone through in pieces.
    """
    across = BLOCK * cells
    sizes = [size for size in BLOCK_LEVELS if size < cells]
    many = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    brow, bcol = (floor_div(F.col(c), across) for c in ("row", "col"))
    top, left = (F.col("row") % across == 0) & (F.col("row") > 0), (F.col("col") % across == 0) & (F.col("col") > 0)

    def folder(r: Column, c: Column) -> Column:
        return F.shiftleft(r, 32).bitwiseOR(c)

    own = folder(brow, bcol)
    mine = F.when(top & left, F.array(own, folder(brow - 1, bcol), folder(brow, bcol - 1), folder(brow - 1, bcol - 1))).when(
        top, F.array(own, folder(brow - 1, bcol))).when(left, F.array(own, folder(brow, bcol - 1))).otherwise(F.array(own))
    r, c = F.shiftright("_f", 32), F.col("_f").bitwiseAND((1 << 32) - 1)
    values = list(dict.fromkeys([*rank, "z"]))
    sent = samples.withColumn("_f", F.explode(mine)).select("_f", ((F.col("row") - r * across) * (across + 1) + F.col("col") - c * across).cast("int").alias("at"), *values)

    def firsts(rows: pa.Table) -> pa.Table:
        """Of the rows of each vertex (at) the first by rank, NULL before all else."""
        by = [rows["at"].to_numpy()]
        for name in rank:
            absent = rows[name].is_null().to_numpy()
            by += [~absent, rows[name].fill_null(0).to_numpy()] if absent.any() else [rows[name].to_numpy()]
        order = np.lexsort(by[::-1])
        return rows.take(order[np.flatnonzero(np.diff(by[0][order], prepend=-1))])

    def lists(values: pa.Array, rows: int) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(rows + 1, dtype="int32") * (len(values) // max(rows, 1)), values)

    def made(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won, waiting = [], []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= SAMPLES_AT_ONCE:
                won, waiting = firsts(pa.Table.from_batches([*won, *waiting])).to_batches(), []
        won = firsts(pa.Table.from_batches([*won, *waiting]))
        flat = np.full((across + 1) ** 2, np.nan)
        flat[won["at"].to_numpy()] = won["z"].to_numpy()
        # rows run south, a tile's y north
        h = np.lib.stride_tricks.sliding_window_view(flat.reshape(across + 1, across + 1), (cells + 1, cells + 1))[::cells, ::cells, ::-1]
        highest = np.maximum(np.maximum(h[..., :-1, :-1], h[..., :-1, 1:]), np.maximum(h[..., 1:, :-1], h[..., 1:, 1:]))
        usable = ~np.isnan(highest)
        highest = np.where(usable, highest, -np.inf)
        trow, tcol = np.nonzero(usable.any(axis=(2, 3)))
        h, highest, usable = h[trow, tcol], highest[trow, tcol], usable[trow, tcol]
        many = len(trow)
        found = {"trow": trow + (key[0].as_py() >> 32) * BLOCK, "tcol": tcol + (key[0].as_py() & ((1 << 32) - 1)) * BLOCK,
                 "zmax": highest.max(axis=(1, 2)), "full": usable.all(axis=(1, 2))}
        for size in sizes:
            side = -(-cells // size)
            edge = ((0, 0), (0, side * size - cells), (0, side * size - cells))
            blocks = (many, side, size, side, size)
            tops = np.pad(highest, edge, constant_values=-np.inf).reshape(blocks).max(axis=(2, 4)).ravel()
            whole = np.pad(usable, edge, constant_values=True).reshape(blocks).all(axis=(2, 4)).ravel()
            entries = pa.StructArray.from_arrays([pa.array(tops), pa.array(whole)], ["top", "full"], mask=pa.array(tops == -np.inf))
            found[f"b{size}"] = lists(entries, many)
        flat = h.ravel()
        found["heights"] = lists(pa.array(flat, mask=np.isnan(flat)), many)
        yield pa.RecordBatch.from_pydict(found)

    schema = ", ".join(["trow long, tcol long, zmax double, full boolean", *[f"b{size} array<struct<top: double, full: boolean>>" for size in sizes], "heights array<double>"])
    return sent.repartition(many, "_f").groupBy("_f").applyInArrow(made, schema)


def corners(heights: Column, y: Column, x: Column, cells: int) -> dict[str, Column]:
    """z00, z01, z10, z11 of a cell of a tile with heights as in folder_tiles()."""
    at = (y * (cells + 1) + x).cast("int")
    return {name: F.get(heights, at + more) for name, more in (("z00", 0), ("z01", 1), ("z10", cells + 1), ("z11", cells + 2))}


def cells_of(rows: DataFrame, cells: int) -> DataFrame:
    """The usable cells of folder_tiles()'s rows, CELL's columns; no shuffle."""
    each = rows.select(*KEY, "heights", F.explode(F.sequence(F.lit(0), F.lit(cells * cells - 1))).alias("_k"))
    placed = each.select(*KEY, "heights", F.floor(F.col("_k") / cells).cast("int").alias("y"), (F.col("_k") % cells).alias("x"))
    found = placed.select(*KEY, "y", "x", *[v.alias(c) for c, v in corners(F.col("heights"), F.col("y"), F.col("x"), cells).items()]).dropna()
    return in_blocks(found.withColumn("zmax", F.greatest("z00", "z01", "z10", "z11")))


def folder_cells(samples: DataFrame, rank: list[str], cells: int) -> DataFrame:
    """T1, T2 and T5 at once: the usable cells of valid samples, CELL's columns, a folder's lying together; see folder_tiles()."""
    return cells_of(folder_tiles(samples, rank, cells), cells)


def tile_index(cells: DataFrame, grid: Grid) -> DataFrame:
    """A row for each tile: zmax, full (no void) and, as in T12, arrays b64 and b8 of (top, full) of its blocks, row by row from the south-west.

    NULL is a block without a usable cell. A tile has (cells / 8)^2 entries at most, so the index is about a fiftieth of the cells.
    Cells are summed up once, by the finest blocks; what is coarser is made from those.
    """
    sizes = block_sizes(grid)
    finest = min(sizes, default=grid.cells)
    found, level = None, cells.groupBy(*KEY, F.floor(F.col("y") / finest).cast("int").alias("by"), F.floor(F.col("x") / finest).cast("int").alias("bx")).agg(
        F.max("zmax").alias("zmax"), F.count(F.lit(1)).alias("n"))
    for size in sorted(sizes):
        side = -(-grid.cells // size)
        if size > finest:
            ratio = size // finest
            own = level.groupBy(*KEY, F.floor(F.col("by") / ratio).cast("int").alias("by"), F.floor(F.col("bx") / ratio).cast("int").alias("bx")).agg(F.max("zmax").alias("zmax"), F.sum("n").alias("n"))
        else:
            own = level
        room = F.least(F.lit(size), grid.cells - F.col("by") * size) * F.least(F.lit(size), grid.cells - F.col("bx") * size)
        entry = F.struct((F.col("by") * side + F.col("bx")).alias("k"), F.struct(F.col("zmax").alias("top"), (F.col("n") == room).alias("full")).alias("v"))
        blocks = own.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.max("zmax").alias("zmax"), (F.sum("n") == grid.cells**2).alias("full"))
        every = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.try_element_at("m", k))
        rows = blocks.select(*KEY, "zmax", "full", every.alias(f"b{size}"))
        found = rows if found is None else found.join(rows.drop("zmax", "full"), KEY)
    return level.groupBy(*KEY).agg(F.max("zmax").alias("zmax"), (F.sum("n") == grid.cells**2).alias("full")) if found is None else found


def tile_key(x: Column, y: Column, grid: Grid) -> tuple[Column, Column]:
    """(trow, tcol) of a place."""
    return F.floor((grid.origin_y - y) / grid.width).cast("long"), F.floor((x - grid.origin_x) / grid.width).cast("long")


def infer_grid(corner_x: Column, corner_y: Column, trow: Column, tcol: Column, width: Column) -> tuple[Column, Column]:
    """The grid's origin from one tile's south-west corner, key and width."""
    return corner_x - tcol * width, corner_y + (trow + 1) * width


def tile_distance(x: Column, y: Column, trow: Column, tcol: Column, grid: Grid) -> Column:
    """From a place to the nearest point of a tile; 0 inside."""
    west, south = grid.origin_x + tcol * grid.width, grid.origin_y - (trow + 1) * grid.width
    dx = F.greatest(west - x, x - (west + grid.width), F.lit(0.0))
    dy = F.greatest(south - y, y - (south + grid.width), F.lit(0.0))
    return F.hypot(dx, dy)

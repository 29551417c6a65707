"""Dataset stacks: frames, range, ownership, location, patches.

Datasets are ordered by priority; the first whose usable cell holds a place owns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..storage import written
from .points import cell_of
from .rays import dealt, widened
from .tiles import Grid, tile_distance


def pick_frame(datasets: DataFrame) -> DataFrame:
    """Per view, the one projected dataset's system, else an azimuthal frame at the observer.

    datasets: view_id, epsg, projected (boolean).
    """
    kinds = datasets.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.first("epsg").alias("epsg"), F.bool_and("projected").alias("metres"))
    own = (F.col("n") == 1) & F.col("metres")
    return kinds.select("view_id", F.when(own, "crs").otherwise("aeqd").alias("kind"), F.when(own, F.col("epsg")).alias("epsg"))


def tiles_in_range(tiles: DataFrame, observers: DataFrame, grids: Grid | dict[int, Grid], max_distance: float, max_tiles: int) -> DataFrame:
    """The tiles each observer needs, nearest first: its own, then by distance, priority, key; max_tiles at most.

    grids: that of all tiles, or one for each priority of a stack. Observers go down a
    quadtree of keys: to blocks of 64 tiles a side that their circle touches and that
    have tiles, in those to blocks of 8, in those to tiles, always by an equal key. The
    observer's own tiles are kept at any distance.
    """
    near = None
    for priority, grid in (grids if isinstance(grids, dict) else {None: grids}).items():
        some = tiles if priority is None else tiles.filter(F.col("priority") == priority)
        here = observers.withColumns({"_r": F.floor((grid.origin_y - F.col("y")) / grid.width), "_c": F.floor((F.col("x") - grid.origin_x) / grid.width)})
        boxed = in_circles(here, some, grid, max_distance)
        d = tile_distance(F.col("x"), F.col("y"), F.col("trow"), F.col("tcol"), grid)
        met = widened(boxed).join(some, ["trow", "tcol"]).withColumns({"distance": d, "own": (F.col("trow") == F.col("_r")) & (F.col("tcol") == F.col("_c"))})
        one = met.filter(F.col("own") | (F.col("distance") <= max_distance))
        near = one if near is None else near.unionByName(one)
    order = Window.partitionBy("observer_id").orderBy(F.desc("own"), "distance", "priority", "trow", "tcol")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_tiles).select("observer_id", "rank", "priority", "trow", "tcol", "own", "distance")


#: Tiles along the side of the blocks that a circle is asked for first.
CIRCLE_BLOCKS = (64, 8)


def in_circles(observers: DataFrame, tiles: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Observers (x, y, _r, _c: their own tile) with the keys trow, tcol of tiles that their circle may touch; only where blocks of tiles are stored."""

    def touched(rows: DataFrame, size: int) -> DataFrame:
        """Rows whose block of that many tiles a side lies within the radius."""
        block = Grid(grid.origin_x, grid.origin_y, grid.cell * size, grid.cells)
        own = (F.col("_br") == F.floor(F.col("_r") / size)) & (F.col("_bc") == F.floor(F.col("_c") / size))
        return rows.filter(own | (tile_distance(F.col("x"), F.col("y"), F.col("_br"), F.col("_bc"), block) <= radius))

    first, wide = CIRCLE_BLOCKS[0], grid.width * CIRCLE_BLOCKS[0]
    spans = [F.sequence(F.floor((v - radius) / wide), F.floor((v + radius) / wide)) for v in (grid.origin_y - F.col("y"), F.col("x") - grid.origin_x)]
    found = touched(observers.withColumn("_br", F.explode(spans[0])).withColumn("_bc", F.explode(spans[1])), first)
    for size, finer in zip(CIRCLE_BLOCKS, (*CIRCLE_BLOCKS[1:], 1), strict=True):
        stored = tiles.select(F.floor(F.col("trow") / size).alias("_br"), F.floor(F.col("tcol") / size).alias("_bc")).distinct()
        step = size // finer
        inner = [F.sequence(F.col(c) * step, F.col(c) * step + step - 1) for c in ("_br", "_bc")]
        found = found.join(stored, ["_br", "_bc"], "left_semi").withColumns({"_rows": inner[0], "_cols": inner[1]})
        found = touched(found.withColumn("_br", F.explode("_rows")).withColumn("_bc", F.explode("_cols")).drop("_rows", "_cols"), finer)
    return found.withColumnsRenamed({"_br": "trow", "_bc": "tcol"})


def stack_fallback(candidates: DataFrame, coverage: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """C3 for stacks: where observers of tiles_in_range() without a tile of their own go: (observer_id, priority, trow, tcol, x, y).

    It is the middle of the first usable rectangle (coverage: priority, trow, tcol,
    column, row, width, height) of the first candidate by priority and key.
    """
    key = ["priority", "trow", "tcol"]
    lost = candidates.groupBy("observer_id").agg(F.min(F.struct(*key)).alias("t"), F.bool_or("own").alias("own")).filter("not own").select("observer_id", "t.*")
    first = coverage.groupBy(*key).agg(F.min_by(F.struct("column", "row", "width", "height"), F.struct("row", "column")).alias("r"))
    sides = F.create_map(*[c for p, g in grids.items() for c in (F.lit(p), F.struct(*[F.lit(float(v)).alias(k) for k, v in (("ox", g.origin_x), ("oy", g.origin_y), ("cell", g.cell), ("width", g.width))]))])
    met = lost.join(first, key).withColumn("_g", sides[F.col("priority")])
    x = F.col("_g.ox") + F.col("tcol") * F.col("_g.width") + (F.col("r.column") + F.col("r.width") / 2) * F.col("_g.cell")
    y = F.col("_g.oy") - (F.col("trow") + 1) * F.col("_g.width") + (F.col("r.row") + F.col("r.height") / 2) * F.col("_g.cell")
    return met.select("observer_id", *key, x.alias("x"), y.alias("y"))


def observer_fallback(tiles: DataFrame, grid: Grid) -> DataFrame:
    """Where an observer without a tile goes: the centre of the tile nearest the middle of the key box (one row)."""
    box = tiles.agg(((F.min("trow") + F.max("trow")) / 2).alias("mr"), ((F.min("tcol") + F.max("tcol")) / 2).alias("mc"))
    off = (F.col("trow") - F.col("mr")) ** 2 + (F.col("tcol") - F.col("mc")) ** 2
    best = tiles.crossJoin(F.broadcast(box)).agg(F.min_by(F.struct("trow", "tcol"), F.struct(off.alias("o"), "trow", "tcol")).alias("t"))
    return best.select("t.trow", "t.tcol", (grid.origin_x + (F.col("t.tcol") + 0.5) * grid.width).alias("x"), (grid.origin_y - (F.col("t.trow") + 0.5) * grid.width).alias("y"))


def locate(points: DataFrame, cells: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Points (point_id, x, y) with the dataset of highest priority (smallest key of grids) whose usable cell holds them; NULL: none.

    cells: dataset_id, trow, tcol, y, x. One equi-join for all datasets.
    """
    keyed = None
    for dataset, grid in grids.items():
        one = points.withColumns(cell_of(F.col("x"), F.col("y"), grid)).withColumn("dataset_id", F.lit(dataset)).drop("sx", "sy")
        keyed = one if keyed is None else keyed.unionByName(one)
    ground = cells.select("dataset_id", "trow", "tcol", F.col("y").alias("cy"), F.col("x").alias("cx"))
    met = keyed.join(ground, ["dataset_id", "trow", "tcol", "cy", "cx"], "left_semi")
    return points.join(met.groupBy("point_id").agg(F.min("dataset_id").alias("dataset_id")), "point_id", "left")


def owned_cells(lower: DataFrame, lower_grid: Grid, higher: DataFrame, higher_grid: Grid) -> DataFrame:
    """C4: lower-priority cells that higher ones do not fully cover.

    Each cell lists the higher grid's cells it overlaps (sizes differ by a few, so the
    list is short), and stays unless all of them are usable: one join on the cell key,
    one aggregation.
    """
    x0 = lower_grid.origin_x + (F.col("tcol") * lower_grid.cells + F.col("x")) * lower_grid.cell
    y0 = lower_grid.origin_y - (F.col("trow") + 1) * lower_grid.width + F.col("y") * lower_grid.cell
    h, eps = higher_grid, 1e-6

    def span(a: Column, origin: float) -> Column:
        return F.sequence(F.floor((a - origin) / h.cell + eps).cast("long"), F.ceil((a + lower_grid.cell - origin) / h.cell - eps).cast("long") - 1)

    parts = lower.withColumn("_gx", F.explode(span(x0, h.origin_x))).withColumn("_gy", F.explode(span(y0, h.origin_y)))
    tcol, trow = F.floor(F.col("_gx") / h.cells), F.floor(-(F.col("_gy") + 1) / h.cells + eps)
    keyed = parts.select(*lower.columns, trow.cast("long").alias("_r"), tcol.cast("long").alias("_c"),
                         (F.col("_gy") + (trow + 1) * h.cells).cast("int").alias("_y"), (F.col("_gx") - tcol * h.cells).cast("int").alias("_x"))
    up = higher.select(F.col("trow").alias("_r"), F.col("tcol").alias("_c"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.lit(1).alias("_hit"))
    key = ["trow", "tcol", "y", "x"]
    open_cells = keyed.join(up, ["_r", "_c", "_y", "_x"], "left").groupBy(*key).agg(F.count_if(F.col("_hit").isNull()).alias("n")).filter("n > 0").select(*key)
    return lower.join(open_cells, key, "left_semi")


def owned_hits(candidates: DataFrame, higher: DataFrame, grid: Grid) -> DataFrame:
    """Candidate roots (x, y, t) that lie in no higher-priority cell; a hidden root leaves the next of its ray in play."""
    placed = candidates.withColumns(cell_of(F.col("x"), F.col("y"), grid)).drop("sx", "sy")
    ground = higher.select("trow", "tcol", F.col("y").alias("cy"), F.col("x").alias("cx"))
    return placed.join(ground, ["trow", "tcol", "cy", "cx"], "left_anti").drop("trow", "tcol", "cy", "cx")


def apply_vertical_offset(rows: DataFrame, offsets: DataFrame, columns: list[str]) -> DataFrame:
    """Heights of each dataset raised by its offset (dataset_id, vertical_offset_m)."""
    return rows.join(offsets, "dataset_id").withColumns({c: F.col(c) + F.col("vertical_offset_m") for c in columns}).drop("vertical_offset_m")


def coverage_footprints(tiles: DataFrame, grid: Grid, to_lat_lon) -> DataFrame:
    """The four corners of each tile in WGS84, as an array; to_lat_lon(x, y) gives struct(lat, lon)."""
    x0, y0 = grid.origin_x + F.col("tcol") * grid.width, grid.origin_y - (F.col("trow") + 1) * grid.width
    corners = F.array(*[F.struct((x0 + i * grid.width).alias("x"), (y0 + j * grid.width).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return tiles.withColumn("corners", F.transform(corners, lambda p: to_lat_lon(p["x"], p["y"])))


def patch_residual(col0: Column, row0: Column, size: Column, place) -> Column:
    """How far an affine fit at a region's centre is off at its corners and edges, in frame metres. place(col, row): struct(x, y)."""
    half = size / 2
    cx, cy = col0 + half, row0 + half
    # centre, east, west, north, south, then the corners; projected by one expression
    spots = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (-1, -1), (1, -1), (-1, 1), (1, 1))
    steps = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in spots])
    placed = F.transform(steps, lambda q: let(place(cx + q["i"] * half, cy + q["j"] * half), lambda p: F.struct(q["i"].alias("i"), q["j"].alias("j"), p["x"].alias("x"), p["y"].alias("y"))))

    def fit(ps: Column) -> Column:
        o, e, w, n, s = (F.get(ps, k) for k in range(5))
        off = F.transform(ps, lambda p: F.hypot(p["x"] - o["x"] - p["i"] * (e["x"] - w["x"]) / 2 - p["j"] * (n["x"] - s["x"]) / 2,
                                                p["y"] - o["y"] - p["i"] * (e["y"] - w["y"]) / 2 - p["j"] * (n["y"] - s["y"]) / 2))
        return F.array_max(off)

    return let(placed, fit)


def patch_map(col0: Column, row0: Column, size: Column, place) -> Column:
    """struct(x0, y0, ax, ay, bx, by) of the affine fit at a region's centre: frame = (x0, y0) + col * (ax, ay) + row * (bx, by)."""
    half = size / 2
    cx, cy = col0 + half, row0 + half
    spots = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    placed = F.transform(spots, lambda q: place(cx + q["i"] * half, cy + q["j"] * half))

    def fit(ps: Column) -> Column:
        o, e, w, n, s = (F.get(ps, k) for k in range(5))
        ax, ay, bx, by = (e["x"] - w["x"]) / size, (e["y"] - w["y"]) / size, (n["x"] - s["x"]) / size, (n["y"] - s["y"]) / size
        return F.struct((o["x"] - cx * ax - cy * bx).alias("x0"), (o["y"] - cx * ay - cy * by).alias("y0"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))

    return let(placed, fit)


def tile_patches(tiles: DataFrame, cells: int, place_of, residual: float = 0.25) -> DataFrame:
    """Square regions of tiles, quartered until an affine map into the frame is off by no more than `residual` metres.

    place_of(trow, tcol) gives place(col, row) -> struct(x, y). At most log2(cells)
    rounds; a round is a projection of the regions still too coarse.
    """
    place = place_of(F.col("trow"), F.col("tcol"))
    # stored, or Spark asks the filters below of each row that tiles are made from; dealt in turn, as by their key they stay the one task of a distinct()
    stored = written(dealt(tiles.select("trow", "tcol")), "patch-tiles")
    level = stored.select("trow", "tcol", F.lit(0.0).alias("col0"), F.lit(0.0).alias("row0"), F.lit(float(cells)).alias("size"))
    found, size = None, cells
    while True:
        judged = level.withColumn("residual", patch_residual(F.col("col0"), F.col("row0"), F.col("size"), place))
        done = judged.filter(F.col("residual") <= residual) if size > 1 else judged
        found = done if found is None else found.unionByName(done)
        if size <= 1:
            return found
        half = F.col("size") / 2
        four = F.explode(F.array(*[F.struct((F.col("col0") + i * half).alias("col0"), (F.col("row0") + j * half).alias("row0"), half.alias("size")) for j in (0, 1) for i in (0, 1)]))
        level = judged.filter(F.col("residual") > residual).select("trow", "tcol", four.alias("p")).select("trow", "tcol", "p.*")
        size //= 2


def patch_coverage(patches: DataFrame, rects: DataFrame) -> DataFrame:
    """Rectangles cut to patches of the same tile; empty ones go."""
    p = patches.select("trow", "tcol", F.col("col0").alias("pc"), F.col("row0").alias("pr"), F.col("size").alias("ps"))
    c0, r0 = F.greatest("column", "pc"), F.greatest("row", "pr")
    c1, r1 = F.least(F.col("column") + F.col("width"), F.col("pc") + F.col("ps")), F.least(F.col("row") + F.col("height"), F.col("pr") + F.col("ps"))
    return rects.join(p, ["trow", "tcol"]).filter((c1 > c0) & (r1 > r0)).select("trow", "tcol", "pc", "pr", c0.alias("column"), r0.alias("row"), (c1 - c0).alias("width"), (r1 - r0).alias("height"))


def native_if_partial(owned: Column, cells: int, lod: Column) -> Column:
    """C11: a tile that is not wholly owned and covered keeps its native resolution."""
    return F.when(owned < cells * cells, 1).otherwise(lod)

"""Ray casting over a stack of datasets, each with a grid of its own in one frame.

The first dataset with a usable cell at a place owns it. Paths are cut at every
layer's cell lines, and pieces that lie in a cell of a higher layer go, so what is left
of all layers is one surface without overlaps. The rest is the trace of one dataset;
only where two layers meet can the ground have a step, and that counts as ground.

A layer of another reference system than the frame's is traced through patches: squares
of its tiles in which an affine map into the frame is off by a quarter of a metre at most.
A path is a straight line in a patch's columns and rows, too, so there it is cut and
solved as in a grid of cells of size 1, with the same distances along it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.geodesy import LEAST_RADIUS, MOST_RADIUS, distances, from_crs, to_crs, valid_lat_lon
from ..storage import written
from .catalogue import owned_cells, patch_map, tile_patches
from .points import cell_of, highest, sample_ground
from .rays import CURVATURE, dealt, widened
from .tiles import KEY, Grid, tile_index
from .trace import NUDGE, bilinear, clamp_half, cut_at, descended, gradient_bilinear, in_sight, local, nearest, on_cells, paths_of, pieces_of, solved, stop_rising, tile_path

HEIGHTS = ("z00", "z01", "z10", "z11", "zmax")


@dataclass(frozen=True)
class Layer:
    """A dataset: cells (trow, tcol, y, x, z00..z11, zmax), the grid they lie on, metres to raise it by.

    Traces take layers in one frame, or in systems of their own if they are given the
    frame's. Questions asked by latitude and longitude need the grid's system, those for
    vertices (trow, tcol, col, row, z) these, too.
    """

    cells: DataFrame
    grid: Grid
    vertical_offset_m: float = 0.0
    epsg: int | None = None
    vertices: DataFrame | None = None


def owned_layers(layers: list[Layer]) -> list[Layer]:
    """Layers raised by their offsets, without the cells that a higher one covers; stored, as every trace reads them."""
    found: list[Layer] = []
    for layer in layers:
        cells = layer.cells.withColumns({c: F.col(c) + layer.vertical_offset_m for c in HEIGHTS})
        for higher in layers[: len(found)]:
            if layer.epsg == higher.epsg:
                cells = owned_cells(cells, layer.grid, higher.cells, higher.grid)
        found.append(replace(layer, cells=written(cells, "owned-cells"), vertical_offset_m=0.0))
    return found


#: A path's place at distance 0 and its direction, in the frame.
FRAME = ("x", "y", "dx", "dy")


def outside(pieces: DataFrame, higher: DataFrame, grid: Grid, frame: tuple[str, str, str, str] = FRAME) -> DataFrame:
    """Pieces of paths (x, y, dx, dy, t0, t1) cut at a higher layer's cell lines, without those that lie in its cells.

    So a root under the higher layer is never made, and the next one of the same cell stays in play. Pieces over ground stay as they are.
    """
    x, y, dx, dy = map(F.col, frame)
    cut = cut_at(pieces, x - grid.origin_x, y - grid.origin_y, dx, dy, F.col("t0"), F.col("t1"), grid.cell, whole=F.col("over"))
    parts = cut.withColumns({"t0": F.col("_a"), "t1": F.col("_b")}).drop("_a", "_b")
    mid = (F.col("t0") + F.col("t1")) / 2
    place = cell_of(x + dx * mid, y + dy * mid, grid)
    keys = {"trow": "_r", "tcol": "_c", "cy": "_y", "cx": "_x"}
    taken = higher.select(F.col("trow").alias("_r"), F.col("tcol").alias("_c"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    place["cy"] = F.when(F.col("over"), -1).otherwise(place["cy"])  # a row of cells that isn't there
    return parts.withColumns({to: place[k] for k, to in keys.items()}).join(taken, list(keys.values()), "left_anti").drop(*keys.values())


def hits_or_steps(met: DataFrame, grid: Grid) -> DataFrame:
    """Pieces with slope and t, R10 and R16: the first root, or the entry where a ray enters below ground that is continuous from the observer on."""
    sx, sy = local(F.col("t0"), grid)
    height = F.col("z") + F.col("slope") * F.col("t0") + CURVATURE * F.col("t0") * F.col("t0")
    return solved(met, grid).withColumn("t", F.when((F.col("gaps") == 0) & (height < bilinear(sx, sy)), F.col("t0")).otherwise(F.col("t")))


def patches_of(layer: Layer, frame_epsg: int, residual: float = 0.25) -> DataFrame:
    """C9 of a layer's tiles: trow, tcol, col0, row0, size, the map m into the frame and its inverse ixx, ixy, iyx, iyy (cells a metre)."""
    grid = layer.grid

    def place_of(trow: Column, tcol: Column):
        def place(col: Column, row: Column) -> Column:
            x, y = grid.origin_x + tcol * grid.width + col * grid.cell, grid.origin_y - (trow + 1) * grid.width + row * grid.cell
            return let(from_crs(x, y, layer.epsg), lambda p: to_crs(p["lon"], p["lat"], frame_epsg))

        return place

    found = tile_patches(layer.cells.select(*KEY).distinct(), grid.cells, place_of, residual)
    mapped = found.withColumn("m", patch_map(F.col("col0"), F.col("row0"), F.col("size"), place_of(F.col("trow"), F.col("tcol"))))
    det = F.col("m.ax") * F.col("m.by") - F.col("m.bx") * F.col("m.ay")
    return mapped.withColumns({"ixx": F.col("m.by") / det, "ixy": -F.col("m.bx") / det, "iyx": -F.col("m.ay") / det, "iyy": F.col("m.ax") / det})


def patch_segments(paths: DataFrame, layer: Layer, frame_epsg: int, residual: float = 0.25) -> DataFrame:
    """Paths cut to the patches of a layer of another system, each as a path in the layer's columns and rows (x, y, dx, dy, t0, t1, trow,
    tcol), with the frame's as fx, fy, fdx, fdy.

    Patches and paths meet in squares of the frame about as wide as a tile: both list those they touch, so they are joined by equality.
    """
    grid = layer.grid
    bin_width = grid.width * (111320.0 if layer.epsg == 4326 else 1.0)
    patches = written(patches_of(layer, frame_epsg, residual), "tile-patches")
    corner = [(F.col("m.x0") + (F.col("col0") + i * F.col("size")) * F.col("m.ax") + (F.col("row0") + j * F.col("size")) * F.col("m.bx"),
               F.col("m.y0") + (F.col("col0") + i * F.col("size")) * F.col("m.ay") + (F.col("row0") + j * F.col("size")) * F.col("m.by")) for i in (0, 1) for j in (0, 1)]
    spans = []
    for axis in (0, 1):
        low, high = F.least(*[c[axis] for c in corner]) - residual, F.greatest(*[c[axis] for c in corner]) + residual
        spans.append(F.sequence(F.floor(low / bin_width), F.floor(high / bin_width)))
    binned = patches.withColumn("_bc", F.explode(spans[0])).withColumn("_bn", F.explode(spans[1])).select(
        *patches.columns, F.col("_bc").alias("_c"), (-F.col("_bn") - 1).alias("_r"))
    cut = tile_path(paths, Grid(0.0, 0.0, bin_width, 1)).withColumnsRenamed({"trow": "_r", "tcol": "_c"})
    met = widened(cut).join(binned, ["_r", "_c"])
    # the path in the tile's columns and rows; what the maps of neighbouring patches are apart is given to both
    ex, ey = F.col("x") - F.col("m.x0"), F.col("y") - F.col("m.y0")
    col, row = F.col("ixx") * ex + F.col("ixy") * ey, F.col("iyx") * ex + F.col("iyy") * ey
    dc, dr = F.col("ixx") * F.col("dx") + F.col("ixy") * F.col("dy"), F.col("iyx") * F.col("dx") + F.col("iyy") * F.col("dy")
    met = met.withColumns({"_col": col, "_row": row, "_dc": dc, "_dr": dr})
    spare = 2 * residual / (grid.cell * (111320.0 if layer.epsg == 4326 else 1.0))
    begin, end = F.col("t0"), F.col("t1")
    for p, d, low in (("_col", "_dc", "col0"), ("_row", "_dr", "row0")):
        a, b = (F.col(low) - spare - F.col(p)) / F.col(d), (F.col(low) + F.col("size") + spare - F.col(p)) / F.col(d)
        still = F.abs(F.col(d)) < 1e-12
        inside = F.col(p).between(F.col(low) - spare, F.col(low) + F.col("size") + spare)
        begin = F.greatest(begin, F.when(still, F.when(inside, float("-inf")).otherwise(float("inf"))).otherwise(F.least(a, b)))
        end = F.least(end, F.when(still, F.when(inside, float("inf")).otherwise(float("-inf"))).otherwise(F.greatest(a, b)))
    clipped = met.withColumns({"_a": begin, "_b": end}).filter(F.col("_b") - F.col("_a") > NUDGE)
    keep = [c for c in paths.columns if c not in FRAME]
    return clipped.select(
        *keep, *[F.col(c).alias("f" + c) for c in FRAME], (F.col("_col") + F.col("tcol") * grid.cells).alias("x"), (F.col("_row") - (F.col("trow") + 1) * grid.cells).alias("y"),
        F.col("_dc").alias("dx"), F.col("_dr").alias("dy"), F.col("_a").alias("t0"), F.col("_b").alias("t1"), "trow", "tcol", "ixx", "ixy", "iyx", "iyy")


def covered_stretches(pieces: DataFrame) -> DataFrame:
    """(view_id, px, covered): the stretches (a, b) of each path on a layer's ground, neighbouring pieces joined to one."""
    along = Window.partitionBy("view_id", "px").orderBy("t0")
    apart = (F.col("t0") - F.coalesce(F.max("t1").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))) > 1e-6).cast("int")
    runs = pieces.select("view_id", "px", "t0", "t1").withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("view_id", "px", "_run").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    return joined.groupBy("view_id", "px").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("covered"))


def off_stretches(pieces: DataFrame, covered: DataFrame) -> DataFrame:
    """C5 for a higher layer of any system: pieces of paths without what lies on its stretches."""
    met = pieces.join(covered, ["view_id", "px"], "left")
    inner = F.filter(F.col("covered"), lambda s: (s["b"] > F.col("t0")) & (s["a"] < F.col("t1")))
    ends = F.concat(F.array(F.col("t0")), F.flatten(F.transform(inner, lambda s: F.array(s["a"], s["b"]))), F.array(F.col("t1")))
    # from the end of one stretch to the begin of the next
    free = F.transform(F.array(ends), lambda e: F.transform(F.sequence(F.lit(0), (F.size(e) / 2).cast("int") - 1), lambda k: F.struct(
        F.get(e, 2 * k).alias("a"), F.get(e, 2 * k + 1).alias("b"))))[0]
    whole = F.array(F.struct(F.col("t0").alias("a"), F.col("t1").alias("b")))
    left = F.filter(F.when(F.col("covered").isNull(), whole).otherwise(free), lambda s: s["b"] - s["a"] > NUDGE)
    return met.withColumn("_s", F.explode(left)).withColumns({"t0": F.col("_s.a"), "t1": F.col("_s.b")}).drop("_s", "covered")


def trace_stack(views: DataFrame, layers: list[Layer], frame_epsg: int | None = None, residual: float = 0.25) -> DataFrame:
    """R1-R13 over a stack, highest priority first: trace()'s columns and dataset_id, the hit layer's number from 0, and, for
    stack_gradients(), the inverse ixx, ixy, iyx, iyy of the map of the hit's cell into the frame.

    Heights are bilinear. Tiles and blocks of cells that the lowest ray flies over are not joined to
    their cells; they count as ground for what is behind them if all their cells are there, and are met cell by cell otherwise.
    frame_epsg: the views' system, where layers have other ones; those are traced through
    patches whose maps are off by residual metres at most.
    """
    paths = paths_of(views)
    pieces = None
    owned = owned_layers(layers)
    indexes = [written(tile_index(layer.cells, layer.grid), "tile-index") for layer in owned]
    tops = None
    for index in indexes:
        tops = index.select("zmax") if tops is None else tops.unionByName(index.select("zmax"))
    paths = stop_rising(paths, tops, F.col("low_slope"))
    slope, stretches = F.col("low_slope"), []
    for number, (layer, index) in enumerate(zip(owned, indexes, strict=True)):
        foreign = frame_epsg is not None and layer.epsg not in (None, frame_epsg)
        if foreign:
            grid, frame = Grid(0.0, 0.0, 1.0, layer.grid.cells), tuple("f" + c for c in FRAME)
            met = on_cells(descended(patch_segments(paths, layer, frame_epsg, residual), index, grid, slope, voids=True), layer.cells, grid, keep_over=True)
        else:
            grid, frame = layer.grid, FRAME
            met = on_cells(pieces_of(paths, index, grid, slope, voids=True), layer.cells, grid, keep_over=True)
            met = met.withColumns({"ixx": F.lit(1 / grid.cell), "ixy": F.lit(0.0), "iyx": F.lit(0.0), "iyy": F.lit(1 / grid.cell)})
        own = met
        for higher, covered in zip(layers[:number], stretches, strict=True):
            met = outside(met, higher.cells, higher.grid, frame) if covered is None else off_stretches(met, covered)
        # of another system's layer others can't be cut at its cell lines, so its stretches are made
        stretches.append(written(covered_stretches(own), "stretches") if foreign and number + 1 < len(layers) else None)
        both = met.drop("over", *["f" + c for c in FRAME]).withColumns({"dataset_id": F.lit(number), "cell": F.lit(grid.cell)})
        pieces = both if pieces is None else pieces.unionByName(both)
    grid = Grid(0.0, 0.0, F.col("cell"), 0)  # only the cell's size is asked for, each piece has its own
    return nearest(views, hits_or_steps(in_sight(pieces, grid), grid), grid, ("dataset_id", *MAP))


#: The inverse of a cell's map into the frame, in cells a metre.
MAP = ("ixx", "ixy", "iyx", "iyy")


def stack_gradients(hits: DataFrame, layers: list[Layer]) -> DataFrame:
    """R14 for trace_stack()'s hits: grad_e, grad_n along the frame's axes: by column and row, then by the inverse transpose of the map."""
    cells = None
    for number, layer in enumerate(layers):
        one = layer.cells.select(F.lit(number).alias("dataset_id"), *KEY, F.col("y").alias("cy"), F.col("x").alias("cx"), "z00", "z01", "z10", "z11")
        cells = one if cells is None else cells.unionByName(one)
    found = hits.filter("distance is not null").join(cells, ["dataset_id", *KEY, "cy", "cx"])
    by_col, by_row = gradient_bilinear(F.col("sx"), F.col("sy"), 1.0)
    grads = {"grad_e": clamp_half(F.col("ixx") * by_col + F.col("iyx") * by_row), "grad_n": clamp_half(F.col("ixy") * by_col + F.col("iyy") * by_row)}
    return found.withColumns(grads).drop("z00", "z01", "z10", "z11")


def sample_stack(points: DataFrame, layers: list[Layer]) -> DataFrame:
    """P7 by C6 and C7: points (lat, lon) with ground, raised by its layer's offset, and dataset_id, the number of the first layer
    with a usable cell there. NULL: no layer has one.

    An equi-join on tile and cell for each layer, as sample_ground(); a stream of points may be joined so, too.
    """
    found, grounds = points, []
    for number, layer in enumerate(layers):
        at = to_crs(F.col("lon"), F.col("lat"), layer.epsg)
        placed = found.withColumn("_at", at).withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at")
        grounds.append(f"_ground{number}")
        found = sample_ground(placed, layer.cells, layer.grid, layer.vertical_offset_m).withColumnRenamed("ground", grounds[-1]).drop("x", "y")
    owner = F.coalesce(*[F.when(F.col(c).isNotNull(), number) for number, c in enumerate(grounds)])
    return found.withColumns({"ground": F.coalesce(*grounds), "dataset_id": owner}).drop(*grounds)


#: What a box around a circle is widened by.
WIDER = 1.01


def box_of(layer: Layer, radius: float) -> tuple[Column, Column, Column]:
    """(x, half width, half height) of a box in the layer's coordinates around the circle at (lat, lon), a cell wider than it.

    The projected systems stretch lengths by less than WIDER where they are in use. By
    longitude, a circle with a pole in it goes all the way round.
    """
    if layer.epsg != 4326:
        half = F.lit(radius * WIDER + layer.grid.cell)
        return to_crs(F.col("lon"), F.col("lat"), layer.epsg)["x"], half, half
    angle = radius / LEAST_RADIUS * WIDER
    round_pole = F.abs(F.radians("lat")) + angle >= F.pi() / 2
    wide = F.when(round_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.lit(angle)) / F.cos(F.radians("lat")), F.lit(1.0)))))
    return F.col("lon"), wide + layer.grid.cell, F.degrees(F.lit(angle)) + layer.grid.cell


def layer_points(centres: DataFrame, layer: Layer, radius: float) -> DataFrame:
    """Vertices of one layer within a geodesic radius of centres (centre_id, lat, lon): the centre's columns as from_lat, from_lon, and lat, lon, distance.

    Centres go to the tiles that their box touches, on both sides of the date line.
    """
    grid = layer.grid
    x, wide, high = box_of(layer, radius)
    y = to_crs(F.col("lon"), F.col("lat"), layer.epsg)["y"]
    turns = [0.0, -360.0, 360.0] if layer.epsg == 4326 else [0.0]
    spans = [F.sequence(F.floor((x + t - wide - grid.origin_x) / grid.width), F.floor((x + t + wide - grid.origin_x) / grid.width)) for t in turns]
    if len(spans) > 1:
        # a turn is only of use where the box leaves -180..180
        crosses = [F.lit(True), x + wide > 180, x - wide < -180]
        spans = [F.when(c, s).otherwise(F.array().cast("array<bigint>")) for c, s in zip(crosses, spans, strict=True)]
    rows = F.sequence(F.floor((grid.origin_y - y - high) / grid.width), F.floor((grid.origin_y - y + high) / grid.width))
    boxed = dealt(centres, "centre_id").select("centre_id", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.array_distinct(F.flatten(F.array(*spans))).alias("_cols"), rows.alias("_rows"))
    keyed = boxed.withColumn("tcol", F.explode("_cols")).withColumn("trow", F.explode("_rows")).drop("_cols", "_rows")
    vx, vy = grid.origin_x + F.col("col") * grid.cell, grid.origin_y - F.col("row") * grid.cell
    spots = layer.vertices.filter("z is not null").select("trow", "tcol", from_crs(vx, vy, layer.epsg).alias("_at")).select("trow", "tcol", F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"))
    met = widened(keyed).join(spots.filter(valid_lat_lon(F.col("lat"), F.col("lon"))), ["trow", "tcol"])
    # on a sphere of the smallest radius nothing is farther than on the ellipsoid: few pairs are left to be measured exactly
    half = lambda a, b: F.sin(F.radians(F.col(a) - F.col(b)) / 2) ** 2
    chord = half("lat", "from_lat") + F.cos(F.radians("lat")) * F.cos(F.radians("from_lat")) * half("lon", "from_lon")
    limit = lambda r: math.sin(min(radius / r, math.pi) / 2) ** 2
    near = met.withColumn("_chord", chord).filter(F.col("_chord") <= limit(LEAST_RADIUS) + 1e-15)
    # within the circle on a sphere of the largest radius it is within it on the ellipsoid
    away = near.withColumn("distance", distances(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")))
    inside = away.filter((F.col("_chord") < limit(MOST_RADIUS) - 1e-15) | (F.col("distance") <= radius))
    return inside.select("centre_id", "from_lat", "from_lon", "lat", "lon", "distance")


def _around(centres: DataFrame, layers: list[Layer], radius: float) -> DataFrame:
    if radius < 0:
        raise ValueError("radius is negative")
    found = None
    for number, layer in enumerate(layers):
        one = layer_points(centres, layer, radius).withColumn("dataset_id", F.lit(number))
        found = one if found is None else found.unionByName(one)
    return found


def grid_points(centres: DataFrame, layers: list[Layer], radius: float) -> DataFrame:
    """(centre_id, dataset_id, lat, lon, distance): vertices of all layers within a geodesic radius of centres (centre_id, lat, lon), each layer's once."""
    return _around(centres, layers, radius).select("centre_id", "dataset_id", "lat", "lon", "distance").distinct()


def find_summit(centres: DataFrame, layers: list[Layer], radius: float) -> DataFrame:
    """(centre_id, z, lat, lon, distance): the highest ground of grid_points() and of the centre itself; ties go to the nearer.

    The ground is that of sample_stack(), so a lower layer counts only where no higher one has a cell. NULL where no point has ground.
    """
    around = _around(centres, layers, radius).select("centre_id", "lat", "lon", "distance")
    every = around.unionByName(centres.select("centre_id", "lat", "lon", F.lit(0.0).alias("distance")))
    found = sample_stack(every, layers).withColumnRenamed("ground", "z").drop("dataset_id")
    return highest(found, centres, ["lat", "lon"])

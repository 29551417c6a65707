"""Ray casting as joins: where does each line of sight first meet the ground?

All rays of an angular view's pixel column share a horizontal path. It ends where its
lowest ray is above all ground for good. It is cut at grid lines without a shuffle, by
columns that Spark compiles: first with tile lines, joined to the manifest, which drops tiles
the lowest ray flies over; then with the lines of blocks of 64 and 8 cells, whose highest
ground the manifest's row has with it; what is left is cut at cell lines and joined to
cells, of which stored ones are read by need. Only then it is widened to slopes, and only
to those that can have their first hit in a cell: above what the cells before have
hidden, not above the cell's highest corner.

Heights follow z(t) = z0 + slope * t + CURVATURE * t^2, t in horizontal metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .rays import CURVATURE, angular_columns, angular_slope, dealt, widened
from .tiles import BLOCK_KEY, KEY, Grid, block_sizes, corners, in_blocks

#: Folders of stored cells whose numbers are broadcast at most, to read only those that are asked for.
MAX_FOLDERS = 1 << 18
#: How far over the highest ground a ray counts as over it for good, in metres.
MARGIN = 1.0
NUDGE = 1e-9
#: The column of a manifest's rows that has their tiles' vertices.
HEIGHTS = "heights"
#: What names a ray.
RAY = ["view_id", "px", "py"]


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows.withColumns(columns), each computed once and in a method of its own of the code that Spark compiles.

    The JVM interprets methods of more than 8,000 bytes, and all that lies between two explode() is one method, in which
    filters pushed below a column repeat its expression. Nothing is pushed into the struct that is exploded here.
    """
    every = {**{c: F.col(f"`{c}`") for c in rows.columns}, **{c: F.col(f"_s.`{c}`") for c in columns}}
    return rows.withColumn("_s", F.explode_outer(F.array(F.struct(*[v.alias(c) for c, v in columns.items()])))).select(*[v.alias(c) for c, v in every.items()])


def _between_lines(rows: DataFrame, p: Column, d: Column, step: float | Column, spare: float, whole: Column | None) -> DataFrame:
    """Rows with _a, _b: stretches of _a.._b between the lines of one axis, p + d * t being a multiple of step; some may be empty.

    spare: steps by which lines outside are looked at, too, for rounding. whole: rows that aren't cut.
    """
    u, v = p + d * F.col("_a"), p + d * F.col("_b")
    moving = F.abs(d) > 1e-12
    ends = rows.withColumns({"_p": p, "_d": F.when(moving, d).otherwise(1.0), "_low": F.ceil(F.least(u, v) / step - spare), "_high": F.floor(F.greatest(u, v) / step + spare)})
    cut = moving if whole is None else moving & ~whole
    ends = ends.withColumns({
        "_n": F.when(cut, F.greatest(F.col("_high") - F.col("_low") + 1, F.lit(0))).otherwise(0).cast("long"),
        "_first": F.when(F.col("_d") > 0, F.col("_low")).otherwise(F.col("_high")), "_turn": F.when(F.col("_d") > 0, 1).otherwise(-1)})
    # outer, or the optimizer asks the sequence once more whether it is empty
    each = ends.withColumn("_i", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("_n"))))

    def line(i: Column) -> Column:
        t = ((F.col("_first") + F.col("_turn") * i) * step - F.col("_p")) / F.col("_d")
        return F.least(F.greatest(t, F.col("_a")), F.col("_b"))

    begin, end = F.when(F.col("_i") == 0, F.col("_a")).otherwise(line(F.col("_i") - 1)), F.when(F.col("_i") == F.col("_n"), F.col("_b")).otherwise(line(F.col("_i")))
    return settled(each, {"_a": begin, "_b": end}).drop("_p", "_d", "_low", "_high", "_n", "_first", "_turn", "_i")


def cut_at(rows: DataFrame, x: Column, y: Column, dx: Column, dy: Column, t0: Column, t1: Column, step: float | Column, whole: Column | None = None) -> DataFrame:
    """Rows of straight paths, one for each stretch _a.._b between t0 and t1 in which its path stays in one cell of a grid of that step.

    x, y: the path's place at t = 0, in metres from the grid's corner. whole: rows that aren't cut.
    First the columns of cells are gone through, then the cells of each; all in columns that
    Spark compiles: arrays of crossings need lambdas, which are interpreted.
    """
    columns = _between_lines(rows.withColumns({"_a": t0, "_b": t1}), x, dx, step, 0.0, whole)
    return _between_lines(columns, y, dy, step, 1e-6, whole).filter(F.col("_b") - F.col("_a") > NUDGE)


def tile_path(paths: DataFrame, grid: Grid) -> DataFrame:
    """A row for each tile a path crosses, with entry and exit: t0, t1, trow, tcol.

    paths: x, y (frame metres), dx, dy, tmax, and tmin if they begin later than at 0.
    Tiles without ground fall out at the join with the manifest.
    """
    px, py = F.col("x") - grid.origin_x, F.col("y") - grid.origin_y
    tmin = F.col("tmin") if "tmin" in paths.columns else F.lit(0.0)
    cut = cut_at(paths, px, py, F.col("dx"), F.col("dy"), tmin, F.col("tmax"), grid.width)
    mid = (F.col("_a") + F.col("_b")) / 2
    return cut.select(
        *paths.columns, F.col("_a").alias("t0"), F.col("_b").alias("t1"),
        F.floor(-(py + F.col("dy") * mid) / grid.width).cast("long").alias("trow"), F.floor((px + F.col("dx") * mid) / grid.width).cast("long").alias("tcol"))


def lowest(slope: Column, z0: Column, t0: Column, t1: Column) -> Column:
    """The lowest height of a ray between t0 and t1."""
    t = F.least(F.greatest(-slope / (2 * CURVATURE), t0), t1)
    return z0 + slope * t + CURVATURE * t * t


def over_all_from(slope: Column, z: Column, top: Column, margin: float = MARGIN) -> Column:
    """The distance from which on a ray is above the highest ground by the margin, and stays so; 0 if it is so all along.

    The larger root of slope * t + CURVATURE * t^2 = rise: behind it the ray rises, as it is convex.
    """
    rise = top + margin - z
    root = F.sqrt(slope * slope + 4 * CURVATURE * rise)
    # of the two forms of the root the one that doesn't cancel
    far = F.when(slope > 0, 2 * rise / (slope + root)).otherwise((root - slope) / (2 * CURVATURE))
    return F.when(slope * slope + 4 * CURVATURE * rise < 0, 0.0).otherwise(F.greatest(far, F.lit(0.0)))


def stop_rising(paths: DataFrame, manifest: DataFrame, slope: Column) -> DataFrame:
    """Paths with tmax no farther than where they are over all ground for good; those that are over it all along go."""
    top = manifest.agg(F.coalesce(F.max("zmax"), F.lit(float("-inf")))).scalar()
    ends = paths.withColumn("tmax", F.least(F.col("tmax"), over_all_from(slope, F.col("z"), top)))
    return ends.filter(F.col("tmax") > (F.col("tmin") if "tmin" in paths.columns else 0.0))


def cull_tiles(segments: DataFrame, manifest: DataFrame, slope: Column, margin: float = 1.0) -> DataFrame:
    """Segments whose lowest height is not above the tile's highest ground by more than the margin."""
    found = widened(segments).join(manifest.select("trow", "tcol", F.col("zmax").alias("tile_max")), ["trow", "tcol"])
    return found.filter(lowest(slope, F.col("z"), F.col("t0"), F.col("t1")) <= F.col("tile_max") + margin)


def from_corner(grid: Grid) -> tuple[Column, Column]:
    """Where a path begins, in metres from the south-west corner of the tile trow, tcol."""
    return F.col("x") - (grid.origin_x + F.col("tcol") * grid.width), F.col("y") - (grid.origin_y - (F.col("trow") + 1) * grid.width)


def placed(pieces: DataFrame, grid: Grid) -> DataFrame:
    """Pieces inside a cell of trow, tcol each, with its cx, cy and the path's begin lx, ly in cells from the tile's corner."""
    sx, sy = from_corner(grid)
    mid = (F.col("t0") + F.col("t1")) / 2
    return pieces.select(
        *pieces.columns, F.floor((sx + F.col("dx") * mid) / grid.cell).cast("int").alias("cx"), F.floor((sy + F.col("dy") * mid) / grid.cell).cast("int").alias("cy"),
        (sx / grid.cell).alias("lx"), (sy / grid.cell).alias("ly"))


def cell_path(segments: DataFrame, grid: Grid) -> DataFrame:
    """A row for each cell crossed inside a tile: t0, t1 and x, y counted from the tile's south-west corner."""
    sx, sy = from_corner(grid)
    keep = [c for c in segments.columns if c not in ("t0", "t1")]
    cut = cut_at(segments, sx, sy, F.col("dx"), F.col("dy"), F.col("t0"), F.col("t1"), grid.cell)
    return placed(cut.select(*keep, F.col("_a").alias("t0"), F.col("_b").alias("t1")), grid)


#: What becomes of a piece of path: it is cut finer, it is over ground without a void, it is of no use.
CUT, OVER, GONE = 0, 1, 2


def descent(segments: DataFrame, grid: Grid, slope: Column, sizes: list[int], voids: bool = False, to_cells: bool = True) -> DataFrame:
    """R9's block cull: segments with their tile's index cut at the lines of its blocks of each size and of cells: t0, t1 and what, CUT or OVER.

    A piece that the ray flies over is not cut any finer: OVER if the ground under it has no
    void, as it hides what ground hides, else it is gone. With voids, ground that has some is
    cut all the same, down to its cells, so that where they are comes out.
    """
    sx, sy = from_corner(grid)
    t0, t1 = F.col("t0"), F.col("t1")

    def asked(top: Column, full: Column, margin: float) -> Column:
        over = lowest(slope, F.col("z"), t0, t1) > top + margin
        return F.when(top.isNull() | (over & ~full & F.lit(not voids)), GONE).when(over & full, OVER).otherwise(CUT)

    def finer(pieces: DataFrame, step: float | Column) -> DataFrame:
        cut = cut_at(pieces, sx, sy, F.col("dx"), F.col("dy"), t0, t1, step, whole=F.col("what") == OVER)
        return cut.withColumns({"t0": F.col("_a"), "t1": F.col("_b")}).drop("_a", "_b")

    pieces = settled(segments, {"what": asked(F.col("tile_max"), F.col("tile_full"), MARGIN)}).filter(F.col("what") != GONE).drop("tile_max", "tile_full")
    for size in sizes:
        step, side, mid = grid.cell * size, -(-grid.cells // size), (t0 + t1) / 2
        at = [F.least(F.greatest(F.floor((s + F.col(d) * mid) / step), F.lit(0)), F.lit(side - 1)) for s, d in ((sy, "dy"), (sx, "dx"))]
        found = finer(pieces, step).withColumn("_e", F.get(F.col(f"b{size}"), (at[0] * side + at[1]).cast("int")))
        block = asked(F.col("_e.top"), F.coalesce("_e.full", F.lit(False)), 1e-6)
        pieces = settled(found, {"what": F.when(F.col("what") == OVER, OVER).otherwise(block)}).filter(F.col("what") != GONE).drop("_e", f"b{size}")
    return finer(pieces, grid.cell) if to_cells else pieces


def indexed(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tile segments with their tile's highest ground and, where the manifest has them (tile_index(), folder_tiles()), its blocks' and its heights; dealt, as they are cut next."""
    blocks = [c for c in manifest.columns if c in ("b64", "b8", HEIGHTS)]
    full = F.col("full") if "full" in manifest.columns else F.lit(False)
    return widened(dealt(segments, *KEY)).join(manifest.select(*KEY, F.col("zmax").alias("tile_max"), full.alias("tile_full"), *blocks), KEY)


def descended(segments: DataFrame, manifest: DataFrame, grid: Grid, slope: Column, voids: bool = False, to_cells: bool = True) -> DataFrame:
    """Tile segments cut at block and cell lines, without what their ray flies over; over: pieces above ground without a void, left whole."""
    sizes = [s for s in block_sizes(grid) if f"b{s}" in manifest.columns]
    cut = descent(indexed(segments, manifest), grid, slope, sizes, voids, to_cells)
    keep = [c for c in segments.columns if c not in ("t0", "t1")]
    return cut.select(*keep, "t0", "t1", (F.col("what") == OVER).alias("over"), *[c for c in manifest.columns if c == HEIGHTS])


def pieces_of(paths: DataFrame, manifest: DataFrame, grid: Grid, slope: Column, voids: bool = False, to_cells: bool = True) -> DataFrame:
    """Paths cut at tile, block and cell lines; see descended()."""
    return descended(tile_path(paths, grid), manifest, grid, slope, voids, to_cells)


def cells_by_need(cells: DataFrame, paths: DataFrame, manifest: DataFrame, grid: Grid, slope: Column) -> DataFrame:
    """The cells that a trace of paths can meet: of stored cells (sources.tiles.write_cells()) only the folders of tiles that the manifest leaves are read.

    Their numbers are broadcast where the store has MAX_FOLDERS at most, and prune partitions at run time; beyond that they are joined.
    """
    if HEIGHTS in manifest.columns or not set(BLOCK_KEY) <= set(cells.columns):
        return cells
    folders = in_blocks(manifest.select(*KEY)).select(*BLOCK_KEY).distinct().count()
    met = cull_tiles(tile_path(paths, grid), manifest, slope).filter("t0 < t1")
    asked = in_blocks(met.select(*KEY)).select(*BLOCK_KEY).distinct()
    return cells.join(F.broadcast(asked) if folders <= MAX_FOLDERS else asked, BLOCK_KEY, "left_semi")


def on_cells(pieces: DataFrame, cells: DataFrame, grid: Grid, keep_over: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """Pieces with the corners of the cells they lie in; those over ground without corners, if they are kept. more: keys beside the tile's.

    Pieces that have their tile's heights with them find the corners there, without a join.
    """
    if HEIGHTS in pieces.columns:
        return with_corners(pieces, grid, keep_over)
    key = [*more, *KEY, "cy", "cx"]
    ground = cells.select(*more, *KEY, F.col("y").alias("cy"), F.col("x").alias("cx"), "z00", "z01", "z10", "z11", "zmax")
    if not keep_over:
        return widened(placed(pieces.filter("not over"), grid)).join(ground, key)
    # a row of cells that isn't there: what is over finds none, spread by its tile
    own = placed(pieces, grid).withColumn("cy", F.when(F.col("over"), -1).otherwise(F.col("cy")))
    return widened(own).join(ground, key, "left").filter("over or z00 is not null")


def with_corners(pieces: DataFrame, grid: Grid, keep_over: bool) -> DataFrame:
    """on_cells() for pieces with heights."""
    own = placed(pieces if keep_over else pieces.filter("not over"), grid)
    inside = ~F.col("over") & F.col("cx").between(0, grid.cells - 1) & F.col("cy").between(0, grid.cells - 1)
    found = settled(own, {c: F.when(inside, v) for c, v in corners(F.col(HEIGHTS), F.col("cy"), F.col("cx"), grid.cells).items()}).drop(HEIGHTS)
    whole = F.col("z00").isNotNull() & F.col("z01").isNotNull() & F.col("z10").isNotNull() & F.col("z11").isNotNull()
    met = found.filter(whole | F.col("over")) if keep_over else found.filter(whole)
    # a row of cells that isn't there, as where cells are joined
    return met.withColumns({"zmax": F.when(whole, F.greatest("z00", "z01", "z10", "z11")), "cy": F.when(F.col("over"), -1).otherwise(F.col("cy"))})


def local(t: Column, grid: Grid) -> tuple[Column, Column]:
    """Where a path is inside its cell, 0..1 each way."""
    return F.col("lx") + F.col("dx") * t / grid.cell - F.col("cx"), F.col("ly") + F.col("dy") * t / grid.cell - F.col("cy")


def bilinear(sx: Column, sy: Column) -> Column:
    z00, z01, z10, z11 = (F.col(c) for c in ("z00", "z01", "z10", "z11"))
    return z00 + (z01 - z00) * sx + (z10 - z00) * sy + (z00 - z01 - z10 + z11) * sx * sy


def hit_bilinear(slope: Column, grid: Grid, tolerance: float = 1e-6) -> Column:
    """The first t in t0..t1 at which a ray meets the bilinear patch; NULL if it does not.

    A ray that enters at or under the surface, by no more than a millimetre, meets it at the entry.
    """
    t0, length = F.col("t0"), F.col("t1") - F.col("t0")
    a0, b0 = local(t0, grid)
    a1, b1 = F.col("dx") / grid.cell, F.col("dy") / grid.cell
    z00, z01, z10, z11 = (F.col(c) for c in ("z00", "z01", "z10", "z11"))
    e, n, q = z01 - z00, z10 - z00, z00 - z01 - z10 + z11
    qa = CURVATURE - q * a1 * b1
    qb = slope + 2 * CURVATURE * t0 - e * a1 - n * b1 - q * (a0 * b1 + a1 * b0)
    qc = F.col("z") + slope * t0 + CURVATURE * t0 * t0 - (z00 + e * a0 + n * b0 + q * a0 * b0)

    def roots(k: Column) -> Column:
        a, b, c = k["a"], k["b"], k["c"]
        disc = b * b - 4 * a * c
        w = -0.5 * (b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(disc, F.lit(0.0))))
        both = F.when(F.abs(a) < 1e-12, F.array(F.when(F.abs(b) > 1e-12, -c / b))).when(disc < 0, F.array(F.lit(None).cast("double"))).otherwise(
            F.array(w / a, F.when(w != 0, c / w)))
        inside = F.filter(both, lambda r: (r >= -tolerance) & (r <= length + tolerance))
        entry = F.when((c <= 0) & (c >= -0.001), F.lit(0.0))
        return F.least(F.array_min(F.transform(inside, lambda r: F.least(F.greatest(r, F.lit(0.0)), length))), entry)

    return t0 + F.transform(F.array(F.struct(qa.alias("a"), qb.alias("b"), qc.alias("c"))), roots)[0]


def solved(met: DataFrame, grid: Grid, surface: str = "bilinear", tolerance: float = 1e-6) -> DataFrame:
    """Pieces with slope and t, hit_bilinear() or hit_triangles(). A bilinear root goes through columns of its own, which Spark compiles; lambdas are interpreted."""
    if surface == "triangles":
        return met.withColumn("t", hit_triangles(F.col("slope"), grid))
    slope, t0, length = F.col("slope"), F.col("t0"), F.col("t1") - F.col("t0")
    a0, b0 = local(t0, grid)
    a1, b1 = F.col("dx") / grid.cell, F.col("dy") / grid.cell
    z00, z01, z10, z11 = (F.col(c) for c in ("z00", "z01", "z10", "z11"))
    one = met.withColumns({"_a0": a0, "_b0": b0, "_a1": a1, "_b1": b1, "_e": z01 - z00, "_n": z10 - z00, "_q": z00 - z01 - z10 + z11})
    a0, b0, a1, b1, e, n, q = (F.col(c) for c in ("_a0", "_b0", "_a1", "_b1", "_e", "_n", "_q"))
    two = one.withColumns({
        "_qa": CURVATURE - q * a1 * b1, "_qb": slope + 2 * CURVATURE * t0 - e * a1 - n * b1 - q * (a0 * b1 + a1 * b0),
        "_qc": F.col("z") + slope * t0 + CURVATURE * t0 * t0 - (z00 + e * a0 + n * b0 + q * a0 * b0)})
    a, b, c = F.col("_qa"), F.col("_qb"), F.col("_qc")
    three = two.withColumn("_disc", b * b - 4 * a * c)
    four = three.withColumn("_w", -0.5 * (b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.col("_disc"), F.lit(0.0)))))
    w, straight, none = F.col("_w"), F.abs(a) < 1e-12, F.col("_disc") < 0
    five = four.withColumns({"_r1": F.when(straight, F.when(F.abs(b) > 1e-12, -c / b)).when(~none, w / a), "_r2": F.when(~straight & ~none & (w != 0), c / w)})

    def inside(r: Column) -> Column:
        return F.when((r >= -tolerance) & (r <= length + tolerance), F.least(F.greatest(r, F.lit(0.0)), length))

    entry = F.when((c <= 0) & (c >= -0.001), F.lit(0.0))
    return five.withColumn("t", t0 + F.least(inside(F.col("_r1")), inside(F.col("_r2")), entry)).drop(
        "_a0", "_b0", "_a1", "_b1", "_e", "_n", "_q", "_qa", "_qb", "_qc", "_disc", "_w", "_r1", "_r2")


def hit_triangles(slope: Column, grid: Grid) -> Column:
    """The same for a cell split on the diagonal with less height difference; curvature is frozen at the entry."""
    t0 = F.col("t0")
    a0, b0 = local(t0, grid)
    a1, b1 = F.col("dx") / grid.cell, F.col("dy") / grid.cell
    h = F.col("z") + slope * t0 + CURVATURE * t0 * t0
    z00, z01, z10, z11 = (F.col(c) for c in ("z00", "z01", "z10", "z11"))
    split = F.abs(z00 - z11) < F.abs(z01 - z10)

    def plane(base: Column, e: Column, n: Column, inside) -> Column:
        """Root of the ray and z = base + e * sx + n * sy, if it lies in the triangle and not behind."""
        rate = slope - e * a1 - n * b1
        t = F.when(F.abs(rate) > 1e-12, (base + e * a0 + n * b0 - h) / rate)
        sx, sy = a0 + a1 * t, b0 + b1 * t
        eps = 1e-9
        ok = (t >= 0) & (sx >= -eps) & (sx <= 1 + eps) & (sy >= -eps) & (sy <= 1 + eps) & inside(sx, sy, eps)
        return F.when(ok, t)

    one = F.when(split, plane(z00, z01 - z00, z11 - z01, lambda x, y, e: x - y >= -e)).otherwise(plane(z00, z01 - z00, z10 - z00, lambda x, y, e: x + y <= 1 + e))
    two = F.when(split, plane(z00, z11 - z10, z10 - z00, lambda x, y, e: x - y <= e)).otherwise(
        plane(z01 + z10 - z11, z11 - z10, z11 - z01, lambda x, y, e: x + y >= 1 - e))
    return t0 + F.least(one, two)


def gradient_bilinear(sx: Column, sy: Column, cell: float) -> tuple[Column, Column]:
    """(dz/deast, dz/dnorth) of the bilinear patch, clamped to what a half float holds."""
    z00, z01, z10, z11 = (F.col(c) for c in ("z00", "z01", "z10", "z11"))
    q = z00 - z01 - z10 + z11
    return clamp_half((z01 - z00 + q * sy) / cell), clamp_half((z10 - z00 + q * sx) / cell)


def gradient_triangle(sx: Column, sy: Column, cell: float) -> tuple[Column, Column]:
    """The same of the triangle that is hit."""
    z00, z01, z10, z11 = (F.col(c) for c in ("z00", "z01", "z10", "z11"))
    split = F.abs(z00 - z11) < F.abs(z01 - z10)
    bottom = F.when(split, sx > sy).otherwise(sx + sy < 1)
    left = F.when(split, sx <= sy).otherwise(sx + sy < 1)
    return clamp_half(F.when(bottom, z01 - z00).otherwise(z11 - z10) / cell), clamp_half(F.when(left, z10 - z00).otherwise(z11 - z01) / cell)


def clamp_half(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-65504.0)), F.lit(65504.0))


NEIGHBOURS = {"zw0": (-1, 0), "zw1": (-1, 1), "ze0": (2, 0), "ze1": (2, 1), "zs0": (0, -1), "zs1": (1, -1), "zn0": (0, 2), "zn1": (1, 2)}


def with_neighbours(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """R15's stencil: the eight heights around each cell, and stencil_ok where all are there.

    Every vertex is sent to the cells it neighbours; one aggregation, one join on the cell's key.
    """
    sent = F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(name).alias("k")) for name, (dx, dy) in NEIGHBOURS.items()]))
    fed = vertices.filter("z is not null").select("trow", "tcol", "z", sent.alias("c"))
    wide = fed.groupBy("trow", "tcol", F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(*[F.max(F.when(F.col("c.k") == k, F.col("z"))).alias(k) for k in NEIGHBOURS])
    ok = F.lit(True)
    for k in NEIGHBOURS:
        ok = ok & F.col(k).isNotNull()
    return cells.join(wide, ["trow", "tcol", "y", "x"], "left").withColumn("stencil_ok", ok)


def gradient_smooth(sx: Column, sy: Column, cell: float) -> tuple[Column, Column]:
    """Central differences at the four corners, bilinear between them; R14's where the stencil is not complete."""
    c = F.col

    def mix(g00, g01, g10, g11):
        low, high = g00 + (g01 - g00) * sx, g10 + (g11 - g10) * sx
        return (low + (high - low) * sy) / (2 * cell)

    e = mix(c("z01") - c("zw0"), c("ze0") - c("z00"), c("z11") - c("zw1"), c("ze1") - c("z10"))
    n = mix(c("z10") - c("zs0"), c("z11") - c("zs1"), c("zn0") - c("z00"), c("zn1") - c("z01"))
    plain = gradient_bilinear(sx, sy, cell)
    return F.when(c("stencil_ok"), clamp_half(e)).otherwise(plain[0]), F.when(c("stencil_ok"), clamp_half(n)).otherwise(plain[1])


def apparent(height: Column, t: Column) -> Column:
    """The slope under which a height at t is seen."""
    return (height - F.col("z")) / t - CURVATURE * t


def paths_of(views: DataFrame) -> DataFrame:
    """A row for each pixel column of angular views, with the slope of its lowest ray."""
    return angular_columns(views).withColumn("low_slope", F.least(angular_slope(F.lit(0)), angular_slope(F.col("height") - 1)))


def in_sight(met: DataFrame, grid: Grid) -> DataFrame:
    """Rays (py, slope) with the pieces of path in which they can have their first hit.

    met: pieces of paths on ground that do not overlap. A piece without corners (z00 is
    NULL) has ground that all rays fly over. Adds gaps: 0 as long as the ground is
    continuous from the observer on, and step, the piece's number along its path. floor, where there is one: rays below it are not asked for.
    """
    # what each cell hides (the ground at its exit) and at most shows (its highest corner)
    exit_x, exit_y = local(F.col("t1"), grid)
    rise = F.col("zmax") - F.col("z")
    best_t = F.when(rise >= 0, F.col("t0")).otherwise(F.least(F.greatest(F.sqrt(-rise / CURVATURE), F.col("t0")), F.col("t1")))
    met = met.withColumns({"hides": apparent(bilinear(exit_x, exit_y), F.col("t1")), "shows": F.when(best_t > 0, rise / best_t - CURVATURE * best_t).otherwise(float("inf"))})
    along = Window.partitionBy("view_id", "px").orderBy("t0")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # the ground hides only as long as it is continuous from the observer on
    gap = (F.col("t0") - F.coalesce(F.max("t1").over(before), F.lit(0.0)) > 1e-6).cast("int")
    met = met.withColumns({"_gap": gap, "step": F.row_number().over(along)}).withColumn("gaps", F.sum("_gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    hidden = F.coalesce(F.max("hides").over(before), F.lit(float("-inf")))
    floor = F.col("floor") if "floor" in met.columns else F.lit(float("-inf"))
    met = met.withColumn("hidden", F.greatest(F.when(F.col("gaps") == 0, hidden).otherwise(float("-inf")), floor))
    # float noise at either bound costs a test, not a hit
    spare = 1e-6
    met = met.filter(F.col("z00").isNotNull() & (F.col("hidden") <= F.col("shows") + spare))
    # slopes grow with atan, so the rows between two slopes are a range
    step = (F.col("el1") - F.col("el0")) / F.col("height")

    def row_of(slope: Column) -> Column:
        return (F.atan(slope) - F.col("el0")) / step - 0.5

    first, last = F.least(row_of(F.col("hidden") - spare), row_of(F.col("shows") + spare)), F.greatest(row_of(F.col("hidden") - spare), row_of(F.col("shows") + spare))
    low, high = F.greatest(F.floor(first), F.lit(0)).cast("int"), F.least(F.ceil(last), F.col("height") - 1).cast("int")
    return met.filter(low <= high).withColumn("py", F.explode(F.sequence(low, high))).withColumn("slope", angular_slope(F.col("py")))


def rays_of(views: DataFrame) -> DataFrame:
    return angular_columns(views).withColumn("py", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("slope", angular_slope(F.col("py")))


def best_hits(solved: DataFrame, grid: Grid, keep: tuple[str, ...] = ()) -> DataFrame:
    """(RAY, h, n_cells, n_steps): the nearest of each ray's cells' hits t, NULL if there is none; what gets here is a few cells a ray.

    Each column has a minimum of its own, as a struct's would make Spark sort all rows; of equal t all of them take the same row.
    """
    sx, sy = local(F.col("t"), grid)
    named = ["trow", "tcol", "cy", "cx", "sx", "sy", *keep]
    firsts = [F.min_by(c, "t").alias(f"_h_{c}") for c in named]
    found = solved.withColumns({"sx": sx, "sy": sy}).groupBy(*RAY).agg(
        F.min("t").alias("_t"), *firsts, F.count(F.lit(1)).alias("n_cells"), F.min_by("step", "t").alias("_step"), F.max("step").alias("_last"))
    hit = F.struct(F.col("_t").alias("t"), *[F.col(f"_h_{c}").alias(c) for c in named])
    return found.select(*RAY, F.when(F.col("_t").isNotNull(), hit).alias("h"), "n_cells", F.coalesce("_step", "_last").cast("long").alias("n_steps"))


def with_hits(views: DataFrame, found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every ray of the views with its hit.

    A filter on the hit makes the join an inner one, for which Spark would broadcast all rays through the driver.
    """
    z = F.col("z") + F.col("slope") * F.col("h.t") + CURVATURE * F.col("h.t") * F.col("h.t")
    return widened(rays_of(views)).join(found, RAY, "left").select(
        *RAY, "x", "y", "z", "dx", "dy", "slope", F.col("h.t").alias("distance"), z.alias("elevation"), "h.trow", "h.tcol", "h.cy", "h.cx", "h.sx", "h.sy",
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"), *[f"h.{c}" for c in keep])


def nearest(views: DataFrame, solved: DataFrame, grid: Grid, keep: tuple[str, ...] = ()) -> DataFrame:
    return with_hits(views, best_hits(solved, grid, keep), keep)


def trace(views: DataFrame, cells: DataFrame, manifest: DataFrame, grid: Grid, surface: str = "bilinear", bands: tuple[float, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """First hits of angular views, one row a ray; NULL distance is sky.

    views: view_id, x, y, z, width, height, az0, az1, el0, el1, tmax. cells: trow, tcol,
    y, x, z00..z11, zmax; stored ones are read by need. manifest: trow, tcol, zmax; with
    tile_index()'s blocks paths are cut at those first. Returns view_id, px, py, dx, dy,
    slope, distance, elevation, trow, tcol, cy, cx, sx, sy, n_cells (cells tested) and n_steps
    (pieces of the path up to the hit, or to the last one tested). keep: more of the hit cell's columns, as its corners.

    bands: shares of the range to trace first. A column goes on from there with the lowest
    of its rays that has no hit yet, so what that ray flies over is neither cut nor read;
    hits of a band are stored. Worth it where views see far and most rays end near by.
    """
    paths, found, begin = paths_of(views), None, 0.0
    for share in (*bands, 1.0):
        own = paths.withColumns({"tmin": F.col("tmax") * begin, "tmax": F.col("tmax") * share}) if bands else paths
        own = stop_rising(own, manifest, F.col("low_slope"))
        near = cells_by_need(cells, own, manifest, grid, F.col("low_slope"))
        met = on_cells(pieces_of(own, manifest, grid, F.col("low_slope")), near, grid, keep_over=True)
        hits = best_hits(solved(in_sight(met, grid), grid, surface), grid, keep)
        if bands:
            hits = written(hits, "band-hits")
        found = hits if found is None else found.unionByName(hits)
        if share < 1:
            # the lowest ray of each column that has none
            open_rays = rays_of(views).select(*RAY, "slope").join(found.filter("h is not null").select(*RAY), RAY, "left_anti")
            lows = open_rays.groupBy("view_id", "px").agg(F.min("slope").alias("low_slope")).withColumn("floor", F.col("low_slope"))
            paths, begin = paths_of(views).drop("low_slope").join(written(lows, "open-columns"), ["view_id", "px"]), share
    if bands:  # a ray has a row for each band in which cells were tested
        found = found.groupBy(*RAY).agg(F.min_by("h", F.col("h.t")).alias("h"), F.sum("n_cells").alias("n_cells"), F.sum("n_steps").alias("n_steps"))
    return with_hits(views, found, keep)


def recovered_steps(path: DataFrame) -> DataFrame:
    """An entry under the ground counts as a hit only if ground is continuous from the ray's start to it.

    path: view_id, px, py, t0, t1, t_hit, entry_below (boolean). Adds hit.
    """
    along = Window.partitionBy("view_id", "px", "py").orderBy("t0")
    gap = (F.col("t0") - F.coalesce(F.lag("t1").over(along), F.lit(0.0)) > 1e-6).cast("int")
    marked = path.withColumn("gaps", F.sum(gap).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("hit", F.when(F.col("t_hit").isNotNull(), F.col("t_hit")).when(F.col("entry_below") & (F.col("gaps") == 0), F.col("t0"))).drop("gaps")


def shadow_rays(hits: DataFrame, sun_azimuth: Column, sun_elevation: Column, cell: float, keys: list[str] = RAY) -> DataFrame:
    """Rays to the sun from hits that face it, their start moved a little along and up."""
    sx, sy, slope = F.sin(sun_azimuth), F.cos(sun_azimuth), F.tan(sun_elevation)
    along, up = max(0.1, 0.05 * cell), max(0.05, 0.005 * cell)
    facing = -F.col("grad_e") * sx - F.col("grad_n") * sy + slope > 0
    return hits.filter((F.col("distance") > 0) & facing).select(
        *keys, (F.col("x") + F.col("distance") * F.col("dx") + along * sx).alias("x"), (F.col("y") + F.col("distance") * F.col("dy") + along * sy).alias("y"),
        (F.col("elevation") + along * slope + up).alias("z"), sx.alias("dx"), sy.alias("dy"), slope.alias("slope"))


def shadowed(rays: DataFrame, cells: DataFrame, manifest: DataFrame, grid: Grid, tmax: float, keys: list[str] = RAY) -> DataFrame:
    """Keys of shadow rays that meet ground within tmax; any hit will do, so nothing is ordered."""
    met = crossed_cells(rays.withColumn("tmax", F.lit(tmax)), cells, manifest, grid)
    met = met.filter(lowest(F.col("slope"), F.col("z"), F.col("t0"), F.col("t1")) <= F.col("zmax"))
    # a filter on t alone would be pushed down as one long expression
    return solved(met, grid).groupBy(*keys).agg(F.min("t").alias("t")).filter("t is not null").select(*keys)


def shadow_visibility(hits: DataFrame, cells: DataFrame, manifest: DataFrame, grid: Grid, azimuth: float | Column, elevation: float | Column, tmax: float, keys: list[str] = RAY) -> DataFrame:
    """Hits with lit. A sun not above the horizon lights nothing, one in the zenith everything; slopes turned away keep true."""
    azimuth, elevation = F.lit(azimuth), F.lit(elevation)
    up = elevation > 0
    rays = shadow_rays(hits.filter(up & (F.cos(elevation) >= 1e-6)), azimuth, elevation, grid.cell, keys)
    dark = shadowed(rays, cells, manifest, grid, tmax, keys).withColumn("dark", F.lit(True))
    return hits.join(dark, keys, "left").withColumn("lit", F.when(up, F.col("dark").isNull()).otherwise(False)).drop("dark")


def sunlit_hits(hits: DataFrame, suns: DataFrame, cells: DataFrame, manifest: DataFrame, grid: Grid, tmax: float) -> DataFrame:
    """A5: hits with lit for each instant of their view. suns: view_id, instant, azimuth, elevation (A3's).

    One trace for all instants, one shadow pass for all suns; the instant is a part of the
    key. Hits of a view without a sun have no row.
    """
    up = suns.select("view_id", "instant", F.col("azimuth").alias("sun_azimuth"), F.col("elevation").alias("sun_elevation"))
    # suns are widened by their instants
    return shadow_visibility(hits.join(widened(up), "view_id"), cells, manifest, grid, F.col("sun_azimuth"), F.col("sun_elevation"), tmax, [*RAY, "instant"])


def crossed_cells(rays: DataFrame, cells: DataFrame, manifest: DataFrame | None, grid: Grid) -> DataFrame:
    """Rays with paths of their own (x, y, z, dx, dy, slope, tmax) and the cells they cross; with a manifest those alone that they don't fly over as far as its blocks tell."""
    if manifest is None:
        ground = cells.select(*KEY, F.col("y").alias("cy"), F.col("x").alias("cx"), "z00", "z01", "z10", "z11", "zmax")
        return widened(cell_path(tile_path(rays, grid), grid)).join(ground, [*KEY, "cy", "cx"])
    slope = F.col("slope")
    own = stop_rising(rays, manifest, slope)
    return on_cells(pieces_of(own, manifest, grid, slope), cells_by_need(cells, own, manifest, grid, slope), grid, keep_over=False)


def first_hits(rays: DataFrame, cells: DataFrame, manifest: DataFrame, grid: Grid, bands: tuple[float, ...] = ()) -> DataFrame:
    """R10, R12, R13 for rays with paths of their own (camera rays): every ray with distance and elevation, NULL for sky.

    bands: shares of the range to trace first. Only rays without a hit there go on, each
    band's hits are stored; worth it where most rays end near by.
    """
    keys = ["view_id", "px", "py"]
    waiting, found = rays, None
    for share in (*bands, 1.0):
        met = crossed_cells(waiting.withColumn("tmax", F.col("tmax") * share), cells, manifest, grid)
        met = met.filter(lowest(F.col("slope"), F.col("z"), F.col("t0"), F.col("t1")) <= F.col("zmax"))
        hits = solved(met, grid).groupBy(*keys).agg(F.min("t").alias("distance")).filter("distance is not null")
        if share < 1:
            hits = written(hits, "band-hits")
            waiting = waiting.join(hits, keys, "left_anti")
        found = hits if found is None else found.unionByName(hits)
    hit = rays.join(found, keys, "left")
    return hit.withColumn("elevation", F.col("z") + F.col("slope") * F.col("distance") + CURVATURE * F.col("distance") * F.col("distance"))


def entries(rays: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """R16's input: the cells of each ray with their root and whether the ray enters below the ground."""
    met = crossed_cells(rays, cells, None, grid)
    sx, sy = local(F.col("t0"), grid)
    height = F.col("z") + F.col("slope") * F.col("t0") + CURVATURE * F.col("t0") * F.col("t0")
    return solved(met, grid).select("view_id", "px", "py", "t0", "t1", F.col("t").alias("t_hit"), (height < bilinear(sx, sy)).alias("entry_below"))

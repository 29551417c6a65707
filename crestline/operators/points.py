"""Peaks, points and summits: search, projection, visibility, ground height."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import LEAST_RADIUS, MOST_RADIUS, from_crs, geodesic, true_north_basis
from ..storage import written
from .rays import CURVATURE, camera_axes, dealt, widened
from .tiles import Grid


def _folding() -> tuple[str, str]:
    """Letters that are a plain one with marks, and those plain ones, by Unicode's decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and all(unicodedata.combining(c) for c in plain[1:]):
            pairs.append((chr(code), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: What names a ray.
RAY = ["view_id", "px", "py"]
MARKED, PLAIN = _folding()
#: Letters without a decomposition that search takes for others.
STROKED, UNSTROKED = "øłđħ", "oldh"
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe"}


def folded(text: Column) -> Column:
    """Lower case without accents, so that strings can be compared and cut by their letters."""
    plain = F.regexp_replace(F.translate(F.lower(F.translate(text, MARKED, PLAIN)), STROKED, UNSTROKED), r"\p{Mn}", "")
    for ligature, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    return plain


def grams(text: Column, size: Column | int) -> Column:
    """The distinct substrings of that many letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda k: F.substring(text, k, F.lit(size))))


def search_peaks(queries: DataFrame, peaks: DataFrame, k: int = 6) -> DataFrame:
    """For each query (query_id, text, lat, lon) the k best peaks by name: equal, then starting with, then containing the text.

    Case and accents make no difference; ties go to the nearer, then the smaller id. An
    empty text finds none. An inverted index: a name that contains a text has all its
    runs of three letters, so a text meets the names that have the rarest of those, by
    an equal key, and only they are compared. Texts of one or two letters are keys themselves.

    Each text, each name and each question of a text from a place is asked once, however
    many queries and peaks have it. Distances are bounded by spheres inside and outside the
    ellipsoid; only what can still be among the k best is measured exactly.
    """
    asked = queries.select("query_id", folded(F.trim("text")).alias("wanted"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon")).filter("wanted <> ''")
    named = dealt(peaks).withColumn("_name", folded(F.col("name")))
    # of peaks of one name at one place the smaller ids come first, wherever they are asked from
    same = Window.partitionBy("_name", "lat", "lon").orderBy("peak_id")
    few = named.withColumn("_k", F.row_number().over(same)).filter(F.col("_k") <= k)
    names, texts = named.select("_name").distinct(), asked.select("wanted").distinct()

    def posted(size: int) -> DataFrame:
        return names.filter(F.length("_name") >= size).withColumn("gram", F.explode(grams(F.col("_name"), size)))

    short = None
    for size in (1, 2):
        own = texts.filter(F.length("wanted") == size).join(posted(size), F.col("wanted") == F.col("gram"))
        short = own if short is None else short.unionByName(own)
    # the rarest of a text's grams; one that no name has leaves none to be found
    often = posted(3).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keyed = texts.filter(F.length("wanted") >= 3).withColumn("gram", F.explode(grams(F.col("wanted"), 3))).join(often, "gram", "left")
    rarest = keyed.groupBy("wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    both = rarest.join(posted(3), "gram").unionByName(short).filter(F.contains("_name", F.col("wanted")))
    match = F.when(F.col("_name") == F.col("wanted"), 0).when(F.startswith("_name", F.col("wanted")), 1).otherwise(2)
    once = asked.select("wanted", "from_lat", "from_lon").distinct().withColumn("_q", F.struct("wanted", "from_lat", "from_lon"))
    found = once.join(both.select("wanted", "_name", match.alias("match")), "wanted").join(few.select("_name", "peak_id", "name", "lat", "lon"), "_name")
    half = lambda a, b: F.sin(F.radians(F.col(a) - F.col(b)) / 2) ** 2
    chord = half("lat", "from_lat") + F.cos(F.radians("lat")) * F.cos(F.radians("from_lat")) * half("lon", "from_lon")
    angle = 2 * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
    # nearly opposite places, and those that aren't known, have no bounds
    bounded = F.when(angle <= 3.0, angle)
    found = found.select("_q", "match", "peak_id", "name", "lat", "lon", F.coalesce(bounded * LEAST_RADIUS - 1, F.lit(0.0)).alias("_low"), F.coalesce(bounded * MOST_RADIUS + 1, F.lit(float("inf"))).alias("_high"))
    found = written(found, "found-names")
    nearer = Window.partitionBy("_q").orderBy("match", "_high")
    edge = found.select("_q", "match", "_high").withColumn("_k", F.row_number().over(nearer)).filter(F.col("_k") <= k).groupBy("_q").agg(F.max(F.struct("match", "_high")).alias("_edge"))
    left = found.join(edge, found["_q"].eqNullSafe(edge["_q"])).drop(edge["_q"]).filter(F.struct("match", F.col("_low").alias("_high")) <= F.col("_edge"))
    away = geodesic(F.col("_q.from_lat"), F.col("_q.from_lon"), F.col("lat"), F.col("lon"))["distance"]
    place = F.row_number().over(Window.partitionBy("_q").orderBy("match", "distance", "peak_id"))
    best = left.withColumn("distance", away).withColumn("rank", place).filter(F.col("rank") <= k).select("_q", "peak_id", "name", "match", "distance", "rank")
    own = asked.select("query_id", F.struct("wanted", "from_lat", "from_lon").alias("_own"))
    return own.join(best, F.col("_own").eqNullSafe(F.col("_q"))).select("query_id", "peak_id", "name", "match", "distance", "rank")


def project_point(east: Column, north: Column, dz: Column) -> dict[str, Column]:
    """Pixel of a place seen by the row's camera (columns of camera_axes(), fx, fy, cx, cy, width, height).

    onscreen; px, py; and the direction to turn for what is behind.
    """
    up = dz - CURVATURE * (east * east + north * north)
    dot = lambda a: east * F.col(a + "e") + north * F.col(a + "n") + up * F.col(a + "u")
    forward, right, down = dot("f"), dot("r"), -dot("u")
    ahead = forward > 1e-9
    px = F.when(ahead, F.col("cx") + F.col("fx") * right / forward).otherwise(F.col("cx"))
    py = F.when(ahead, F.col("cy") + F.col("fy") * down / forward).otherwise(F.col("cy"))
    inside = ahead & (px >= 0) & (py >= 0) & (px < F.col("width")) & (py < F.col("height"))
    still = F.hypot(right, down) < 1e-12
    return {"onscreen": inside, "px": px, "py": py,
            "turn_x": F.when(ahead, px - F.col("cx")).when(still, 1.0).otherwise(right), "turn_y": F.when(ahead, py - F.col("cy")).when(still, 0.0).otherwise(down)}


def projected(views: DataFrame, targets: DataFrame) -> DataFrame:
    """P4 for targets (view_id, target_id, east, north, dz) of views."""
    both = widened(targets).join(views.withColumns(camera_axes()), "view_id")
    found = project_point(F.col("east"), F.col("north"), F.col("dz"))
    return both.withColumns(found).select(*targets.columns, *found, "width", "height", "tmax", "pixel_size")


def pixel_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """P5: struct(px, py) of fractions of an image; NULL outside 0..1."""
    ok = x.between(0, 1) & y.between(0, 1)
    return F.when(ok, F.struct(F.least(F.floor(x * width), width - 1).cast("int").alias("px"), F.least(F.floor(y * height), height - 1).cast("int").alias("py")))


def visible_peaks(views: DataFrame, hits: DataFrame, targets: DataFrame, k: int = 100) -> DataFrame:
    """Peaks that a hit stands for: within max(50 m, 2 pixels) of it in space, 50 m to tmax away; the k most prominent of a view.

    targets: view_id, target_id, east, north, dz, prominence, elevation. views have
    pixel_size, the angle of a pixel. The search window in pixels is dealt out in blocks
    of its size, so the join is on (view, block) with four blocks a peak at most.
    """
    distance = F.hypot("east", "north")
    near = projected(views, targets).filter("onscreen").withColumn("d", distance).filter((F.col("d") >= 50) & (F.col("d") <= F.col("tmax")))
    near = near.withColumn("window", F.greatest(F.ceil(50 / F.col("d") / F.col("pixel_size")), F.lit(1)).cast("int"))
    # windows of a power of two share a block size; hits are keyed for the sizes that occur
    near = near.withColumn("block", F.pow(F.lit(2), F.ceil(F.log2(F.col("window") * 2 + 1))).cast("int"))
    span = lambda p: F.sequence(F.floor((F.col(p) - F.col("window")) / F.col("block")).cast("int"), F.floor((F.col(p) + F.col("window")) / F.col("block")).cast("int"))
    keyed = near.withColumn("bx", F.explode(span("px"))).withColumn("by", F.explode(span("py")))
    sizes = near.select("view_id", "block").distinct()
    spots = widened(hits.filter("distance > 0")).join(sizes, "view_id").select(
        "view_id", "block", F.floor(F.col("px") / F.col("block")).cast("int").alias("bx"), F.floor(F.col("py") / F.col("block")).cast("int").alias("by"),
        F.col("px").alias("hx"), F.col("py").alias("hy"), (F.col("distance") * F.col("dx")).alias("he"), (F.col("distance") * F.col("dy")).alias("hn"), (F.col("elevation") - F.col("z")).alias("hz"))
    met = widened(keyed).join(spots, ["view_id", "block", "bx", "by"]).filter((F.abs(F.col("hx") + 0.5 - F.col("px")) <= F.col("window")) & (F.abs(F.col("hy") + 0.5 - F.col("py")) <= F.col("window")))
    off = F.sqrt((F.col("he") - F.col("east")) ** 2 + (F.col("hn") - F.col("north")) ** 2 + (F.col("hz") - F.col("dz")) ** 2)
    best = met.groupBy("view_id", "target_id").agg(F.min(off).alias("off"), F.first("d").alias("d"), F.first("pixel_size").alias("ps"), F.first("prominence").alias("prominence"), F.first("elevation").alias("elevation"))
    good = best.filter(F.col("off") <= F.greatest(F.lit(50.0), 2 * F.col("ps") * F.col("d")))
    order = Window.partitionBy("view_id").orderBy(F.desc("prominence"), F.desc("elevation"), "d", "target_id")
    return good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("view_id", "target_id", "rank", F.col("d").alias("distance"), "prominence", "elevation")


def target_occluded(seen: DataFrame, hits: DataFrame) -> DataFrame:
    """Projected targets (distance added) with occluded: ground nearer by more than max(5 m, 2 pixels), or out of range.

    Off the screen, and where the pixel has sky, nothing hides a target.
    """
    at = seen.withColumns({"_x": F.floor("px").cast("int"), "_y": F.floor("py").cast("int")})
    spots = hits.select("view_id", F.col("px").alias("_x"), F.col("py").alias("_y"), F.col("distance").alias("_hit"))
    met = at.join(spots, ["view_id", "_x", "_y"], "left")
    margin = F.greatest(F.lit(5.0), 2 * F.col("pixel_size") * F.col("distance"))
    hidden = F.when(F.col("distance") > F.col("tmax"), True).when(~F.col("onscreen"), False).otherwise(F.coalesce(F.col("_hit") + margin < F.col("distance"), F.lit(False)))
    return met.withColumn("occluded", hidden).drop("_x", "_y", "_hit")


def inspect(hits: DataFrame, pixels: DataFrame, epsg: int | None = None) -> DataFrame:
    """Distance, elevation, slope and downhill aspect (degrees from north) at pixels; sky has no row.

    With the frame's system (epsg) also lat and lon, and the aspect is from true north.
    Without one it is from the frame's; hits then need no place.
    """
    met = hits.join(pixels, RAY).filter("distance is not null")
    east, north = F.col("grad_e"), F.col("grad_n")
    place = []
    if epsg is not None:
        x, y = F.col("x") + F.col("distance") * F.col("dx"), F.col("y") + F.col("distance") * F.col("dy")
        met = met.withColumns({"_x": x, "_y": y}).withColumn("_p", from_crs(F.col("_x"), F.col("_y"), epsg))
        met = met.withColumn("_b", true_north_basis(F.col("_x"), F.col("_y"), F.col("_p.lat"), F.col("_p.lon"), epsg))
        # along true east and north
        east, north = (F.col("grad_e") * F.col(f"_b.{a}e") + F.col("grad_n") * F.col(f"_b.{a}n") for a in "en")
        place = [F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon")]
    aspect = F.when(F.hypot("grad_e", "grad_n") > 0, F.pmod(F.degrees(F.atan2(-east, -north)) + 360, F.lit(360.0)))
    return met.select(*RAY, "distance", "elevation", *place, F.degrees(F.atan(F.hypot("grad_e", "grad_n"))).alias("slope_deg"), aspect.alias("aspect_deg"))


def cell_of(x: Column, y: Column, grid: Grid) -> dict[str, Column]:
    """Tile and cell of a place, and where it is in the cell."""
    gx, gy = (x - grid.origin_x) / grid.cell, (y - grid.origin_y) / grid.cell
    tcol, trow = F.floor(gx / grid.cells), F.floor(-gy / grid.cells)
    lx, ly = gx - tcol * grid.cells, gy + (trow + 1) * grid.cells
    # the north edge of a tile belongs to its own last cell
    cx, cy = F.least(F.floor(lx), F.lit(grid.cells - 1)), F.least(F.floor(ly), F.lit(grid.cells - 1))
    return {"trow": trow.cast("long"), "tcol": tcol.cast("long"), "cx": cx.cast("int"), "cy": cy.cast("int"), "sx": lx - cx, "sy": ly - cy}


def sample_ground(points: DataFrame, cells: DataFrame, grid: Grid, offset: float = 0.0) -> DataFrame:
    """Points (x, y) with ground: bilinear height of the usable cell there, NULL without one.

    An equi-join on tile and cell; on Structured Streaming's side of it, too.
    """
    keys = ["trow", "tcol", "cy", "cx"]
    ground = cells.select("trow", "tcol", F.col("y").alias("cy"), F.col("x").alias("cx"), "z00", "z01", "z10", "z11")
    placed = points.withColumns(cell_of(F.col("x"), F.col("y"), grid))
    met = placed.join(ground, keys, "left")
    z = F.col("z00") + (F.col("z01") - F.col("z00")) * F.col("sx") + (F.col("z10") - F.col("z00")) * F.col("sy") + (F.col("z00") - F.col("z01") - F.col("z10") + F.col("z11")) * F.col("sx") * F.col("sy")
    return met.withColumn("ground", z + offset).select(*points.columns, "ground")


def near_vertices(centres: DataFrame, vertices: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Vertices within a radius of centres (centre_id, x, y): the centres' columns, vx, vy, z, distance; once for each tile that holds the vertex.

    A centre goes to the tiles its box touches, vertices are joined by tile, and the
    distance is checked last.
    """
    if radius < 0:
        raise ValueError("radius is negative")
    tile = lambda d, o: F.floor((F.col(d) - o) / grid.width)
    cols = F.sequence(tile("x", grid.origin_x + radius), tile("x", grid.origin_x - radius))
    rows = F.sequence(F.floor((grid.origin_y - F.col("y") - radius) / grid.width), F.floor((grid.origin_y - F.col("y") + radius) / grid.width))
    boxed = dealt(centres, "centre_id").withColumn("tcol", F.explode(cols)).withColumn("trow", F.explode(rows))
    vx, vy = grid.origin_x + F.col("col") * grid.cell, grid.origin_y - F.col("row") * grid.cell
    own = vertices.filter("z is not null").select("trow", "tcol", vx.alias("vx"), vy.alias("vy"), "z")
    met = widened(boxed).join(own, ["trow", "tcol"]).withColumn("distance", F.hypot(F.col("vx") - F.col("x"), F.col("vy") - F.col("y")))
    return met.filter(F.col("distance") <= radius).select(*centres.columns, "vx", "vy", "z", "distance")


def grid_points(centres: DataFrame, vertices: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """near_vertices(), each vertex once, on the edges of tiles too."""
    near = near_vertices(centres, vertices, grid, radius)
    return near.groupBy(*centres.columns, "vx", "vy", "distance").agg(F.max("z").alias("z")).select(*near.columns)


def highest(candidates: DataFrame, centres: DataFrame, columns: list[str]) -> DataFrame:
    """The highest of candidates (centre_id, z, distance and columns) of each centre; ties go to the nearer, then the smaller columns. NULL without one."""
    order = F.struct(-F.col("z"), "distance", *columns)
    best = candidates.filter("z is not null").groupBy("centre_id").agg(F.min_by(F.struct("z", *columns, "distance"), order).alias("b"))
    return centres.select("centre_id").join(best, "centre_id", "left").select("centre_id", "b.z", *[f"b.{c}" for c in columns], "b.distance")


def find_summit(centres: DataFrame, vertices: DataFrame, cells: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Highest ground of the vertices within the radius and of the centre itself; ties go to the nearer. NULL where none has ground."""
    around = near_vertices(centres.select("centre_id", "x", "y"), vertices, grid, radius).select("centre_id", F.col("vx").alias("x"), F.col("vy").alias("y"), "distance")
    every = around.unionByName(centres.select("centre_id", "x", "y", F.lit(0.0).alias("distance")))
    found = sample_ground(every, cells, grid).select("centre_id", F.col("ground").alias("z"), F.col("x").alias("vx"), F.col("y").alias("vy"), "distance")
    return highest(found, centres, ["vx", "vy"])


def track_clearance(track: DataFrame, cells: DataFrame, grid: Grid, clearance: float = 50.0, spare: float = 0.5) -> DataFrame:
    """P10: track (x, y, mode, height) with ground, z and accepted. FollowTerrain flies clearance above ground; HoldAltitude
    needs height at least spare above it. Unknown ground is rejected."""
    known = sample_ground(track, cells, grid)
    follow = F.col("mode") == "FollowTerrain"
    return known.withColumns({"z": F.when(follow, F.col("ground") + clearance).otherwise(F.col("height")),
                              "accepted": F.coalesce(F.when(follow, F.col("ground").isNotNull()).otherwise(F.col("height") >= F.col("ground") + spare), F.lit(False))})


def look_at(east: Column, north: Column, dz: Column) -> tuple[Column, Column]:
    """(heading, pitch) to a place, as it appears over the curved earth."""
    d2 = east * east + north * north
    return F.atan2(east, north), F.atan2(dz - CURVATURE * d2, F.sqrt(d2))


SECTORS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass_sector(degrees: Column) -> Column:
    """Name of the heading's sector of 22.5 degrees."""
    h = F.pmod(degrees, F.lit(360.0))
    return F.get(F.array(*map(F.lit, SECTORS)), (F.floor((h + 11.25) / 22.5) % 16).cast("int"))

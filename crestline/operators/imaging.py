"""Image-space operators: outlines, and the map of what is visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import map_xy
from .rays import CURVATURE

RADII = (1, 2, 4)


def feature_outlines(hits: DataFrame, detail: float = 0.65) -> DataFrame:
    """H8: adds outline. Neighbours at 1, 2 and 4 pixels come from two windows, along rows and columns of a view; no join.

    A pixel is on an outline if its neighbour is sky, or if the spacing to farther
    neighbours is well above what their angle explains, near by and in a wider look.
    """
    detail = min(max(detail, 0.0), 1.0)
    base = 24.0 - 18.0 * detail
    limits = (max(1.35, 0.45 * base), max(1.5, 0.75 * base), max(1.25, 0.55 * base))
    own = hits.withColumn("_p", F.struct("distance", "dx", "dy", "slope"))
    row, col = Window.partitionBy("view_id", "py").orderBy("px"), Window.partitionBy("view_id", "px").orderBy("py")
    names = []
    for d, (window, move) in enumerate(((row, F.lag), (row, F.lead), (col, F.lag), (col, F.lead))):
        for r in RADII:
            names.append(f"_n{d}_{r}")
            own = own.withColumn(names[-1], move("_p", r).over(window))

    def separation(n: Column) -> Column:
        d1, d2 = F.col("distance"), n["distance"]
        l1, l2 = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("slope") ** 2), F.sqrt(n["dx"] ** 2 + n["dy"] ** 2 + n["slope"] ** 2)
        chord = F.sqrt((F.col("dx") / l1 - n["dx"] / l2) ** 2 + (F.col("dy") / l1 - n["dy"] / l2) ** 2 + (F.col("slope") / l1 - n["slope"] / l2) ** 2)
        expected = F.greatest(F.least(d1 * l1, d2 * l2) * chord, F.lit(1.0))
        up1, up2 = d1 * F.col("slope") + CURVATURE * d1 * d1, d2 * n["slope"] + CURVATURE * d2 * d2
        actual = F.sqrt((d2 * n["dx"] - d1 * F.col("dx")) ** 2 + (d2 * n["dy"] - d1 * F.col("dy")) ** 2 + (up2 - up1) ** 2)
        return F.when(d2 > d1, actual / expected).otherwise(0.0)

    found = F.lit(False)
    for d in range(4):
        near = [F.col(f"_n{d}_{r}") for r in RADII]
        fine, medium, coarse = (F.coalesce(separation(n) > limit, F.lit(False)) for n, limit in zip(near, limits, strict=True))
        sky = near[0].isNotNull() & ~F.coalesce(near[0]["distance"] > 0, F.lit(False))
        found = found | sky | (fine & (medium | coarse))
    return own.withColumn("outline", F.coalesce(F.col("distance") > 0, F.lit(False)) & found).drop("_p", *names)


def visible_points(hits: DataFrame) -> DataFrame:
    """Places of hits relative to the observer, (east, north) metres; what is no hit goes."""
    ok = (F.col("distance") > 0) & (F.col("distance") < float("inf"))
    return hits.filter(ok).withColumns({"east": F.col("distance") * F.col("dx"), "north": F.col("distance") * F.col("dy")})


def map_pixel(east: Column, north: Column, centre: tuple[float, float], east_axis: tuple[float, float], north_axis: tuple[float, float]) -> tuple[Column, Column]:
    """Place on a map with an affine basis, in pixels."""
    return centre[0] + east * east_axis[0] + north * north_axis[0], centre[1] + east * east_axis[1] + north * north_axis[1]


def map_pixel_of(lat: Column, lon: Column, region: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """The same by latitude and longitude, for a map that shows a region (left, top, wide, high) of map_xy()'s world; the turn of a longitude nearest to its middle."""
    left, top, wide, high = region
    x, y = map_xy(lat, lon, F.lit((left + wide / 2) / float(1 << 28) * 360 - 180))
    return (x - left) / wide * width, (y - top) / high * height


def visibility_mask(points: DataFrame, width: int, height: int, keys: list[str] | None = None) -> DataFrame:
    """The map pixels that points (mx, my) cover, with the number of points: pixels whose centre is within [p - 1, p + 1).

    keys: what is counted besides the points: with the view, n_views gives a viewshed of many observers.
    """
    keys = keys or []
    inside = points.filter(F.col("mx").between(-1, width + 1) & F.col("my").between(-1, height + 1))
    base_x, base_y = F.ceil(F.col("mx") - 1.5).cast("int"), F.ceil(F.col("my") - 1.5).cast("int")
    four = F.explode(F.array(*[F.struct((base_x + i).alias("px"), (base_y + j).alias("py")) for j in (0, 1) for i in (0, 1)]))
    spread = inside.select(*keys, four.alias("q")).select(*keys, "q.px", "q.py").filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    counts = [F.count(F.lit(1)).alias("n_points")] + ([F.count_distinct(*keys).alias("n_views")] if keys else [])
    return spread.groupBy("px", "py").agg(*counts)

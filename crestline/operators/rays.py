"""Rays of views: angular fields and pinhole cameras, pixel footprints, levels of detail."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Apparent height gained per square metre of distance (curvature less refraction): 0.1695 m at a mile.
CURVATURE = 0.1695 / 1609.344**2
FLOAT_EPS = 2.0**-23


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks before they are exploded: a small table is one file and would be widened by one task.

    The number is given, as Spark would merge the tasks again by the size of what they are dealt.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def widened(rows: DataFrame) -> DataFrame:
    """Rows made by explode(), for the left side of a join: Spark's sizes leave that out, so it would take them for small and broadcast them."""
    return rows.hint("merge")


def angular_columns(views: DataFrame) -> DataFrame:
    """R1, horizontal part: a row for each pixel column of a view, with dx (east), dy (north).

    views: view_id, width, height, az0, az1, el0, el1 (radians, clockwise from north,
    end exclusive). All rays of a column share this path.
    """
    az = F.col("az0") + (F.col("px") + 0.5) * (F.col("az1") - F.col("az0")) / F.col("width")
    return dealt(views, "view_id").withColumn("px", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumns({"dx": F.sin(az), "dy": F.cos(az)})


def angular_slope(py: Column) -> Column:
    """R1, vertical part: the slope of a pixel row."""
    return F.tan(F.col("el0") + (py + 0.5) * (F.col("el1") - F.col("el0")) / F.col("height"))


def angular_rays(views: DataFrame) -> DataFrame:
    """(view_id, px, py, dx, dy, slope), one row a pixel."""
    columns = angular_columns(views).withColumn("py", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return columns.withColumn("slope", angular_slope(F.col("py")))


def camera_axes() -> dict[str, Column]:
    """Forward, right and up (east, north, up) of a camera from heading, pitch and roll."""
    h, p, r = F.col("heading"), F.col("pitch"), F.col("roll")
    sh, ch, sp, cp, sr, cr = F.sin(h), F.cos(h), F.sin(p), F.cos(p), F.sin(r), F.cos(r)
    return {
        "fe": cp * sh, "fn": cp * ch, "fu": sp,
        "re": cr * ch - sr * sp * sh, "rn": -cr * sh - sr * sp * ch, "ru": sr * cp,
        "ue": -sr * ch - cr * sp * sh, "un": sr * sh - cr * sp * ch, "uu": cr * cp}


def intrinsics_from_fov(size: Column, fov: Column) -> Column:
    """Focal length in pixels of an image side seen under an angle."""
    return 0.5 * size / F.tan(0.5 * fov)


def distortion(x: Column, y: Column, k1, k2, k3, p1, p2) -> tuple[Column, Column, Column]:
    """(radial factor, tangential x, tangential y) of the Brown-Conrady model."""
    r2 = x * x + y * y
    return (1 + r2 * (k1 + r2 * (k2 + r2 * k3)), 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y)


def undistort(x: Column, y: Column, k1: Column, k2: Column, k3: Column, p1: Column, p2: Column, steps: int = 32) -> Column:
    """struct(x, y) whose distortion is the given point: fixed-point steps, NULL where they don't get there."""

    def step(at: Column, _: Column) -> Column:
        radial, tx, ty = distortion(at["x"], at["y"], k1, k2, k3, p1, p2)
        ok = F.abs(radial) >= 1e-12
        return F.struct(F.when(ok, (x - tx) / radial).alias("x"), F.when(ok, (y - ty) / radial).alias("y"))

    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def checked(p: Column) -> Column:
        radial, tx, ty = distortion(p["x"], p["y"], k1, k2, k3, p1, p2)
        miss = F.hypot(p["x"] * radial + tx - x, p["y"] * radial + ty - y)
        return F.when(miss <= 2e-6 * (1 + F.hypot(x, y)), p)

    return F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)), checked)[0]


LENS = ("k1", "k2", "k3", "p1", "p2")


def camera_rays(views: DataFrame) -> DataFrame:
    """R2: rays of pinhole views (heading, pitch, roll, fx, fy, cx, cy), per horizontal metre.

    Views with a lens (k1, k2, k3, p1, p2) have their pixels undistorted first. A vertical
    or undefined ray has NULLs; without_bad_views() drops the view it belongs to.
    """
    pixels = dealt(views, "view_id").withColumns(camera_axes()).withColumn("px", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn(
        "py", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    u, v = (F.col("px") + 0.5 - F.col("cx")) / F.col("fx"), (F.col("py") + 0.5 - F.col("cy")) / F.col("fy")
    if set(LENS) <= set(views.columns):
        at = undistort(u, v, *map(F.col, LENS))
        pixels = pixels.withColumn("_at", at)
        u, v = F.col("_at.x"), F.col("_at.y")
    e, n, up = (F.col("f" + a) + u * F.col("r" + a) - v * F.col("u" + a) for a in "enu")
    length = F.hypot(e, n)
    ok = length > 1e-12
    return pixels.withColumns({"dx": F.when(ok, e / length), "dy": F.when(ok, n / length), "slope": F.when(ok, up / length)}).select(
        "view_id", "px", "py", "dx", "dy", "slope")


def without_bad_views(rays: DataFrame) -> DataFrame:
    """R2: rays of the views whose every ray is defined. A window, as a join would make all rays twice."""
    bad = F.count_if(F.col("slope").isNull()).over(Window.partitionBy("view_id"))
    return rays.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def pixel_footprint(rays: DataFrame) -> DataFrame:
    """The smallest angle between neighbouring pixels of each view."""
    def after(axis: str, step: str) -> DataFrame:
        nxt = rays.select("view_id", *[(F.col(c) - (1 if c == step else 0)).alias(c) for c in ("px", "py")], *[F.col(c).alias(c + "2") for c in ("dx", "dy", "slope")])
        return widened(rays).join(nxt, ["view_id", "px", "py"])

    both = after("x", "px").unionByName(after("y", "py"))
    l1, l2 = F.sqrt(1 + F.col("slope") ** 2), F.sqrt(1 + F.col("slope2") ** 2)
    chord = F.sqrt((F.col("dx") / l1 - F.col("dx2") / l2) ** 2 + (F.col("dy") / l1 - F.col("dy2") / l2) ** 2 + (F.col("slope") / l1 - F.col("slope2") / l2) ** 2)
    return both.groupBy("view_id").agg(F.min(2 * F.asin(chord / 2)).alias("footprint"))


def select_lod(distance: Column, footprint: Column, cell: Column, lods: int, scale: float) -> Column:
    """The coarsest level whose spacing a pixel still covers; the finer one at a tie; 1 if scale is 0."""
    ratio = scale * distance * footprint / cell
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(lods)), lambda k: (k == 1) | (ratio >= F.pow(F.lit(2.0), k - 1) * (1 + 4 * FLOAT_EPS))))


HALF_PI = math.pi / 2

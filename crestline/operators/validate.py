"""Checks: each returns the rows that break a rule, with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule whose condition is true."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(*key, F.explode(named).alias("rule"))


def check_sources(sources: DataFrame) -> DataFrame:
    """V1: one band, unrotated, square pixels, and in line with the first source (one broadcast row)."""
    first = sources.agg(F.min_by(F.struct("epsg", "res_x", "res_y", "registration", "unit", "x0", "y0"), "source_id").alias("f"))
    both = sources.crossJoin(F.broadcast(first))
    off = lambda a, b, r: F.abs((F.col(a) - F.col(b)) / r - F.rint((F.col(a) - F.col(b)) / r)) > 1e-6
    return violations(both, ["source_id"], {
        "bands": F.col("bands") != 1, "rotated": (F.col("skew_x") != 0) | (F.col("skew_y") != 0), "square": F.abs(F.abs("res_x") - F.abs("res_y")) > 1e-9,
        "crs": F.col("epsg") != F.col("f.epsg"), "resolution": (F.col("res_x") != F.col("f.res_x")) | (F.col("res_y") != F.col("f.res_y")),
        "registration": F.col("registration") != F.col("f.registration"), "unit": F.col("unit") != F.col("f.unit"),
        "alignment": off("x0", "f.x0", F.col("f.res_x")) | off("y0", "f.y0", F.col("f.res_y"))})


def check_manifest(manifest: DataFrame) -> DataFrame:
    """V4: finite bounds, min not above max, one row a tile."""
    counted = manifest.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trow", "tcol")))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return violations(counted, ["trow", "tcol"], {"bounds": bad("zmax") | (F.col("zmin").isNotNull() & bad("zmin")), "order": F.col("zmin") > F.col("zmax"), "duplicate": F.col("n") > 1})


def check_coverage(rects: DataFrame, cells: int) -> DataFrame:
    """V5: rectangles inside the tile and apart from each other. Rows of cells are lined up, so overlaps are neighbours."""
    c = {k: F.col(k) for k in ("column", "row", "width", "height")}
    out = rects.filter((c["column"] < 0) | (c["row"] < 0) | (c["width"] < 1) | (c["height"] < 1) | (c["column"] + c["width"] > cells) | (c["row"] + c["height"] > cells))
    rows = rects.filter("height > 0").withColumn("y", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("height") - 1)))
    line = Window.partitionBy("trow", "tcol", "y").orderBy("column").rowsBetween(Window.unboundedPreceding, -1)
    lapped = rows.withColumn("before", F.max(F.col("column") + F.col("width")).over(line)).filter("column < before").select("trow", "tcol").distinct()
    return out.select("trow", "tcol", F.lit("bounds").alias("rule")).distinct().unionByName(lapped.withColumn("rule", F.lit("overlap")))


def check_stack(datasets: DataFrame) -> DataFrame:
    """V6: unique datasets, the first one's cells, finite offsets."""
    first = datasets.agg(F.min_by("cells", "priority").alias("first_cells"))
    counted = datasets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dataset_id"))).crossJoin(F.broadcast(first))
    return violations(counted, ["dataset_id"], {"duplicate": F.col("n") > 1, "cells": F.col("cells") != F.col("first_cells"),
                                                "offset": F.col("vertical_offset_m").isNull() | F.isnan("vertical_offset_m") | (F.abs("vertical_offset_m") == float("inf"))})


def parse_tile_name(name: Column) -> tuple[Column, Column]:
    """V7: (row, column) of "..._rROW_cCOL.ext"; the last marks count; NULL where there are none."""
    pattern = r"^.*_r(-?[0-9]+)_c(-?[0-9]+)\.[^.]*$"
    return F.regexp_extract(name, pattern, 1).try_cast("bigint"), F.regexp_extract(name, pattern, 2).try_cast("bigint")


def misplaced(corner_x: Column, corner_y: Column, want_x: Column, want_y: Column, width: float) -> Column:
    """V8: a tile's corner off its place by more than a millionth of its width."""
    limit = 1e-6 * max(1.0, width)
    return (F.abs(corner_x - want_x) > limit) | (F.abs(corner_y - want_y) > limit)


def check_views(views: DataFrame) -> DataFrame:
    """V9: image sizes, finite angles, positive steps, field of view, focal length."""
    inf = float("inf")
    return violations(views, ["view_id"], {
        "image": (F.col("width") < 1) | (F.col("height") < 1), "angles": F.isnan("heading") | (F.abs("heading") == inf) | F.isnan("pitch") | (F.abs("pitch") == inf),
        "step": F.col("step") <= 0, "fov": (F.col("fov") <= 0) | (F.col("fov") >= 180), "focal": F.col("focal") <= 0, "range": (F.col("tmax") <= 0) | (F.col("tmax") > 1e12)})


def check_peaks(peaks: DataFrame) -> DataFrame:
    """Numbers finite, places in range, names not empty."""
    num = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return violations(peaks, ["peak_id"], {"number": num("elevation") | num("prominence"), "place": num("lat") | num("lon") | (F.abs("lat") > 90) | (F.abs("lon") > 180),
                                           "name": F.coalesce(F.trim("name"), F.lit("")) == ""})

"""Run logs: timer lines and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE = r"^( *)([^:]*[^ :]) *: ([0-9]+(?:\.[0-9]+)?) ms \((wall|work)\)$"


def parse_run_log(lines: DataFrame, indent: int = 2, levels: int = 4) -> DataFrame:
    """(run_id, line, path, ms, kind) of lines "name : 12.3 ms (wall)"; the indentation gives the path.

    lines: run_id, line, text. Other lines are left out. A run is one partition of the
    window, so runs are spread over tasks.
    """
    found = lines.filter(F.col("text").rlike(LINE)).select(
        "run_id", "line", (F.length(F.regexp_extract("text", LINE, 1)) / indent).cast("int").alias("depth"), F.regexp_extract("text", LINE, 2).alias("name"),
        F.regexp_extract("text", LINE, 3).cast("double").alias("ms"), F.regexp_extract("text", LINE, 4).alias("kind"))
    so_far = Window.partitionBy("run_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    above = [F.when(F.col("depth") > d, F.last(F.when(F.col("depth") == d, F.col("name")), ignorenulls=True).over(so_far)) for d in range(levels)]
    return found.withColumn("path", F.concat_ws("/", *above, F.col("name"))).select("run_id", "line", "path", "ms", "kind")


def summarise_runs(runs: DataFrame) -> DataFrame:
    """B1: medians of successful runs, all of them and those after the first repetition, by directory and cache size."""
    return runs.filter("ok").groupBy("directory", "cache_mib").agg(
        F.median("ms").alias("median_ms"), F.median(F.when(F.col("repetition") > 1, F.col("ms"))).alias("warm_ms"), F.count(F.lit(1)).alias("n_runs"))


def warm_quantiles(frames: DataFrame, skip: int) -> DataFrame:
    """B2: median and highest of the frames after the first `skip`."""
    return frames.filter(F.col("frame") >= skip).groupBy("run_id").agg(F.median("ms").alias("median_ms"), F.max("ms").alias("p95_ms"))

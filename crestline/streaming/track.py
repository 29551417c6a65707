"""Streams of positions: clearance over ground as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.points import track_clearance
from ..operators.tiles import Grid
from ..storage import scratch_path


def clearance_stream(positions: DataFrame, cells: DataFrame, grid: Grid, target: str, checkpoint: str, **options: float) -> StreamingQuery:
    """P10 on a stream: a stateless stream-static join on tile and cell, appended as Parquet; takes what there is, then ends."""
    flown = track_clearance(positions, cells, grid, **options)
    return flown.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_track_clearance(positions: DataFrame, cells: DataFrame, grid: Grid, **options: float) -> DataFrame:
    """The stream over a stored table of positions, read file by file; returns what was appended."""
    spark = positions.sparkSession
    source, target, checkpoint = (scratch_path(spark, x) for x in ("positions", "clearance", "stream"))
    positions.write.parquet(source)
    arriving = spark.readStream.schema(positions.schema).option("maxFilesPerTrigger", 64).parquet(source)
    clearance_stream(arriving, cells, grid, target, checkpoint, **options).awaitTermination()
    return spark.read.parquet(target)

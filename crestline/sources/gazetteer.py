"""Gazetteers of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = "Lat,Lon,Elevation,Prom,Name"
#: Four numbers, then a name, quoted or bare; a quote inside a bare name is a letter.
ROW = r'^([^,"]*),([^,"]*),([^,"]*),([^,"]*),(?:"((?:[^"]|"")*)"|([^",][^,]*|))$'


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(peak_id, lat, lon, elevation, prominence, name) of CSV files with exactly that header.

    Blank lines are skipped; any other line that is no row is an error. Ids are the
    order of the rows: rows in earlier files and partitions (a count for each) and the
    place in the own one, so no task sees more than its lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.filter((F.trim("value") != "") & (F.trim("value") != HEADER))
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    # one row a block of the input: small beside the lines
    before = counts.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = rows.withColumn("own", own).join(F.broadcast(before), ["file", "block"])
    part = lambda k: F.regexp_extract("value", ROW, k)
    name = F.when(part(5) != "", F.replace(part(5), F.lit('""'), F.lit('"'))).otherwise(part(6))
    bad = ~F.col("value").rlike(ROW)
    number = lambda k: F.when(bad, F.raise_error(F.concat(F.lit("no peak: "), "value")).cast("double")).otherwise(part(k).cast("double"))
    return numbered.select((F.col("before") + F.col("own")).alias("peak_id"), number(1).alias("lat"), number(2).alias("lon"), number(3).alias("elevation"), number(4).alias("prominence"), name.alias("name"))


def write_peaks(peaks: DataFrame, path: str) -> None:
    """The same as CSV text, one header a file."""
    quoted = F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.when(F.col("name").rlike('^"|[,]'), quoted).otherwise(F.col("name"))
    peaks.select(F.concat_ws(",", "lat", "lon", "elevation", "prominence", name).alias("value")).write.text(path)

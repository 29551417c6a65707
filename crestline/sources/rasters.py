"""Raster sources: discovery, SRTM and ASCII grids, decoded samples."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".tif", ".tiff", ".hgt", ".asc")
#: Samples along the side of the two SRTM sizes, by the bytes of the file.
HGT_SIDES = {1201 * 1201 * 2: 1201, 3601 * 3601 * 2: 3601}
HGT_VOID = -32768
SAMPLES = "source string, col long, row long, value double, mask int"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def discover_sources(spark: SparkSession, path: str, exclude: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(name, member, kind, source_id) of the rasters below a folder, in the order of their names, which is their priority.

    ASCII grids inside zip archives count, too; only archives are opened. exclude: a
    folder whose files are left out (the output).
    """
    found = _files(spark, path).select("path")
    if exclude:
        found = found.filter(~F.col("path").contains(exclude.rstrip("/") + "/"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    loose = found.filter(suffix.isin(*suffixes)).select("path", F.lit(None).cast("string").alias("member"), suffix.alias("kind"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(p, m, ".asc") for m in z.namelist() if m.lower().endswith(".asc")]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "member", "kind"])

    zips = _files(spark, path).filter(F.lower("path").endswith(".zip"))
    if exclude:
        zips = zips.filter(~F.col("path").contains(exclude.rstrip("/") + "/"))
    every = loose.unionByName(zips.select("path", "content").mapInArrow(members, "path string, member string, kind string"))
    name = F.concat_ws("/", F.regexp_extract("path", r"([^/]+)$", 1), "member")
    # a catalogue of files, small beside what they hold: ranked by range-partitioned sorting on the name
    return every.select(name.alias("name"), "path", "member", "kind").orderBy("name", "path")


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """Samples of SRTM files (big-endian int16, side by size, -32768 void), with the south-west degree of the file's name.

    One task decodes one file at a time and hands on a row at a time of the raster.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name = p.rsplit("/", 1)[-1]
                m = re.match(r"([NSns])(\d{2})([EWew])(\d{3})", name)
                raw = content.as_buffer()
                if m is None or raw.size not in HGT_SIDES:
                    raise ValueError(f"{name}: no SRTM grid")
                n = HGT_SIDES[raw.size]
                grid = np.frombuffer(raw, ">i2").reshape(n, n)
                lat = int(m[2]) * (-1 if m[1] in "Ss" else 1)
                lon = int(m[4]) * (-1 if m[3] in "Ww" else 1)
                for row in range(n):
                    z = grid[row].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * n), pa.array(np.full(n, lat, np.int32)), pa.array(np.full(n, lon, np.int32)), pa.array(np.arange(n, dtype=np.int64)),
                        pa.array(np.full(n, row, np.int64)), pa.array(z), pa.array((z != HGT_VOID).astype(np.int32))], names=["source", "lat", "lon", "col", "row", "value", "mask"])

    return _files(spark, path).filter(F.lower("path").endswith(".hgt")).select("path", "content").mapInArrow(decode, "source string, lat int, lon int, col long, row long, value double, mask int")


NUMBER = r"([-+0-9.eE]+)"
HEADER = r"^\s*[A-Za-z_]+\s+" + NUMBER + r"\s*$"
#: Names of a grid's header and what they are here; fixed values of the format.
HEADS = {"ncols": "ncols", "xll(?:corner|center)": "x0", "yll(?:corner|center)": "y0", "cellsize": "cell", "nodata_value": "no_data"}


def _heads(line: str) -> list[Column]:
    """Of a file's lines: what its header says."""
    def head(key: str) -> Column:
        return F.max(F.nullif(F.regexp_extract(line, r"(?i)^\s*" + key + r"\s+" + NUMBER, 1), F.lit("")).try_cast("double"))

    return [head(key).alias(name) for key, name in HEADS.items()]


def read_asc(spark: SparkSession, path: str, glob: str = "*.asc") -> DataFrame:
    """S3: samples of Arc/Info ASCII grids, with their header: source, x0, y0, cell, no_data, col, row, value.

    Files are read line by line and split by Spark, so a grid may have any size. A sample's place is its
    number among the file's values, wherever lines break: values are counted by split, splits are
    numbered on, and a line's own are counted within its split. Columns of a partitioned folder are kept.
    """
    lines = spark.read.text(path, pathGlobFilter=glob)
    extra = [c for c in lines.columns if c != "value"]
    lines = lines.select(*extra, F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    is_head = F.col("line").rlike(HEADER) & F.col("line").rlike(r"^\s*[A-Za-z]")
    heads = lines.filter(is_head).groupBy("file").agg(*_heads("line"))
    own = F.filter(F.split(F.btrim("line", F.lit(" \t\r\n")), r"\s+"), lambda v: v != "")
    rows = lines.filter(~is_head).select(*extra, "file", "block", "at", own.alias("values"))
    counts = rows.groupBy("file", "block").agg(F.sum(F.size("values")).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")).join(heads, "file")
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum(F.size("values")).over(inside), F.lit(0))).join(begins, ["file", "block"])
    every = placed.select("*", F.posexplode("values").alias("i", "v"))
    return _sampled(every, extra, F.regexp_extract("file", r"([^/]+)$", 1), F.col("begin") + F.col("_before") + F.col("i"))


def _sampled(every: DataFrame, extra: list[str], source: Column, place: Column) -> DataFrame:
    return every.select(source.alias("source"), *extra, "x0", "y0", "cell", "no_data", (place % F.col("ncols")).cast("long").alias("col"),
                        F.floor(place / F.col("ncols")).alias("row"), F.col("v").cast("double").alias("value"))


def read_zipped_asc(spark: SparkSession, path: str) -> DataFrame:
    """S3 for the ASCII grids inside zip archives: source, member and read_asc()'s columns.

    An archive is unpacked by one task, a line at a time; a member is never held whole.
    """
    number = re.compile(HEADER)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for member in z.namelist():
                        if member.lower().endswith(".asc"):
                            yield from of_member(p.rsplit("/", 1)[-1], member, z)

    def of_member(source: str, member: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        head: dict[str, float] = {}
        begin, held = 0, []

        def out() -> pa.RecordBatch:
            n = len(held)
            columns = [pa.array([source] * n), pa.array([member] * n), *[pa.array([head.get(c)] * n, pa.float64()) for c in HEADS.values()],
                       pa.array([b for b, _ in held], pa.int64()), pa.array([v for _, v in held], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["source", "member", *HEADS.values(), "begin", "values"])

        with z.open(member) as f:
            for line in io.TextIOWrapper(f, "utf-8", errors="replace"):
                if number.match(line):
                    for key, name in HEADS.items():
                        if m := re.match(r"\s*" + key + r"\s+" + NUMBER, line, re.IGNORECASE):
                            head[name] = float(m[1])
                elif values := line.split():
                    held.append((begin, values))
                    begin += len(values)
                if len(held) >= 256:
                    yield out()
                    held.clear()
        if held:
            yield out()

    zips = _files(spark, path).filter(F.lower("path").endswith(".zip")).select("path", "content")
    kinds = "source string, member string, " + ", ".join(f"{c} double" for c in HEADS.values()) + ", begin long, values array<string>"
    every = zips.mapInArrow(lines, kinds).select("*", F.posexplode("values").alias("i", "v"))
    return _sampled(every, ["member"], F.col("source"), F.col("begin") + F.col("i"))


def epsg_from_gml(text: Column) -> Column:
    """The one EPSG number a sidecar's urns agree on; an error where they differ or there is none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"urn:ogc:def:crs:EPSG::(\d+)"), 1))
    return F.when(F.size(found) == 1, found[0].cast("int")).otherwise(F.raise_error(F.lit("no single EPSG number")).cast("int"))


def read_dem_samples(spark: SparkSession, path: str) -> DataFrame:
    """Rasters that are decoded already: source, col, row, value, mask."""
    return spark.read.schema(SAMPLES).parquet(path)

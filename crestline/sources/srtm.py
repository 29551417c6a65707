"""SRTM files (.hgt) as a Spark data source: a partition reads one file, a task writes whole files.

    spark.dataSource.register(SrtmSource)
    spark.read.format("srtm").load(folder)
    samples.repartition("lat", "lon").write.format("srtm").mode("append").save(folder)

Files are reached through pyarrow's file systems, so a folder is a path or a URL that they
know; read_hgt() in rasters.py reads what only Spark's own readers reach.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .rasters import HGT_SIDES, HGT_VOID

SCHEMA = "source string, lat int, lon int, col long, row long, value double, mask int"
NAME = re.compile(r"([NSns])(\d{2})([EWew])(\d{3})\.hgt$", re.IGNORECASE)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    if re.match(r"file:/*", path):
        path = "/" + re.sub(r"^file:/*", "", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def file_name(lat: int, lon: int) -> str:
    return f"{'S' if lat < 0 else 'N'}{abs(lat):02d}{'W' if lon < 0 else 'E'}{abs(lon):03d}.hgt"


def corner_of(name: str) -> tuple[int, int]:
    m = NAME.search(name)
    if m is None:
        raise ValueError(f"{name}: no SRTM grid")
    return int(m[2]) * (-1 if m[1] in "Ss" else 1), int(m[4]) * (-1 if m[3] in "Ww" else 1)


@dataclass
class FilePartition(InputPartition):
    path: str


class SrtmReader(DataSourceReader):
    """Samples row by row of the raster; with option voids = false without those that are void."""

    def __init__(self, options: dict):
        self.folder, self.voids = options["path"], str(options.get("voids", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        system, path = open_folder(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(".hgt")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = open_folder(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        lat, lon = corner_of(name)
        with system.open_input_stream(partition.path) as f:
            raw = f.read()
        if len(raw) not in HGT_SIDES:
            raise ValueError(f"{name}: no SRTM grid")
        n = HGT_SIDES[len(raw)]
        grid = np.frombuffer(raw, ">i2").reshape(n, n)
        for row in range(n):
            col = np.arange(n) if self.voids else np.flatnonzero(grid[row] != HGT_VOID)
            if len(col):
                z = grid[row, col].astype(np.float64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(col)), pa.array(np.full(len(col), lat, np.int32)), pa.array(np.full(len(col), lon, np.int32)), pa.array(col.astype(np.int64)),
                    pa.array(np.full(len(col), row, np.int64)), pa.array(z), pa.array((z != HGT_VOID).astype(np.int32))], names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: the names they have now and get at the commit."""

    files: list[tuple[str, str]]


class SrtmWriter(DataSourceWriter):
    """Rows (lat, lon, col, row, value) to files; all rows of a file come to one task. What has no row or value is void.

    Files get their names when all tasks are done; a task that is run again leaves none of its first run.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.side, self.overwrite = options["path"], int(options.get("side", 1201)), overwrite
        if self.side not in HGT_SIDES.values():
            raise ValueError(f"SRTM grids have {' or '.join(map(str, HGT_SIDES.values()))} samples a side")

    def write(self, rows: Iterator[Row]) -> Written:
        system, path = open_folder(self.folder)
        system.create_dir(path, recursive=True)
        grids: dict[tuple[int, int], np.ndarray] = {}
        files = []

        def store() -> None:
            for (lat, lon), grid in grids.items():
                name = file_name(lat, lon)
                draft = f"{path}/_{uuid.uuid4().hex}.draft"
                with system.open_output_stream(draft) as f:
                    f.write(grid.tobytes())
                files.append((draft, f"{path}/{name}"))
            grids.clear()

        done: set[tuple[int, int]] = set()
        for r in rows:
            key = (r["lat"], r["lon"])
            if key not in grids:
                store()  # sorted by file, a task holds one grid at a time
                if key in done:
                    raise ValueError("rows of one file must come together")
                done.add(key)
                grids[key] = np.full((self.side, self.side), HGT_VOID, ">i2")
            if r["value"] is not None:
                if not (0 <= r["row"] < self.side and 0 <= r["col"] < self.side) or not -32767 <= round(r["value"]) <= 32767:
                    raise ValueError(f"{file_name(*key)} can't hold {r}")
                grids[key][r["row"], r["col"]] = round(r["value"])
        store()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = open_folder(self.folder)
        named = [f for m in messages if m is not None for f in m.files]
        targets = [t for _, t in named]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("a file was written by two tasks")
        for draft, target in named:
            system.move(draft, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = open_folder(self.folder)
        for m in messages:
            for draft, _ in m.files if m is not None else []:
                system.delete_file(draft)


class SrtmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srtm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SrtmReader:
        return SrtmReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SrtmWriter:
        return SrtmWriter(self.options, overwrite)


def write_hgt(samples: DataFrame, path: str, side: int = 1201) -> None:
    """S2, outward: samples (lat, lon of the south-west corner, col, row from the north, value) to a file for each degree."""
    samples.sparkSession.dataSource.register(SrtmSource)
    rows = samples.select("lat", "lon", "col", "row", "value").repartition("lat", "lon").sortWithinPartitions("lat", "lon")
    rows.write.format("srtm").option("side", side).mode("append").save(path)


def read_srtm(spark: SparkSession, path: str, voids: bool = True) -> DataFrame:
    """Samples of all SRTM files below a folder, one partition a file."""
    spark.dataSource.register(SrtmSource)
    return spark.read.format("srtm").option("voids", str(voids).lower()).load(path)

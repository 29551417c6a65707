"""Terrain tables made from the driver's tables, in Spark and as SQL fragments.

lineitem gives raster samples (several sources overlap, voids occur by themselves):
col = l_orderkey % n, row = l_partkey % n, source = l_suppkey, value = l_extendedprice / 50,
masked out where l_quantity < 3. n grows with the table, so that a vertex has about four samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles
from .registry import table

#: Cells along a tile's side, and the grid they lie on.
CELLS = 16
GRID = tiles.Grid(2600000.0, 1200000.0, 10.0, CELLS)
RANK = ["source_id", "o", "l", "z"]


def side(spark: SparkSession, sf_dir: str) -> int:
    """Vertices along the square's side; the count comes from Parquet's footers."""
    return max(1, round((table(spark, sf_dir, "lineitem").count() / 4) ** 0.5 / 32)) * 32


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = side(spark, sf_dir)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), (F.col("l_orderkey") % n).alias("col"), (F.col("l_partkey") % n).alias("row"),
        (F.col("l_extendedprice") / 50).alias("value"), F.when(F.col("l_quantity") < 3, 0).otherwise(1).alias("mask"),
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))


def valid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter(tiles.valid_sample(F.col("value"), F.lit(None).cast("double"), F.col("mask"))).withColumnRenamed("value", "z")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.mosaic(valid_samples(spark, sf_dir), RANK)


def in_square(placed: DataFrame, n: int) -> DataFrame:
    """Without windows that reach over the square's edge, which would be strips without cells."""
    return placed.filter(F.col("tcol").between(0, (n - 1) // CELLS) & F.col("trow").between(0, (n - 1) // CELLS))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trow, tcol, y, x, z, col, row) of the mosaic in tiles of CELLS cells."""
    return in_square(tiles.assign_tiles(mosaic(spark, sf_dir), CELLS), side(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.usable_cells(vertices(spark, sf_dir))


def tiles_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each tile with its heights and index: see folder_tiles()."""
    return tiles.folder_tiles(valid_samples(spark, sf_dir).filter("col >= 0 and row >= 0"), RANK, CELLS)


GRID_SQL = "g AS (SELECT greatest(1, round(sqrt(count(*) / 4.0) / 32))::BIGINT * 32 AS n FROM lineitem)"
SAMPLES_SQL = GRID_SQL + """,
s AS (SELECT l_suppkey AS source_id, l_orderkey % n AS col, l_partkey % n AS row, l_extendedprice / 50 AS value,
  CASE WHEN l_quantity < 3 THEN 0 ELSE 1 END AS mask, l_orderkey AS o, l_linenumber AS l, n FROM lineitem, g)"""
MOSAIC_SQL = SAMPLES_SQL + """,
m AS (SELECT col, row, value AS z, n FROM (
  SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY source_id, o, l, value) AS k FROM s WHERE mask <> 0) WHERE k = 1)"""
VERTICES_SQL = MOSAIC_SQL + """,
v AS (SELECT tcol, trow, (col - tcol * 16)::INT AS x, (16 - (row - trow * 16))::INT AS y, z, col, row FROM (
  SELECT m.*, col // 16 - dc AS tcol, row // 16 - dr AS trow FROM m, (SELECT unnest([0, 1]) AS dc) a, (SELECT unnest([0, 1]) AS dr) b
  WHERE (dc = 0 OR col % 16 = 0) AND (dr = 0 OR row % 16 = 0))
  WHERE tcol BETWEEN 0 AND (n - 1) // 16 AND trow BETWEEN 0 AND (n - 1) // 16)"""
# a vertex is a corner of four cells: one aggregation, no self join
CELLS_SQL = VERTICES_SQL + """,
c AS MATERIALIZED (SELECT trow, tcol, y, x, max(z) FILTER (k = 0) AS z00, max(z) FILTER (k = 1) AS z01, max(z) FILTER (k = 2) AS z10, max(z) FILTER (k = 3) AS z11, max(z) AS zmax
  FROM (SELECT trow, tcol, y - k // 2 AS y, x - k % 2 AS x, z, k FROM (SELECT v.*, unnest([0, 1, 2, 3]) AS k FROM v))
  GROUP BY trow, tcol, y, x HAVING count(z) = 4)"""

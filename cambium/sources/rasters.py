"""Rasters as tables: mosaics, gap years, alignment, missing work and the product catalogue."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Product:
    """A raster product: type and missing value of its table, tiles that make up a raster, years (none: unchanging)."""

    name: str
    kind: str
    nodata: float | None
    expected_tiles: int
    years: tuple[int, ...] = ()
    gap_years: tuple[int, ...] = ()


_YEARS = tuple(range(1986, 2025))
#: Years for which burn severity has no data and is filled with 0.
GAP_YEARS = (2023, 2024)
# Fixed values. Burn severity has 0 for missing, which is no severity too: its zeros stay.
PRODUCTS = (
    Product("tree_cover", "smallint", 255, 4, _YEARS),
    Product("fire_severity", "tinyint", None, 4, _YEARS[:-2], GAP_YEARS),
    Product("spei", "float", -9999, 12, _YEARS),
    Product("spei1y", "float", -9999, 12, _YEARS),
    Product("elevation", "float", -9999, 12),
    Product("chili", "float", -9999, 12),
    Product("aridity", "float", -9999, 30),
    Product("mask", "smallint", 255, 4),
)


def mosaic_plan(tiles: DataFrame, existing: DataFrame, products: tuple[Product, ...] = PRODUCTS, force: bool = False) -> DataFrame:
    """(product, year, action) of the rasters to be made, from tiles (product, year, file) and existing rasters (product, year).

    A raster that is there is left alone unless `force`. One is made (`mosaic`) if all expected tiles are there; an
    incomplete set is skipped. A gap year is filled (`zero_fill`) if there is a raster of a real year, or will be, to
    take the grid from. Unchanging products have a null year.
    """
    spark = tiles.sparkSession
    rows = [(p.name, y, p.expected_tiles, y in p.gap_years) for p in products for y in (*p.years, *p.gap_years) or (None,)]  # the catalogue: some hundred rows
    wanted = spark.createDataFrame(rows, "product string, year int, expected int, gap boolean")
    same = lambda a, b: (F.col(f"{a}.product") == F.col(f"{b}.product")) & F.col(f"{a}.year").eqNullSafe(F.col(f"{b}.year"))
    found = tiles.groupBy("product", "year").agg(F.countDistinct("file").alias("n"))
    there = existing.select("product", "year").distinct().withColumn("there", F.lit(True))
    each = wanted.alias("w").join(found.alias("f"), same("w", "f"), "left").join(there.alias("t"), same("w", "t"), "left")
    kept = F.coalesce("there", F.lit(False)) & ~F.lit(force)
    each = each.select("w.product", "w.year", "gap", kept.alias("kept"), (~kept & ~F.col("gap") & (F.coalesce("n", F.lit(0)) >= F.col("expected"))).alias("make"))
    real = each.groupBy("product").agg(F.bool_or(~F.col("gap") & (F.col("kept") | F.col("make"))).alias("real"))
    return each.join(real, "product").where(F.col("make") | (F.col("gap") & ~F.col("kept") & F.col("real"))).select("product", "year", F.when(F.col("gap"), "zero_fill").otherwise("mosaic").alias("action"))


def discover(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file) of a folder in order, by Spark's own listing, so in any store."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file")).orderBy("file")


def mosaic(parts: Iterable[DataFrame], keys: tuple[str, ...] = ("r", "c", "year"), value: str = "value") -> DataFrame:
    """One value a cell of overlapping tiles: the largest that isn't null. One partial and final aggregation."""
    every = reduce(DataFrame.unionByName, [p.select(*keys, value) for p in parts])
    return every.groupBy(*keys).agg(F.max(value).alias(value))


def zero_filled(cells: DataFrame, years: tuple[int, ...], value: str) -> DataFrame:
    """Rows of 0 for gap years, made from the cells of a real year without a join."""
    return cells.withColumn("year", F.explode(F.array(*map(F.lit, years)))).withColumn(value, F.lit(0))


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Partitions still to be made; all of them if `force`."""
    return wanted if force else wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def alignment(grids: DataFrame, reference: DataFrame) -> DataFrame:
    """(grid_id, aligned): whether reference system, transform and shape equal the one-row reference grid's."""
    names = ("crs", "x0", "y0", "dx", "dy", "width", "height")
    ref = F.broadcast(reference.limit(1).select(*[F.col(n).alias(f"ref_{n}") for n in names]))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"ref_{n}")) for n in names])
    return grids.join(ref).select("grid_id", same.alias("aligned"))


def resampled(cells: DataFrame, scale_r: float, scale_c: float, off_r: float, off_c: float, height: int, width: int, value: str = "value") -> DataFrame:
    """X8 within one reference system: bilinear values on another grid, row = scale_r * r + off_r of the source.

    Each target cell asks for its four neighbours (an equi-join on the source cell), weighted by distance; neighbours
    that are missing or beyond the edge give their weight to the others.
    """
    spark = cells.sparkSession
    t = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    t = t.withColumn("y", F.col("r") * scale_r + off_r).withColumn("x", F.col("c") * scale_c + off_c)
    near = F.array(*[F.struct((F.floor("y") + i).cast("int").alias("sr"), (F.floor("x") + j).cast("int").alias("sc"), ((F.lit(1.0) - F.abs(F.col("y") - F.floor("y") - i)) * (F.lit(1.0) - F.abs(F.col("x") - F.floor("x") - j))).alias("w")) for i in (0, 1) for j in (0, 1)])
    asked = t.select("r", "c", F.explode(near).alias("n")).select("r", "c", "n.sr", "n.sc", "n.w").where("w > 0")
    source = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("v")).where("v is not null")
    return asked.join(source, ["sr", "sc"]).groupBy("r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))


def window(raster: DataFrame, row_off: int, col_off: int, height: int, width: int, value: str = "value", absent=0) -> DataFrame:
    """A window of a raster table (r, c, value), dense: cells that the table lacks are `absent`.

    The range filter on r and c reaches the Parquet scan.
    """
    inside = raster.where(F.col("r").between(row_off, row_off + height - 1) & F.col("c").between(col_off, col_off + width - 1))
    frame = raster.sparkSession.range(height * width).select((F.floor(F.col("id") / width) + row_off).cast("int").alias("r"), (F.col("id") % width + col_off).cast("int").alias("c"))
    return frame.join(inside.select("r", "c", value), ["r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(absent)))

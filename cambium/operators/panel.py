"""Panels, masks, tiles and samples (S1-S5, S12, P1-P4, X1): declarative, one row a cell or a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def series(panel: DataFrame, length: int, keys: tuple[str, ...] = ("pid",), t: str = "t", value: str = "pct", absent: int | None = None, kind: str = "smallint", name: str = "pct") -> DataFrame:
    """Long panel (keys, t, value) -> (keys, pct array<smallint>) of `length` steps in order; steps without a row are `absent`.

    One shuffle on the keys; a series is one row, so that everything over time is narrow afterwards. If a step has
    several rows, the largest value counts: rows of a key are sorted by (t, value), and a step takes its last.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(t).cast("int").alias("t"), F.col(value).cast(kind).alias("v"))))
    last = F.filter("_rows", lambda x, i: F.coalesce(F.get("_rows", i + 1)["t"] != x["t"], F.lit(True)))
    at = lambda i: F.try_element_at(F.col("_points"), i.cast("int"))
    filled = (lambda i: F.coalesce(at(i), F.lit(absent).cast(kind))) if absent is not None else at
    each = panel.where(F.col(t).between(0, length - 1)).groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.map_from_entries(last).alias("_points"))
    return each.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), filled).alias(name))


def long(frame: DataFrame, column: str, name: str, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """The inverse: one row a step, t from 0."""
    return frame.select(*keys, F.posexplode(column).alias("t", name))


def valid(mask: Column, strict: bool = False) -> Column:
    """Which mask values count as valid. 255 is missing unless strict; null never is valid."""
    inside = mask > 0 if strict else (mask > 0) & (mask != 255)
    return F.coalesce(inside, F.lit(False))


def grid_offset(grid: DataFrame, reference: DataFrame) -> DataFrame:
    """Whole cells (row_off, col_off) between grids (grid_id, x0, y0, dx, dy) and the one-row reference grid."""
    ref = reference.limit(1).select(F.col("x0").alias("rx"), F.col("y0").alias("ry"), F.col("dx").alias("rdx"), F.col("dy").alias("rdy"))
    joined = grid.join(F.broadcast(ref))
    return joined.select("grid_id", F.round((F.col("y0") - F.col("ry")) / F.col("rdy")).cast("int").alias("row_off"), F.round((F.col("x0") - F.col("rx")) / F.col("rdx")).cast("int").alias("col_off"))


def tile_columns(width: int, size: int, row: str = "r", col: str = "c") -> Column:
    """Row-major number of the tile that a cell is in; numbers don't depend on which tiles are kept."""
    across = -(-width // size)
    return (F.floor(F.col(row) / size) * across + F.floor(F.col(col) / size)).cast("int")


def tiles(spark: SparkSession, height: int, width: int, size: int) -> DataFrame:
    """(tile_id, row_off, col_off, height, width, n_pixels) of a grid, row by row, edge tiles clipped."""
    across, down = -(-width // size), -(-height // size)
    t = spark.range(across * down).select(F.col("id").cast("int").alias("tile_id"))
    t = t.withColumn("row_off", (F.floor(F.col("tile_id") / across) * size).cast("int")).withColumn("col_off", (F.col("tile_id") % across * size).cast("int"))
    t = t.withColumn("height", F.least(F.lit(size), F.lit(height) - F.col("row_off"))).withColumn("width", F.least(F.lit(size), F.lit(width) - F.col("col_off")))
    return t.withColumn("n_pixels", F.col("height") * F.col("width"))


def kept_tiles(cells: DataFrame, share: float = 0.01, strict: bool = False, tile: str = "tile_id") -> DataFrame:
    """Tiles of which at least `share` of all cells are valid. One partial and final aggregation."""
    return cells.groupBy(tile).agg(F.count("*").alias("n_cells"), F.count_if(valid(F.col("mask"), strict)).alias("n_valid")).where(F.col("n_valid") >= share * F.col("n_cells"))


def masked(cells: DataFrame, tiles_kept: DataFrame, strict: bool = False, tile: str = "tile_id") -> DataFrame:
    """Valid cells of kept tiles; the list of tiles is small only in small grids, so Spark chooses the join."""
    return cells.where(valid(F.col("mask"), strict)).join(tiles_kept.select(tile), tile, "left_semi")


def sample(cells: DataFrame, n: int, n_tiles: int = 200, seed: int = 42, tile: str = "tile_id", pid: str = "pid") -> DataFrame:
    """N cells at most, spread over `n_tiles` tiles at most, chosen by hash: the same whatever the partitioning.

    Tiles and cells are ordered by md5(id:seed); each chosen tile gives n // tiles + 1 cells, and the n first of them by
    hash stay. A tile's cells are ranked within the tile (bounded by the tile size); the tiles and the final n are
    top-n sorts, so no full sort and no gathering.
    """
    order = lambda c: F.md5(F.concat_ws(":", F.col(c).cast("string"), F.lit(str(seed))))
    chosen = cells.select(tile).distinct().orderBy(order(tile), tile).limit(n_tiles)
    count = max(1, chosen.count())
    in_tile = Window.partitionBy(tile).orderBy(order(pid), pid)
    ranked = cells.join(F.broadcast(chosen), tile, "left_semi").withColumn("_rank", F.row_number().over(in_tile)).where(F.col("_rank") <= n // count + 1).drop("_rank")
    return ranked.orderBy(order(pid), pid).limit(n)

"""The tile store and the output tables (S17-S20, K1-K10, D14, D15): Parquet by tile, a manifest, assembled products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.config import PipelineConfig
from cambium.operators import panel, products


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, by Spark's own file systems, so in any store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def validate_inputs(spark: SparkSession, config: PipelineConfig) -> None:
    """Raises FileNotFoundError for a missing mask, cover table or enabled covariate, or a year without cover."""
    wanted = {"mask": config.io.path("mask"), "tree_cover": config.io.path("tree_cover"), **config.io.covariate_paths(config.covariates)}
    for name, path in wanted.items():
        if not exists(spark, path):
            raise FileNotFoundError(f"{name}: {path}")
    have = {r[0] for r in spark.read.parquet(config.io.path("tree_cover")).select("year").distinct().collect()}  # a row a year
    if gone := sorted(set(config.io.years) - have):
        raise FileNotFoundError(f"tree_cover has no rows for {gone}")


def read_cells(spark: SparkSession, config: PipelineConfig, name: str) -> DataFrame:
    """An input table with r and c moved onto the grid of the mask.

    Where grids differ, the table `grids` (grid_id, x0, y0, dx, dy), if there, has the origin and cell of each table by
    its name; a table that it doesn't name lies on the mask's grid.
    """
    cells = spark.read.parquet(config.io.path(name))
    if name == "mask" or not exists(spark, config.io.path("grids")):
        return cells
    grids = spark.read.parquet(config.io.path("grids"))
    moved = panel.grid_offset(grids.where(F.col("grid_id") == name), grids.where("grid_id = 'mask'")).first()  # one row
    return cells if moved is None else cells.withColumns({"r": F.col("r") + moved["row_off"], "c": F.col("c") + moved["col_off"]})


def grid_cells(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    """(pid, tile_id, r, c, valid) of all cells, valid or not, of kept tiles, from the table mask(r, c, mask).

    The width of the grid, by which cells and tiles are numbered, is that of the table `grids` if it has one.
    """
    mask = spark.read.parquet(config.io.path("mask"))
    width = None
    if exists(spark, config.io.path("grids")):
        row = spark.read.parquet(config.io.path("grids")).where("grid_id = 'mask'").first()
        width = row.asDict().get("width") if row else None
    width = width or mask.agg(F.max("c")).first()[0] + 1
    size, strict = config.inference.tile_size, config.inference.strict
    cells = mask.withColumn("tile_id", panel.tile_columns(width, size)).withColumn("pid", F.col("r").cast("bigint") * width + F.col("c"))
    kept = panel.kept_tiles(cells, config.inference.min_valid, strict)
    return cells.join(kept.select("tile_id"), "tile_id", "left_semi").select("pid", "tile_id", "r", "c", panel.valid(F.col("mask"), strict).alias("valid"))


def cover_series(spark: SparkSession, config: PipelineConfig, cells: DataFrame | None = None) -> DataFrame:
    """(pid, tile_id, r, c, pct) of the valid cells of kept tiles, or of the given cells, from tree_cover(r, c, year, pct)."""
    inside = grid_cells(spark, config).where("valid").drop("valid") if cells is None else cells
    years = config.io.years
    cover = read_cells(spark, config, "tree_cover").where(F.col("year").between(years[0], years[-1]))
    rows = cover.select("r", "c", (F.col("year") - years[0]).alias("t"), "pct").join(inside, ["r", "c"])
    return panel.series(rows, len(years), tuple(inside.columns), absent=0 if config.inference.strict else None)


def write_tiles(series: DataFrame, path: str, config: PipelineConfig) -> None:
    """K5, K6: the chunk store: series in files by tile, sorted, and a manifest of the tiles (D14), made from what was written."""
    series.repartition("tile_id").sortWithinPartitions("tile_id", "r", "c").write.mode("overwrite").parquet(f"{path}/tiles")
    written = series.sparkSession.read.parquet(f"{path}/tiles")
    manifest = written.groupBy("tile_id").agg(F.count("*").alias("n_pixels"), F.min("r").alias("row_off"), F.min("c").alias("col_off"), (F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"))
    manifest.withColumns({"first_year": F.lit(config.io.first_year), "last_year": F.lit(config.io.last_year)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_tiles(spark: SparkSession, path: str, tiles: list[int] | None = None) -> DataFrame:
    """The stored series; a choice of tiles prunes row groups by their statistics. Missing tiles have no rows."""
    stored = spark.read.parquet(f"{path}/tiles")
    return stored if tiles is None else stored.where(F.col("tile_id").isin(tiles))


#: Cells of one output file (about): files of a year are dealt by a hash of the cell.
FILE_CELLS = 1 << 24


def write_outputs(decoded: DataFrame, path: str, first_year: int) -> None:
    """K1, K3, K4, K7, K8: products by cell, states and posteriors (if decoded) by year, with the codes for missing.

    decoded: pid, r, c, states and perhaps posterior_q. Read twice or three times: write or cache it before. A year is
    split over as many tasks as its cells need, each of which writes one file of it.
    """
    keys = ["pid", "r", "c"]
    parts = max(1, -(-decoded.count() // FILE_CELLS))
    years = decoded.select(F.size("states")).limit(1).collect()

    def by_year(column: str, name: str) -> DataFrame:
        each = decoded.select(*keys, F.posexplode(column).alias("t", name)).withColumn("year", F.col("t") + first_year).drop("t")
        return each.repartition(max(1, parts * (years[0][0] if years else 1)), "year", F.pmod(F.xxhash64("pid"), F.lit(parts)))

    products.at_sink(products.products(decoded.select(*keys, "states"), first_year)).write.mode("overwrite").parquet(f"{path}/products")
    products.at_sink(by_year("states", "state")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/states")
    if "posterior_q" in decoded.columns:
        by_year("posterior_q", "posterior").write.mode("overwrite").partitionBy("year").parquet(f"{path}/posteriors")


def write_summary(decoded: DataFrame, path: str, n_states: int, first_year: int) -> None:
    """Both summaries as JSON."""
    for name, frame in products.summary(decoded, n_states, first_year).items():
        frame.coalesce(1).write.mode("overwrite").json(f"{path}/summary/{name}")

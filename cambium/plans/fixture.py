"""The panel, grid and covariates that the queries run on, made from the star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.config import CovariateConfig
from cambium.operators import covariates as cov
from cambium.operators import panel

DAYS, WIDTH, TILE, ORIGIN = 30, 15, 4, "2024-01-01"
#: Feature weights of dynamic transitions, (i, target, d), target != i.
WEIGHTS = np.array([[[((7 * i + 3 * j + d) % 11 - 5) / 50.0 for d in range(6)] for j in range(6) if j != i] for i in range(6)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, t, cents, errors) of users' days with events."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.datediff("ts", F.lit(ORIGIN)).alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("c"), "event_type")
    return events.groupBy("pid", "t").agg(F.sum("c").alias("cents"), F.count_if(F.col("event_type") == "error").alias("errors"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.col("pid") % 12
    return daily(spark, sf_dir).select("pid", "t", F.least(F.lit(100), F.expr("cents div (400 * (1 + (pid % 12) * (pid % 12)))")).cast("int").alias("pct")).where(spread.isNotNull())


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, pct array<smallint>), days without events being 0."""
    return panel.series(observed(spark, sf_dir), DAYS, absent=0)


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.long(user_series(spark, sf_dir), "pct", "pct").select("pid", F.col("t").cast("int").alias("t"), F.col("pct").cast("int").alias("pct"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, r, c, mask, tile_id)."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid")).distinct()
    mask = F.when(F.col("pid") % 7 == 3, 0).when(F.col("pid") % 50 == 49, 255).otherwise(1)
    grid = users.select("pid", F.floor(F.col("pid") / WIDTH).cast("int").alias("r"), (F.col("pid") % WIDTH).cast("int").alias("c"), mask.alias("mask"))
    return grid.withColumn("tile_id", panel.tile_columns(WIDTH, TILE))


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, t, r, c, tile_id, x) of every cell and day."""
    return user_panel(spark, sf_dir).select("pid", "t", F.least(F.col("pct") / 100.0, F.lit(0.999)).alias("x")).join(cells(spark, sf_dir).drop("mask"), "pid")


def covariate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, t, fire_severity, spei, elevation, chili, aridity), a row for each user and day."""
    d = daily(spark, sf_dir)
    fire = d.select("pid", "t", F.least(F.lit(4), "errors").cast("int").alias("fire_severity"))
    cents = d.select("pid", "t", "cents")
    rows = user_panel(spark, sf_dir).select("pid", "t")
    rows = cov.with_yearly(cov.with_yearly(rows, fire, "fire_severity"), cents, "cents")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal").cast("double")).alias("elevation"))
    rows = cov.with_static(rows, customers)
    return rows.select("pid", "t", "fire_severity", (F.col("cents") % 600 / 100.0 - 3).alias("spei"), "elevation", ((F.col("pid") % 13) / 13.0).alias("chili"), (0.2 + 0.1 * (F.col("pid") % 5)).alias("aridity"))


def feature_columns() -> list:
    return [F.col("fire_severity"), F.col("spei"), F.col("elevation") * 1e-4, F.col("chili"), F.col("aridity")]


def dynamic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, pct, x): series with the features of their steps."""
    x = cov.stacked(covariate_panel(spark, sf_dir), feature_columns())
    return user_series(spark, sf_dir).join(x, "pid")


#: Features of the masked grid, in this order.
FEATURES = CovariateConfig(True, ("fire_severity", "elevation", "seed_distance", "focal_mean"))


def masked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, tile_id, r, c, valid, pct) of all cells of kept tiles."""
    grid = cells(spark, sf_dir)
    kept = grid.join(panel.kept_tiles(grid).select("tile_id"), "tile_id", "left_semi")
    return kept.select("pid", "tile_id", "r", "c", panel.valid(F.col("mask")).alias("valid")).join(user_series(spark, sf_dir), "pid")


def covariate_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables by place: fire severity of some days, and elevation with the code for missing."""
    place = cells(spark, sf_dir).select("pid", "r", "c")
    fire = daily(spark, sf_dir).join(place, "pid").select("r", "c", "t", F.least(F.lit(4), "errors").cast("int").alias("value"))
    return {"fire_severity": fire, "elevation": place.select("r", "c", F.when(F.col("pid") % 11 == 0, F.lit(-9999.0)).otherwise(F.col("pid") / 8.0).alias("value"))}


def raster_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tiles (product, year, file) and rasters (product, year) that are there: complete sets, incomplete ones and none."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("y"))
    names = F.explode(F.array(*map(F.lit, ("tree_cover", "fire_severity", "spei", "aridity", "mask", "chili"))))
    years = nations.where("y < 20").select((F.col("y") * 2 + 1986).alias("year"), names.alias("product")).withColumn("year", F.when(~F.col("product").isin("aridity", "mask", "chili"), F.col("year")))
    n = F.when(F.col("product") == "aridity", 30).when(F.col("product") == "chili", 5).when(F.col("year") % 3 == 0, 3).otherwise(12)
    tiles = years.distinct().select("product", "year", F.explode(F.sequence(F.lit(1), n)).alias("file"))
    return tiles, nations.where("y < 5").select(F.lit("spei").alias("product"), (F.col("y") + 1990).alias("year"))

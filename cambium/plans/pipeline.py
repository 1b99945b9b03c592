"""From tables of cover to products (C1, C2): sample, fit, decode, write, summarise."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.config import CovariateConfig, PipelineConfig
from cambium.functions import params as prm
from cambium.operators import covariates as cov
from cambium.operators import decode, learn, panel
from cambium.sources import rasters, store

_STATIC, _NEAR = ("elevation", "chili", "aridity"), ("seed_distance", "focal_mean")
_NODATA = {p.name: p.nodata for p in rasters.PRODUCTS}


def with_features(cells: DataFrame, tables: dict[str, DataFrame], config: CovariateConfig, length: int, strict: bool = False) -> tuple[DataFrame, int]:
    """Cells (pid, tile_id, r, c, valid, pct) -> the valid ones with x, the features of length - 1 steps, and their number.

    tables: unchanging covariates (r, c, value) and yearly ones (r, c, t, value) by name; declared missing values become
    null and so 0 (S8, P8), and a covariate without a table is left out. Covariates are joined to series, one row a
    cell, and features of the neighbourhood see every cell of a tile, valid or not.
    """
    names = [n for n in config.names if n in _NEAR or n in tables]
    near = {n: (n, config.seed_threshold if n == "seed_distance" else None) for n in names if n in _NEAR}
    series = cells.where("valid").select("pid", "tile_id", "r", "c", "pct")
    if near:
        series = series.join(cov.neighbourhood_series(cells, length, near, config.focal_radius, config.cell_metres, config.no_seed_metres, strict), "pid")
    for n in (n for n in names if n in tables):
        found = tables[n].withColumn("value", cov.without_nodata(F.col("value").cast("double"), _NODATA.get(n)))
        found = found.select("r", "c", F.col("value").alias(n)) if n in _STATIC else panel.series(found, length, ("r", "c"), value="value", kind="double", name=n)
        series = series.join(found, ["r", "c"], "left")
    if config.standardize:
        for n in names:
            each = series.select((F.col(n) if n in _STATIC else F.explode(n)).alias("v"))
            row = each.agg(F.mean("v").alias("m"), F.stddev_pop("v").alias("s")).first()
            mean, spread = F.lit(row["m"] or 0.0), F.lit(row["s"] or 1.0)
            series = series.withColumn(n, (F.col(n) - mean) / spread if n in _STATIC else F.transform(n, lambda v: (v - mean) / spread))
    x = cov.stacked_series({n: n not in _STATIC for n in names}, length)
    return series.select("pid", "tile_id", "r", "c", "pct", x.alias("x")), len(names) + 1


def _with_covariates(series: DataFrame | None, spark: SparkSession, config: PipelineConfig) -> tuple[DataFrame, int]:
    """The valid cells with features, or those of a stored series."""
    first, tables = config.io.first_year, {}
    for n in config.covariates.names:
        if n not in _NEAR and store.exists(spark, config.io.path(n)):
            found = store.read_cells(spark, config, n)
            tables[n] = found if n in _STATIC else found.withColumn("t", F.col("year") - first)
    grid = store.grid_cells(spark, config)
    cells = grid.join(store.cover_series(spark, config, grid).select("pid", "pct"), "pid", "left")
    full, d = with_features(cells, tables, config.covariates, len(config.io.years), config.inference.strict)
    full = full.where("pct is not null")
    return (full if series is None else series.join(full.select("pid", "x"), "pid")), d


def run(spark: SparkSession, config: PipelineConfig, params_path: str | None = None, skip_em: bool = False, store_path: str | None = None, refit_weights: bool = False) -> dict[str, float]:
    """Fit on a sample (or load parameters), decode everything, write products, posteriors and summaries.

    store_path: read series from a tile store instead of the cover tables. Loaded weights are used as they are unless
    refit_weights. The decoded table is written once and the products are made from it, so nothing is decoded twice.
    """
    if store_path is None:
        store.validate_inputs(spark, config)
        series = store.cover_series(spark, config)
    else:
        series = store.read_tiles(spark, store_path)
    dynamic, d = config.covariates.enabled, 0
    if dynamic:
        series, d = _with_covariates(series if store_path else None, spark, config)
    params = prm.load(spark, params_path) if params_path else prm.default_params(config.n_states)
    report: dict[str, float] = {}
    chosen = series.join(panel.sample(series.select("pid", "tile_id"), config.em.sample_size, config.em.sample_tiles, config.em.seed).select("pid"), "pid", "left_semi").cache()
    if not skip_em:
        found = learn.baum_welch(chosen, params, config.em)
        params = replace(found.params, weights=params.weights)
        report |= {"n_iter": found.n_iter, "converged": float(found.converged), "log_lik": found.log_likelihoods[-1]}
    if dynamic and (params.weights is None or refit_weights):
        params, seen = learn.fit_weights(chosen, params, d, config.em)
        report["dynamic_log_lik"] = seen[-1]
    chosen.unpersist()
    prm.save(spark, params, f"{config.io.output}/params")
    wanted = ("states", "log_prob", "posterior_q") if config.inference.posteriors else ("states", "log_prob")
    kernel = decode.decode_dynamic if dynamic else decode.decode
    kernel(series, params, wanted, strict=config.inference.strict).write.mode("overwrite").parquet(f"{config.io.output}/decoded")
    decoded = spark.read.parquet(f"{config.io.output}/decoded")
    store.write_outputs(decoded, config.io.output, config.io.first_year)
    store.write_summary(decoded, config.io.output, params.n_states, config.io.first_year)
    row = decoded.agg(F.count("*").alias("n"), F.countDistinct("tile_id").alias("tiles")).first()
    return report | {"n_pixels": row["n"], "n_tiles": row["tiles"]}

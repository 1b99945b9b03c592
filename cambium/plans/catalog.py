"""Every query of the library and its SQL oracle, by name. All run over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cambium.config import EMConfig
from cambium.functions import emission as em
from cambium.functions.params import HMMParams, default_params
from cambium.operators import covariates as cov
from cambium.operators import decode, learn, panel, products
from cambium.plans import fixture as fx
from cambium.plans import pipeline
from cambium.plans.oracles import ORACLES
from cambium.plans.sizing import estimate
from cambium.sources import rasters

__all__ = ["ORACLES", "QUERIES"]


def _long(frame: DataFrame, column: str, name: str, kind: str = "int") -> DataFrame:
    return frame.select("pid", F.posexplode(column).alias("t", name)).select("pid", F.col("t").cast("int").alias("t"), F.col(name).cast(kind).alias(name))


def _smoothed(spark: SparkSession, sf: str, wanted: tuple[str, ...]) -> DataFrame:
    return decode.decode(fx.user_series(spark, sf), default_params(), wanted)


def _states(spark: SparkSession, sf: str, **more) -> DataFrame:
    return decode.decode(fx.user_series(spark, sf), default_params(), ("states",), **more)


def panel_build(spark, sf):
    return fx.user_panel(spark, sf)


def rap_to_float(spark, sf):
    return fx.user_panel(spark, sf).select("pid", "t", F.round(em.fraction(F.col("pct")), 6).alias("x"))


def zib_emission(spark, sf):
    rows = fx.user_panel(spark, sf).select("pid", "t", F.posexplode(em.zib_by_cover(F.col("pct"), default_params().emission)).alias("k", "le"))
    return rows.select("pid", "t", "k", F.round("le", 6).alias("le"))


def gaussian_emission(spark, sf):
    each = F.array(*[em.gaussian_expression(F.col("pct"), m, 44.89) for m in (1.5, 10.0)])
    return fx.user_panel(spark, sf).select("pid", "t", F.posexplode(each).alias("k", "le")).select("pid", "t", "k", F.round("le", 6).alias("le"))


def viterbi_states(spark, sf):
    return _long(_states(spark, sf), "states", "state")


def viterbi_collapsed(spark, sf):
    return _long(_states(spark, sf, collapse=True), "states", "state")


def viterbi_expression(spark, sf):
    return _long(decode.viterbi_expression(fx.user_series(spark, sf), default_params()), "states", "state")


def viterbi_log_prob(spark, sf):
    return _smoothed(spark, sf, ("log_prob",)).select("pid", F.round("log_prob", 6).alias("log_prob"))


def forward_loglik(spark, sf):
    return _smoothed(spark, sf, ("log_lik",)).select("pid", F.round("log_lik", 6).alias("log_lik"))


def total_loglik(spark, sf):
    return _smoothed(spark, sf, ("log_lik",)).agg(F.round(F.sum("log_lik"), 4).alias("log_lik"), F.count("*").alias("n_series"))


def _posterior(spark, sf, wanted: str) -> DataFrame:
    steps = _smoothed(spark, sf, (wanted,)).select("pid", F.posexplode(wanted).alias("t", "each"))
    return steps.select("pid", F.col("t").cast("int").alias("t"), F.posexplode("each").alias("k", "p"))


def posterior(spark, sf):
    return _posterior(spark, sf, "posterior").select("pid", "t", "k", F.round("p", 6).alias("p"))


def posterior_quantized(spark, sf):
    return _posterior(spark, sf, "posterior_q").withColumnRenamed("p", "q")


def uncertainty_bands(spark, sf):
    best = _smoothed(spark, sf, ("posterior",)).select(F.explode("posterior").alias("each")).select(F.round(F.array_max("each"), 9).alias("best"))
    return best.groupBy(products.uncertainty(F.col("best")).alias("band")).agg(F.count("*").alias("n"))


def _rows(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _statistics(spark, sf) -> learn.Statistics:
    return learn.expectations(fx.user_series(spark, sf), default_params())


def expected_transitions(spark, sf):
    s = _statistics(spark, sf)
    return _rows(spark, [(i, j, round(float(v), 4)) for (i, j), v in np.ndenumerate(s.pairs)], "i int, j int, n double")


def zero_fraction(spark, sf):
    return _rows(spark, [(k, round(float(v), 6)) for k, v in enumerate(learn.zero_fraction(_statistics(spark, sf)))], "k int, p double")


def init_mstep(spark, sf):
    return _rows(spark, [(k, round(float(np.exp(v)), 6)) for k, v in enumerate(learn.initial_step(_statistics(spark, sf)))], "k int, p double")


def transition_mstep(spark, sf):
    return _rows(spark, [(i, j, round(float(np.exp(v)), 6)) for (i, j), v in np.ndenumerate(learn.transition_step(_statistics(spark, sf)))], "i int, j int, p double")


def beta_suffstats(spark, sf):
    return _rows(spark, [(k, *(round(float(v), 4) for v in row)) for k, row in enumerate(learn.beta_sums(_statistics(spark, sf)))], "k int, w double, s_ln double, s_ln1m double")


def em_fit(spark, sf):
    frame = fx.user_series(spark, sf).cache()
    found = learn.baum_welch(frame)
    frame.unpersist()
    e = found.params.emission
    return _rows(spark, [(k, float(np.exp(found.params.log_init[k])), float(e.pi[k]), float(e.mu[k]), float(e.phi[k]), found.n_iter, found.converged, found.log_likelihoods[-1]) for k in range(6)], "k int, init double, pi double, mu double, phi double, n_iter int, converged boolean, log_lik double")


def first_year_products(spark, sf):
    return products.products(_states(spark, sf))


def max_state(spark, sf):
    return _states(spark, sf).select("pid", F.array_max("states").alias("max_state"))


def year_state_summary(spark, sf):
    states = _states(spark, sf).select(F.posexplode("states").alias("t", "state")).select((F.col("t") + 1986).cast("int").alias("year"), "state")
    return products.year_summary(states, 6).withColumn("fraction", F.round("fraction", 6))


def first_year_summary(spark, sf):
    return products.first_year_summary(products.products(_states(spark, sf))).withColumn("mean", F.round("mean", 6))


def hard_transitions(spark, sf):
    return products.hard_transitions(_states(spark, sf))


def tiles(spark, sf):
    height = fx.cells(spark, sf).agg(F.max("r")).first()[0] + 1
    return panel.tiles(spark, height, fx.WIDTH, fx.TILE)


def raster_window(spark, sf):
    return rasters.window(fx.cells(spark, sf).where("mask > 0").select("r", "c", F.col("mask").alias("value")), 0, 2, 8, 9)


def tile_filter(spark, sf):
    return panel.kept_tiles(fx.cells(spark, sf))


def masked_cells(spark, sf):
    cells = fx.cells(spark, sf)
    return panel.masked(cells, panel.kept_tiles(cells)).select("pid", "r", "c", "tile_id")


def masked_cells_strict(spark, sf):
    cells = fx.cells(spark, sf)
    return panel.masked(cells, panel.kept_tiles(cells, strict=True), strict=True).select("pid", "r", "c", "tile_id")


def em_sample(spark, sf):
    return panel.sample(fx.cells(spark, sf), 20, 5).select("pid", "tile_id")


def seed_distance(spark, sf):
    found = cov.neighbourhood(fx.covers(spark, sf), {"near": ("seed_distance", 0.04), "far": ("seed_distance", 0.5)})
    place = fx.cells(spark, sf).select("pid", "tile_id", "r", "c")
    return found.join(place, ["tile_id", "r", "c"]).select("pid", "t", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"))


def focal_mean(spark, sf):
    place = fx.cells(spark, sf).select("pid", "tile_id", "r", "c")
    return cov.neighbourhood(fx.covers(spark, sf), {"fm": ("focal_mean", None)}).join(place, ["tile_id", "r", "c"]).select("pid", "t", F.round("fm", 6).alias("fm"))


def pipeline_features(spark, sf):
    """Feature vectors as the pipeline makes them: masked cells count as neighbours, declared missing values as 0."""
    x, d = pipeline.with_features(fx.masked_series(spark, sf), fx.covariate_tables(spark, sf), fx.FEATURES, fx.DAYS)
    steps = x.select("pid", F.posexplode("x").alias("t", "each")).select("pid", F.col("t").cast("int").alias("t"), F.posexplode("each").alias("d", "v"))
    return steps.select("pid", "t", F.col("d").cast("int").alias("d"), F.round("v", 6).alias("v"))


def covariate_join(spark, sf):
    return fx.covariate_panel(spark, sf).withColumns({c: F.round(c, 6) for c in ("spei", "elevation", "chili", "aridity")})


def covariate_stack(spark, sf):
    steps = cov.stacked(fx.covariate_panel(spark, sf), fx.feature_columns()).select("pid", F.posexplode("x").alias("t", "each"))
    return steps.select("pid", F.col("t").cast("int").alias("t"), F.posexplode("each").alias("d", "v")).withColumn("v", F.round("v", 6))


def covariate_lag(spark, sf):
    return fx.covariate_panel(spark, sf).select("pid", "t", F.lag("fire_severity").over(Window.partitionBy("pid").orderBy("t")).alias("fire_severity"))


def dynamic_log_trans(spark, sf):
    return cov.long_transitions(fx.dynamic_series(spark, sf), fx.WEIGHTS).withColumn("la", F.round("la", 6))


def dynamic_log_trans_sql(spark, sf):
    steps = fx.dynamic_series(spark, sf).select("pid", F.posexplode("x").alias("t", "x")).select("pid", F.col("t").cast("int").alias("t"), F.posexplode(cov.dynamic_transitions(F.col("x"), fx.WEIGHTS)).alias("i", "row"))
    return steps.select("pid", "t", "i", F.posexplode("row").alias("j", "la")).withColumn("la", F.round("la", 6))


def _dynamic() -> HMMParams:
    p = default_params()
    return HMMParams(p.log_init, p.log_trans, p.emission, fx.WEIGHTS)


def dynamic_viterbi(spark, sf):
    return _long(decode.decode_dynamic(fx.dynamic_series(spark, sf), _dynamic(), ("states",)), "states", "state")


def weight_fit(spark, sf):
    """3 rounds of 10 steps instead of the operator's 20 and 50: a step is a job, see the README; `converged` tells."""
    frame, config = fx.dynamic_series(spark, sf).select("pct", "x").cache(), EMConfig(weight_iters=3, lbfgs_maxiter=10)
    found, seen = learn.fit_weights(frame, default_params(), 6, config)
    frame.unpersist()
    done = len(seen) > 1 and abs(seen[-1] - seen[-2]) < config.weight_tol * max(abs(seen[-2]), 1.0)
    return _rows(spark, [(i, j + (j >= i), d, float(w), len(seen), bool(done), float(seen[-1])) for (i, j, d), w in np.ndenumerate(found.weights)], "i int, target int, d int, w double, n_rounds int, converged boolean, log_lik double")


def weight_gradient(spark, sf):
    """The loss of the weight fit and its gradient at fixed weights, from one E-step with dynamic transitions."""
    made, _ = learn.pair_table(fx.dynamic_series(spark, sf).select("pct", "x"), _dynamic())
    loss, slope = learn.weight_loss(made, fx.WEIGHTS, 1e-3)
    made.unpersist()
    return _rows(spark, [(i, j + (j >= i), d, round(float(g), 4), round(float(loss), 4)) for (i, j, d), g in np.ndenumerate(slope)], "i int, target int, d int, gradient double, loss double")


def _grids(spark, sf):
    return fx.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("grid_id"), F.lit("local").alias("crs"), (F.lit(100.0) - 60.0 * F.col("r_regionkey")).alias("x0"), (F.lit(900.0) - 90.0 * F.col("r_regionkey")).alias("y0"), F.lit(30.0).alias("dx"), F.lit(-30.0).alias("dy"), F.lit(15).alias("width"), F.lit(10).alias("height"))


def grid_offset(spark, sf):
    grids = _grids(spark, sf)
    return panel.grid_offset(grids, grids.where("grid_id = 0"))


def alignment_check(spark, sf):
    grids = _grids(spark, sf)
    return rasters.alignment(grids, grids.where("grid_id = 0"))


def zero_fill(spark, sf):
    return rasters.zero_filled(fx.cells(spark, sf).select("pid"), (2023, 2024), "fire_severity")


def mosaic(spark, sf):
    events = fx.table(spark, sf, "events").select(F.col("user_id").alias("pid"), F.datediff("ts", F.lit(fx.ORIGIN)).cast("bigint").alias("t"), F.col("event_id").alias("v"))
    return rasters.mosaic([events.where("pid % 3 <= 1"), events.where("pid % 3 >= 1")], ("pid", "t"), "v")


def work_items(spark, sf):
    cells = fx.cells(spark, sf)
    return rasters.missing(cells.select("tile_id").distinct(), cells.where("mask = 255").select("tile_id"), ["tile_id"])


def mosaic_plan(spark, sf):
    tiles, existing = fx.raster_files(spark, sf)
    return rasters.mosaic_plan(tiles, existing)


def memory_estimate(spark, sf):
    found = [(n, pairs, estimate(n, 39, 6, 10, pairs)) for n in (1000, 500_000) for pairs in (False, True)]
    return _rows(spark, [(n, pairs, *(round(e[k], 6) for k in ("observations", "emissions", "posteriors", "covariates", "states_out", "posteriors_out", "total"))) for n, pairs, e in found], "n_pixels int, pairs boolean, observations_mb double, emissions_mb double, posteriors_mb double, covariates_mb double, states_out_mb double, posteriors_out_mb double, total_mb double")


QUERIES = {
    f.__name__: f
    for f in (
        panel_build, rap_to_float, zib_emission, gaussian_emission, viterbi_states, viterbi_collapsed, viterbi_expression, viterbi_log_prob,
        forward_loglik, total_loglik, posterior, posterior_quantized, uncertainty_bands, expected_transitions, zero_fraction, init_mstep,
        transition_mstep, beta_suffstats, em_fit, first_year_products, max_state, year_state_summary, first_year_summary, hard_transitions,
        tiles, tile_filter, masked_cells, masked_cells_strict, em_sample, seed_distance, focal_mean, covariate_join, covariate_stack,
        covariate_lag, dynamic_log_trans, dynamic_log_trans_sql, dynamic_viterbi, weight_fit, weight_gradient, pipeline_features, mosaic_plan, grid_offset, alignment_check, zero_fill,
        raster_window, mosaic, work_items, memory_estimate,
    )
}

"""Panels, tiles, covariates, products, sources, sinks, streaming and the command line."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium import cli
from cambium.config import CovariateConfig, IOConfig, PipelineConfig
from cambium.functions import kernels as kn
from cambium.functions.params import HMMParams, default_params
from cambium.operators import covariates as cov
from cambium.operators import panel, products
from cambium.plans import sizing
from cambium.sources import npy, rasters, store


def test_tiles_cover_the_grid(spark):
    t = panel.tiles(spark, 1024, 2048, 512)
    assert t.count() == 8 and t.agg(F.sum("n_pixels")).first()[0] == 1024 * 2048
    last = panel.tiles(spark, 1000, 1500, 512).orderBy(F.desc("tile_id")).first()
    assert (last["height"], last["width"]) == (488, 476)


def test_tile_keep_rule_and_masks(spark):
    rows = [(1, 1)] + [(1, 0)] * 99 + [(2, 0)] * 100 + [(3, 255)] * 10 + [(4, None)] * 3 + [(5, 1)] + [(5, 0)] * 100
    cells = spark.createDataFrame(rows, "tile_id int, mask int")
    assert {r[0] for r in panel.kept_tiles(cells).select("tile_id").collect()} == {1}
    assert {r[0] for r in panel.kept_tiles(cells, strict=True).select("tile_id").collect()} == {1, 3}
    assert panel.masked(cells, panel.kept_tiles(cells)).count() == 1


def test_sample_is_bounded_and_reproducible(spark):
    cells = spark.range(500).select(F.col("id").alias("pid"), (F.col("id") % 9).cast("int").alias("tile_id"))
    one = {r["pid"] for r in panel.sample(cells, 30, 4).collect()}
    assert len(one) == 30 and one == {r["pid"] for r in panel.sample(cells.repartition(5), 30, 4).collect()}
    assert len({i % 9 for i in one}) <= 4
    assert panel.sample(cells.limit(0), 30, 4).count() == 0


def test_distances_against_brute_force():
    rng = np.random.default_rng(0)
    for shape in ((1, 7), (6, 1), (9, 13)):
        x = rng.random(shape)
        seeds = np.argwhere(x >= 0.8)
        got = kn.seed_distance(x, 0.8)
        for r in range(shape[0]):
            for c in range(shape[1]):
                want = min((30 * np.hypot(r - a, c - b) for a, b in seeds), default=50_000.0)
                assert np.isclose(got[r, c], want)
    assert (kn.seed_distance(np.zeros((3, 3))) == 50_000).all()


def test_focal_mean_mirrors_small_grids():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 15), (2, 3), (12, 20)):
        x = rng.random(shape)
        wide = np.pad(x, 5, mode="symmetric")
        want = [[wide[r : r + 11, c : c + 11].mean() for c in range(shape[1])] for r in range(shape[0])]
        assert np.allclose(kn.focal_mean(x), want)


def test_stack_order_nulls_and_lag(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, None), (1, 1, float("nan"), 5.0), (1, 2, 3.0, 5.0)], "pid long, t int, a double, b double")
    assert cov.stacked(rows, [F.col("a"), F.col("b")]).first()["x"] == [[1.0, 1.0, 0.0], [1.0, 0.0, 5.0]]
    with pytest.raises(ValueError):
        cov.features([])
    one = spark.createDataFrame([([1.0, 2.0, 3.0], 7.0)], "a array<double>, b double")
    assert one.select(cov.stacked_series({"a": True, "b": False}, 3).alias("x")).first()["x"] == [[1.0, 1.0, 7.0], [1.0, 2.0, 7.0]]


def test_yearly_static_and_nodata(spark):
    cells = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "pid long, t int")
    fire = spark.createDataFrame([(1, 1, 3)], "pid long, t int, fire int")
    assert [r["fire"] for r in cov.with_yearly(cells, fire, "fire").orderBy("pid", "t").collect()] == [0, 3, 0]
    dem = spark.createDataFrame([(1, -9999.0), (2, 5.0)], "pid long, z double").select("pid", cov.without_nodata(F.col("z"), -9999).alias("z"))
    assert [r["z"] for r in cov.with_static(cells, dem).orderBy("pid", "t").collect()] == [None, None, 5.0]


def test_dynamic_rows_are_distributions(spark):
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(4, 3, 8)), rng.normal(0, 0.1, (6, 5, 8))
    la = kn.dynamic_log_trans(x, w)
    assert np.allclose(np.exp(la).sum(3), 1, atol=1e-12) and (la <= 0).all()
    assert np.allclose(np.exp(kn.dynamic_log_trans(x, np.zeros_like(w))), 1 / 6)
    frame = spark.createDataFrame([(x[0, 0].tolist(),)], "x array<double>")
    assert np.allclose(frame.select(cov.dynamic_transitions(F.col("x"), w).alias("a")).first()["a"], la[0, 0])


def test_products_and_codes(spark):
    made = spark.createDataFrame([(1, [0, 2, 1, 5]), (2, [0, 0, 0, 0])], "pid long, states array<tinyint>")
    rows = {r["pid"]: r for r in products.products(made, 2000).collect()}
    assert (rows[1]["first_trace"], rows[1]["first_open"], rows[1]["first_forest"], rows[1]["max_state"]) == (2001, 2003, 2003, 5)
    assert rows[2]["first_trace"] is None
    assert products.at_sink(products.products(made, 2000)).where("pid = 2").first()["first_trace"] == -9999
    assert {(r["i"], r["j"]): r["n"] for r in products.hard_transitions(made).collect()} == {(0, 2): 1, (2, 1): 1, (1, 5): 1, (0, 0): 3}
    q = spark.createDataFrame([(1.0 - 1e-16,), (0.4999,), (0.0,)], "p double").select(products.quantised(F.col("p")).alias("q"))
    assert [r["q"] for r in q.collect()] == [200, 99, 0]
    years = products.year_summary(spark.createDataFrame([(1, 0), (1, None), (1, 2)], "year int, state int"), 3).orderBy("state").collect()
    assert [(r["n"], r["n_valid"], r["n_nodata"], r["fraction"]) for r in years] == [(1, 2, 1, 0.5), (0, 2, 1, 0.0), (1, 2, 1, 0.5)]
    assert products.first_year_summary(products.products(made.where("pid = 2"), 2000)).count() == 0


def test_rasters(spark):
    a = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 1, None)], "r int, c int, year int, value int")
    b = spark.createDataFrame([(0, 0, 1, 7), (0, 1, 1, 2)], "r int, c int, year int, value int")
    assert sorted(map(tuple, rasters.mosaic([a, b]).collect())) == [(0, 0, 1, 7), (0, 1, 1, 2)]
    w = rasters.window(a.select("r", "c", "value"), 0, 0, 2, 2)
    assert {(r["r"], r["c"]): r["value"] for r in w.collect()} == {(0, 0): 5, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    assert rasters.missing(b, a, ["r", "c"]).count() == 0 and rasters.missing(b, a, ["r", "c"], force=True).count() == 2
    plane = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(4) for c in range(4)], "r int, c int, value double")
    half = {(r["r"], r["c"]): r["value"] for r in rasters.resampled(plane, 1, 1, 0.5, 0.25, 3, 3).collect()}
    assert np.isclose(half[1, 1], 10 * 1.5 + 1.25)


def write_inputs(spark, root, years=range(2000, 2006)):
    rng = np.random.default_rng(0)
    cells = [(r, c) for r in range(9) for c in range(10)]
    spark.createDataFrame([(r, c, 255 if r == c == 8 else int((r + c) % 5 != 0)) for r, c in cells], "r int, c int, mask int").write.parquet(f"{root}/mask")
    spark.createDataFrame([(r, c, y, int(min(100, max(0, 8 * c + rng.integers(-5, 6))))) for r, c in cells for y in years], "r int, c int, year int, pct int").write.parquet(f"{root}/tree_cover")
    for name, value in (("fire_severity", 1.0), ("spei", -0.5)):
        spark.createDataFrame([(r, c, y, value) for r, c in cells for y in years], "r int, c int, year int, value double").write.parquet(f"{root}/{name}")
    for name in ("elevation", "chili", "aridity"):
        spark.createDataFrame([(r, c, float(r)) for r, c in cells], "r int, c int, value double").write.parquet(f"{root}/{name}")


def test_command_line_end_to_end(spark, tmp_path, capsys):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_inputs(spark, root)
    common = ["--data", root, "--output", out, "--first-year", "2000", "--last-year", "2005", "--tile-size", "5"]
    got = cli.main(["run", *common, "--max-iter", "2", "--sample-size", "40"], spark)
    valid = sum((r + c) % 5 != 0 and not r == c == 8 for r in range(9) for c in range(10))
    assert got["n_pixels"] == valid and got["n_tiles"] == 4
    assert spark.read.parquet(f"{out}/states").count() == valid * 6
    assert spark.read.parquet(f"{out}/posteriors").select("year").distinct().count() == 6
    before = sorted(map(tuple, spark.read.parquet(f"{out}/products").select("pid", "max_state").collect()))
    cli.main(["prechunk", *common, "--store", f"{out}/store"], spark)
    assert store.read_tiles(spark, f"{out}/store", [0]).count() < valid and spark.read.parquet(f"{out}/store/manifest").agg(F.sum("n_pixels")).first()[0] == valid
    cli.main(["run", *common, "--store", f"{out}/store", "--skip-em", "--params", f"{out}/params", "--no-posteriors"], spark)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/products").select("pid", "max_state").collect())) == before
    cli.main(["assemble", "--output", out, "--first-year", "2000"], spark)
    cli.main(["stats", "--output", out, "--first-year", "2000"], spark)
    assert spark.read.json(f"{out}/summary/years").count() == 36
    described = cli.main(["inspect-params", f"{out}/params"], spark)
    assert described["n_states"] == 6 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["mu"] == described["mu"]
    dynamic = cli.main(["run", *common, "--skip-em", "--dynamic", "--weight-iters", "2", "--sample-size", "40", "--no-posteriors"], spark)
    assert np.isfinite(dynamic["dynamic_log_lik"])


def test_validation_names_what_is_missing(spark, tmp_path):
    root = str(tmp_path)
    write_inputs(spark, root, years=range(2000, 2003))
    config = PipelineConfig(io=IOConfig(root, "x", 2000, 2002))
    store.validate_inputs(spark, config)
    with pytest.raises(FileNotFoundError, match="2003"):
        store.validate_inputs(spark, PipelineConfig(io=IOConfig(root, "x", 2000, 2003)))
    with pytest.raises(FileNotFoundError, match="soil"):
        store.validate_inputs(spark, PipelineConfig(io=IOConfig(root, "x", 2000, 2002, ("soil",)), covariates=CovariateConfig(True, ("soil",))))


def test_npy_chunks(spark, tmp_path):
    for i, x in enumerate(([[0.0, 0.25, 0.999]], [[0.5, np.nan, 0.01], [1.0, 0.0, 0.0]])):
        d = tmp_path / f"chunk_{i}"
        d.mkdir()
        np.save(d / "observations.npy", np.array(x, np.float32))
        np.save(d / "valid_indices.npy", np.array([[i, j] for j in range(len(x))]))
    npy.register(spark)
    rows = spark.read.format("npy_chunks").option("path", str(tmp_path)).load().orderBy("chunk", "c").collect()
    assert [r["pct"] for r in rows] == [[0, 25, 100], [50, None, 1], [100, 0, 0]]


def test_streaming_filter_equals_the_forward_pass(spark, tmp_path):
    from cambium.functions.emission import zib_table
    from cambium.streaming.filtering import filtered

    pct = [0, 12, None, 40, 55]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, t, v) for t, v in enumerate(pct)], "pid long, t int, pct int").coalesce(1).write.parquet(folder)
    query = filtered(spark.readStream.schema("pid long, t int, pct int").parquet(folder), default_params()).writeStream.format("memory").queryName("filtered").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    last = spark.table("filtered").orderBy(F.desc("t")).first()
    p = default_params()
    e = zib_table(p.emission)[[v if v is not None else 101 for v in pct]]
    smooth = kn.forward_backward(e[None], p.log_init, p.log_trans)
    assert np.isclose(last["log_lik"], smooth.log_lik[0]) and last["state"] == int(smooth.alpha[0, -1].argmax())


def test_memory_model():
    small, large = sizing.estimate(1000), sizing.estimate(1000, pairs=True)
    assert large["total"] > small["total"] and np.isclose(sizing.estimate(2000)["total"], 2 * small["total"])
    assert sizing.batch_size(80) > sizing.batch_size(40) > 0
    assert sizing.batch_size(1) * sizing.estimate(1)["total"] <= 0.7 * 1024


def test_weights_are_kept(spark):
    p = default_params()
    assert HMMParams(p.log_init, p.log_trans, p.emission).weights is None


def test_features_see_masked_cells_grids_and_missing_values(spark, tmp_path):
    """A masked-out cell of 80 % cover is a seed; -9999 is no elevation; covers lie on a grid of their own."""
    from cambium.plans import pipeline

    root = str(tmp_path)
    cells = [(r, c) for r in range(4) for c in range(4)]
    spark.createDataFrame([(r, c, int((r, c) != (1, 1))) for r, c in cells], "r int, c int, mask int").write.parquet(f"{root}/mask")
    covers = [(r - 2, c - 3, y, 80 if (r, c) == (1, 1) else 0) for r, c in cells for y in (2000, 2001, 2002)]
    spark.createDataFrame(covers, "r int, c int, year int, pct int").write.parquet(f"{root}/tree_cover")
    spark.createDataFrame([(r, c, -9999.0 if c else 7.0) for r, c in cells], "r int, c int, value double").write.parquet(f"{root}/elevation")
    grids = [("mask", 0.0, 0.0, 30.0, -30.0, 4), ("tree_cover", 90.0, -60.0, 30.0, -30.0, 4)]
    spark.createDataFrame(grids, "grid_id string, x0 double, y0 double, dx double, dy double, width int").write.parquet(f"{root}/grids")
    config = PipelineConfig(io=IOConfig(root, "x", 2000, 2002), covariates=CovariateConfig(True, ("elevation", "seed_distance", "focal_mean")))
    found, d = pipeline._with_covariates(None, spark, config)
    rows = {(x["r"], x["c"]): x["x"] for x in found.collect()}
    assert d == 4 and set(rows) == set(cells) - {(1, 1)}
    for (r, c), x in rows.items():
        assert len(x) == 2 and all(step[:2] == [1.0, 0.0 if c else 7.0] for step in x)
        assert np.isclose(x[0][2], 30 * np.hypot(r - 1, c - 1)) and x[0][3] > 0
    scaled, _ = pipeline._with_covariates(None, spark, PipelineConfig(io=config.io, covariates=CovariateConfig(True, ("seed_distance",), standardize=True)))
    each = np.array([x["x"] for x in scaled.collect()])[:, :, 1]
    assert abs(each.mean()) < 1e-9 and np.isclose(each.std(), 1)


def test_mosaic_plan(spark):
    few = (rasters.Product("a", "int", None, 2, (1, 2, 3), (4, 5)), rasters.Product("b", "int", None, 1, (1,), (2,)), rasters.Product("c", "int", None, 1))
    tiles = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 2, "x"), ("c", None, "x")], "product string, year int, file string")
    there = spark.createDataFrame([("a", 3), ("a", 4)], "product string, year int")
    plan = lambda **k: {tuple(r) for r in rasters.mosaic_plan(tiles, there, few, **k).collect()}
    assert plan() == {("a", 1, "mosaic"), ("a", 5, "zero_fill"), ("c", None, "mosaic")}
    assert plan(force=True) == {("a", 1, "mosaic"), ("a", 4, "zero_fill"), ("a", 5, "zero_fill"), ("c", None, "mosaic")}

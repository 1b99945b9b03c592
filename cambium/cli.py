"""Command line (C9): run, prechunk, assemble, inspect-params, stats."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from cambium.config import CovariateConfig, EMConfig, InferenceConfig, IOConfig, PipelineConfig
from cambium.functions import params as prm
from cambium.plans import pipeline
from cambium.sources import store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cambium", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("run", "prechunk"):
        p = commands.add_parser(name)
        p.add_argument("--data", default="data")
        p.add_argument("--output", default="output")
        p.add_argument("--first-year", type=int, default=1986)
        p.add_argument("--last-year", type=int, default=2024)
        p.add_argument("--tile-size", type=int, default=512)
        p.add_argument("--min-valid", type=float, default=0.01)
        p.add_argument("--strict", action="store_true")
        p.add_argument("--store", help="folder of the tile store")
        if name == "run":
            p.add_argument("--n-states", type=int, default=6)
            p.add_argument("--max-iter", type=int, default=100)
            p.add_argument("--tol", type=float, default=1e-4)
            p.add_argument("--sample-size", type=int, default=2_000_000)
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--params", help="parameters to start from")
            p.add_argument("--skip-em", action="store_true")
            p.add_argument("--dynamic", action="store_true", help="transitions from covariates")
            p.add_argument("--refit-weights", action="store_true")
            p.add_argument("--l2", type=float, default=1e-3)
            p.add_argument("--weight-iters", type=int, default=20)
            p.add_argument("--no-posteriors", action="store_true")
            p.add_argument("--standardize", action="store_true")
    p = commands.add_parser("assemble")
    p.add_argument("--output", default="output")
    p.add_argument("--first-year", type=int, default=1986)
    p = commands.add_parser("inspect-params")
    p.add_argument("path")
    p = commands.add_parser("stats")
    p.add_argument("--output", default="output")
    p.add_argument("--n-states", type=int, default=6)
    p.add_argument("--first-year", type=int, default=1986)
    return top


def config_of(a: argparse.Namespace) -> PipelineConfig:
    config = PipelineConfig(inference=InferenceConfig(tile_size=a.tile_size, min_valid=a.min_valid, strict=a.strict), io=IOConfig(a.data, a.output, a.first_year, a.last_year))
    if a.command == "prechunk":
        return config
    return replace(
        config, n_states=a.n_states, inference=replace(config.inference, posteriors=not a.no_posteriors),
        em=EMConfig(max_iter=a.max_iter, tol=a.tol, sample_size=a.sample_size, seed=a.seed, l2=a.l2, weight_iters=a.weight_iters),
        covariates=CovariateConfig(enabled=a.dynamic, standardize=a.standardize),
    )


def described(params: prm.HMMParams) -> dict:
    e = params.emission
    return {"n_states": params.n_states, "pi": e.pi.tolist(), "mu": e.mu.tolist(), "phi": e.phi.tolist(), "log_init": params.log_init.tolist(), "log_trans": params.log_trans.tolist(), "weights": None if params.weights is None else list(params.weights.shape)}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("cambium").getOrCreate()
    out: dict = {}
    if a.command == "run":
        out = pipeline.run(spark, config_of(a), a.params, a.skip_em, a.store, a.refit_weights)
    elif a.command == "prechunk":
        config = config_of(a)
        store.validate_inputs(spark, config)
        store.write_tiles(store.cover_series(spark, config), a.store or f"{a.output}/store", config)
    elif a.command == "assemble":
        store.write_outputs(spark.read.parquet(f"{a.output}/decoded"), a.output, a.first_year)
    elif a.command == "inspect-params":
        out = described(prm.load(spark, a.path))
    else:
        store.write_summary(spark.read.parquet(f"{a.output}/decoded"), a.output, a.n_states, a.first_year)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()

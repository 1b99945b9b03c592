"""Covariates (S6-S11, S16, P5-P9): joins onto cells, lag, feature vectors, and features of the neighbourhood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions.kernels import focal_mean, seed_distance


def without_nodata(value: Column, nodata: float | None) -> Column:
    """A declared missing value becomes null."""
    return value if nodata is None else F.when(value != F.lit(nodata), value)


def with_yearly(frame: DataFrame, covariate: DataFrame, name: str, keys: tuple[str, ...] = ("pid", "t")) -> DataFrame:
    """Left join of a yearly covariate; a year or cell without a row is 0."""
    return frame.join(covariate.select(*keys, F.col(name).alias("_joined")), list(keys), "left").withColumn(name, F.coalesce("_joined", F.lit(0).cast(covariate.schema[name].dataType))).drop("_joined")


def with_static(frame: DataFrame, covariates: DataFrame, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Left join of unchanging covariates; missing ones stay null until the feature vector is made."""
    return frame.join(covariates, list(keys), "left")


def features(columns: list[Column]) -> Column:
    """The feature vector of one step: an intercept of 1, then the columns in order, null and NaN as 0."""
    if not columns:
        raise ValueError("no covariates")
    return F.array(F.lit(1.0), *[F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def stacked(frame: DataFrame, columns: list[Column], t: str = "t", keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Long rows -> (keys, x array<array<double>>) of T - 1 steps in order; the last step drives none."""
    rows = frame.select(*keys, F.struct(F.col(t).alias("t"), features(columns).alias("x")).alias("_row"))
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return ordered.select(*keys, F.transform(F.slice("_rows", F.lit(1), F.greatest(F.size("_rows") - 1, F.lit(0))), lambda r: r["x"]).alias("x"))


def stacked_series(names: dict[str, bool], length: int) -> Column:
    """The same from columns of one row a series: yearly ones are arrays (True), static ones scalars (False)."""
    if not names:
        raise ValueError("no covariates")
    return F.transform(F.sequence(F.lit(0), F.lit(length - 2)), lambda i: features([F.try_element_at(F.col(n), i.cast("int") + 1) if yearly else F.col(n) for n, yearly in names.items()]))


#: Features of the neighbourhood by name: kind, and for distances the least cover of a seed.
NEAR = {"seed_distance": ("seed_distance", 0.04), "focal_mean": ("focal_mean", None)}


def _made(grid: np.ndarray, features: dict, radius: int, metres: float, none: float) -> list[np.ndarray]:
    return [seed_distance(grid, threshold, metres, none) if kind == "seed_distance" else focal_mean(grid, radius) for kind, threshold in features.values()]


def neighbourhood(cells: DataFrame, features: dict = NEAR, radius: int = 5, metres: float = 30.0, none: float = 50_000.0, tile: str = "tile_id", r: str = "r", c: str = "c", value: str = "x", t: str = "t") -> DataFrame:
    """(tile, t, r, c, features) of every cell, masked or not, within its tile; one shuffle.

    Grouped by (tile, t): a group is one dense tile, whose size is the tile size squared. Tiles don't see their
    neighbours: distances stop and means are mirrored at tile edges. A tile without a seed has the distance `none`
    everywhere. Missing cells of a tile count as cover 0.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, cols = np.asarray(group.column(r), np.int64), np.asarray(group.column(c), np.int64)
        r0, c0 = rows.min(), cols.min()
        grid = np.zeros((rows.max() - r0 + 1, cols.max() - c0 + 1))
        grid[rows - r0, cols - c0] = np.nan_to_num(np.asarray(group.column(value).cast(pa.float64()).fill_null(0.0), np.float64))
        made = _made(grid, features, radius, metres, none)
        return pa.table({n: group.column(n) for n in (tile, t, r, c)} | {n: pa.array(m[rows - r0, cols - c0]) for n, m in zip(features, made)})

    kinds = ", ".join(f"{x} {cells.schema[x].dataType.simpleString()}" for x in (tile, t, r, c))
    return cells.select(tile, t, r, c, value).groupBy(tile, t).applyInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in features)}")


def neighbourhood_series(cells: DataFrame, length: int, features: dict = NEAR, radius: int = 5, metres: float = 30.0, none: float = 50_000.0, strict: bool = False) -> DataFrame:
    """(pid, features as arrays of `length` steps) of the valid cells of cells (pid, tile_id, r, c, valid, pct array).

    All cells of a tile count, valid or not: a masked cell may be the nearest seed. Missing cover (null, and above 100
    unless strict) counts as 0. Grouped by tile, so a cell is one row however many steps there are; steps are worked off
    one at a time, on a grid of the tile's size.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, cols = np.asarray(group.column("r"), np.int64), np.asarray(group.column("c"), np.int64)
        rows, cols = rows - rows.min(), cols - cols.min()
        lists = group.column("pct").combine_chunks()
        have = np.asarray(lists.value_lengths().fill_null(0), np.int64) == length
        pct = np.zeros((len(rows), length))
        pct[have] = np.nan_to_num(np.asarray(lists.filter(pa.array(have)).flatten().cast(pa.float64()), np.float64)).reshape(-1, length)
        cover = np.clip(np.where((pct > 100) & (not strict), 0, pct) / 100, 0, 0.999)
        keep = np.flatnonzero(np.asarray(group.column("valid")))
        out = {n: np.empty((len(keep), length)) for n in features}
        for t in range(length):
            grid = np.zeros((rows.max() + 1, cols.max() + 1))
            grid[rows, cols] = cover[:, t]
            for n, m in zip(features, _made(grid, features, radius, metres, none)):
                out[n][:, t] = m[rows[keep], cols[keep]]
        edges = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * length)
        return pa.table({"pid": group.column("pid").take(pa.array(keep))} | {n: pa.ListArray.from_arrays(edges, pa.array(v.ravel())) for n, v in out.items()})

    kinds = f"pid {cells.schema['pid'].dataType.simpleString()}, {', '.join(f'{n} array<double>' for n in features)}"
    return cells.select("pid", "tile_id", "r", "c", "valid", "pct").groupBy("tile_id").applyInArrow(run, kinds)


def dynamic_transitions(x: Column, weights: np.ndarray) -> Column:
    """T2, T3 in Spark SQL: array<array<double>> (K, K) of log-probabilities for one feature vector."""
    k = weights.shape[0]

    def logits(i: int) -> Column:
        dots = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in vector]), lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y) for vector in weights[i]]
        return F.array(*dots[:i], F.lit(0.0), *dots[i:])

    def normal(row: Column) -> Column:
        return F.transform(F.array(row), lambda v: F.transform(F.array(F.struct(v.alias("v"), F.array_max(v).alias("m"))), lambda s: F.transform(s["v"], lambda y: y - s["m"] - F.ln(F.aggregate(s["v"], F.lit(0.0), lambda acc, z: acc + F.exp(z - s["m"]))))))[0][0]

    return F.array(*[normal(logits(i)) for i in range(k)])


def long_transitions(frame: DataFrame, weights: np.ndarray, keys: tuple[str, ...] = ("pid",), column: str = "x") -> DataFrame:
    """(keys, t, i, j, la) from stacked covariates, by the NumPy kernel."""
    from cambium.functions.kernels import dynamic_log_trans

    k, d = weights.shape[0], weights.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(column)
            many = np.asarray(lists.value_lengths(), np.int64)
            x = np.asarray(lists.flatten().flatten(), np.float64).reshape(1, -1, d)
            la = dynamic_log_trans(x, weights)[0].ravel()
            own = np.repeat(np.arange(len(many)), many)
            t = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            cells = len(own) * k * k
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(np.repeat(own, k * k))) for c in keys), pa.array(np.repeat(t, k * k).astype(np.int32)), pa.array((np.arange(cells) // k % k).astype(np.int32)), pa.array((np.arange(cells) % k).astype(np.int32)), pa.array(la)], [*keys, "t", "i", "j", "la"])

    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keys)
    return frame.select(*keys, column).mapInArrow(run, f"{kinds}, t int, i int, j int, la double")

"""Products and summaries of decoded series (K3, K4, A1-A9): expressions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.config import NODATA_STATE, NODATA_YEAR

#: First-year products: name and the state reached.
FIRST_YEAR = (("first_trace", 1), ("first_sparse", 2), ("first_open", 3), ("first_woodland", 4), ("first_forest", 5))


def first_year(states: Column, state: int, first: int) -> Column:
    """K4, A5: the first year at or above the state, null if never."""
    at = F.array_position(F.transform(states, lambda s: s >= state), True)
    return F.when(at > 0, (at - 1 + first).cast("smallint"))


def products(decoded: DataFrame, first: int = 1986, states: str = "states") -> DataFrame:
    """K4, A4: the five first-year columns and max_state, beside the other columns."""
    s = F.col(states)
    return decoded.withColumns({name: first_year(s, k, first) for name, k in FIRST_YEAR} | {"max_state": F.array_max(s)}).drop(states)


def at_sink(frame: DataFrame) -> DataFrame:
    """The codes that output tables carry for missing: -9999 in years, 255 in states and posteriors."""
    years = {name: F.coalesce(F.col(name), F.lit(NODATA_YEAR)).cast("smallint") for name, _ in FIRST_YEAR if name in frame.columns}
    states = {c: F.coalesce(F.col(c).cast("smallint"), F.lit(NODATA_STATE)).cast("smallint") for c in ("state", "max_state", "posterior") if c in frame.columns}
    return frame.withColumns(years | states)


def quantised(p: Column) -> Column:
    """K3: 0..200 from a probability, cut after rounding at the ninth digit."""
    return F.floor(F.least(F.greatest(F.round(p, 9) * 200, F.lit(0.0)), F.lit(200.0))).cast("smallint")


def uncertainty(best: Column) -> Column:
    """Bands of the largest posterior."""
    return F.when(best > 0.9, "high").when(best >= 0.6, "moderate").otherwise("low")


def year_summary(states: DataFrame, n_states: int, year: str = "year", state: str = "state") -> DataFrame:
    """A1: (year, state, n, n_valid, n_nodata, fraction): a row for every year and state, states without cells too.

    The input is aggregated to a row a year, with a counter a state; the rows of states are made from that.
    """
    counts = states.groupBy(year).agg(F.array(*[F.count_if(F.col(state) == k) for k in range(n_states)]).alias("_n"), F.count(state).alias("n_valid"), F.count_if(F.col(state).isNull()).alias("n_nodata"))
    each = counts.select(year, "n_valid", "n_nodata", F.posexplode("_n").alias("state", "n"))
    return each.select(year, "state", "n", "n_valid", "n_nodata", (F.col("n") / F.greatest("n_valid", F.lit(1))).alias("fraction"))


def first_year_summary(made: DataFrame) -> DataFrame:
    """A2: (product, n_pixels, mean, median, min, max) over reached years; products that no cell reaches have no row."""
    years = F.array(*[F.struct(F.lit(name).alias("product"), F.col(name).alias("y")) for name, _ in FIRST_YEAR])
    long = made.select(F.explode(years).alias("_p")).select("_p.product", "_p.y").where("y is not null")
    return long.groupBy("product").agg(F.count("*").alias("n_pixels"), F.avg("y").alias("mean"), F.median("y").alias("median"), F.min("y").alias("min"), F.max("y").alias("max"))


def hard_transitions(decoded: DataFrame, states: str = "states") -> DataFrame:
    """(i, j, n) counted from decoded states; pairs are made within a row, counted map-side first."""
    s = F.col(states)
    pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.cast("int").alias("i"), b.cast("int").alias("j")))
    return decoded.select(F.explode(pairs).alias("_p")).groupBy(F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).agg(F.count("*").alias("n"))


def summary(decoded: DataFrame, n_states: int, first: int = 1986) -> dict[str, DataFrame]:
    """A3: both summaries of a table (pid, states)."""
    states = decoded.select(F.posexplode("states").alias("t", "state")).select((F.col("t") + first).alias("year"), "state")
    return {"years": year_summary(states, n_states), "first_years": first_year_summary(products(decoded, first))}

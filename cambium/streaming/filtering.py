"""The forward filter on a stream: each entity's state probabilities after every step seen (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cambium.functions.emission import MISSING, zib_table
from cambium.functions.params import HMMParams

OUTPUT = "pid long, t int, state int, p double, log_lik double"
STATE = "t int, log_lik double, alpha array<double>"


def filtered(stream: DataFrame, params: HMMParams) -> DataFrame:
    """stream (pid, t, pct) -> (pid, t, state, p, log_lik): the likeliest state given the steps up to t.

    State of an entity: the last step, its filtered probabilities and the likelihood. Steps must come in order; a step
    at or before the last one is dropped, a gap moves the probabilities by as many transitions. A step that occurs
    twice in a batch counts once (the largest value); a null or out-of-range value tells nothing.
    """
    table, a, start = np.exp(zib_table(params.emission)), np.exp(params.log_trans), np.exp(params.log_init)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, likelihood, alpha = state.get if state.exists else (None, 0.0, None)
        rows = []
        points = pd.concat(list(frames)).dropna(subset=["t"]).groupby("t")["pct"].max().sort_index()
        for t, pct in points.items():
            t = int(t)
            if last is not None and t <= last:
                continue
            prior = start if alpha is None else np.asarray(alpha) @ np.linalg.matrix_power(a, t - last)
            joint = prior * table[MISSING if pd.isna(pct) or not 0 <= pct <= 100 else int(pct)]
            scale = max(joint.sum(), np.finfo(np.float64).tiny)
            alpha, likelihood, last = joint / scale, likelihood + float(np.log(scale)), t
            rows.append((key[0], t, int(alpha.argmax()), float(alpha.max()), likelihood))
        if last is not None:
            state.update((last, likelihood, [float(v) for v in alpha]))
        if rows:
            yield pd.DataFrame(rows, columns=["pid", "t", "state", "p", "log_lik"])

    return stream.groupBy("pid").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

"""Memory of a batch, and the batch that fits."""

from __future__ import annotations

MB = 1024.0 * 1024.0


def estimate(n: int, steps: int = 35, states: int = 5, features: int = 10, pairs: bool = False) -> dict[str, float]:
    """MB of 32-bit arrays for n series, by component and in total; pairs adds the expected transitions."""
    step, moves = n * steps * 4 / MB, n * (steps - 1) * 4 / MB
    parts = {"observations": step, "states_out": step, "covariates": moves * features}
    parts |= dict.fromkeys(("emissions", "alpha", "beta", "posteriors", "posteriors_out"), step * states)
    if pairs:
        parts["pairs"] = moves * states * states
    return parts | {"total": sum(parts.values())}


def batch_size(memory_gb: float = 80.0, steps: int = 35, states: int = 5, features: int = 10, pairs: bool = False, safety: float = 0.7) -> int:
    """Series of which a batch fits into `safety` of the memory; for spark.sql.execution.arrow.maxRecordsPerBatch."""
    return int(memory_gb * 1024 * safety / estimate(1, steps, states, features, pairs)["total"])

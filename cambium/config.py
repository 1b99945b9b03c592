"""Settings, as frozen dataclasses, and the constants that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Names of the six states in order.
STATE_NAMES = ("Bare", "Trace", "Sparse", "Open", "Woodland", "Forest")
NODATA_STATE, NODATA_YEAR, MISSING_COVER = 255, -9999, 255


@dataclass(frozen=True)
class EMConfig:
    max_iter: int = 100
    tol: float = 1e-4
    sample_size: int = 2_000_000
    sample_tiles: int = 200
    seed: int = 42
    lbfgs_maxiter: int = 50
    l2: float = 1e-3
    weight_iters: int = 20
    weight_tol: float = 1e-3


@dataclass(frozen=True)
class InferenceConfig:
    tile_size: int = 512
    posteriors: bool = True
    #: Tiles with a smaller share of valid cells are left out.
    min_valid: float = 0.01
    #: True: cover above 100 counts as 100 and mask 255 as valid; False: both count as missing.
    strict: bool = False


@dataclass(frozen=True)
class CovariateConfig:
    enabled: bool = False
    #: Names in the order of the feature vector, after the intercept; absent ones are dropped.
    names: tuple[str, ...] = ("fire_severity", "spei", "elevation", "chili", "aridity", "seed_distance", "focal_mean")
    seed_threshold: float = 0.04
    cell_metres: float = 30.0
    no_seed_metres: float = 50_000.0
    focal_radius: int = 5
    standardize: bool = False


@dataclass(frozen=True)
class IOConfig:
    """Tables under one root, and the inclusive range of years."""

    root: str = "data"
    output: str = "output"
    first_year: int = 1986
    last_year: int = 2024
    #: Covariate tables that must be there when covariates are enabled.
    tables: tuple[str, ...] = ("fire_severity", "spei", "elevation", "chili", "aridity")

    @property
    def years(self) -> tuple[int, ...]:
        return tuple(range(self.first_year, self.last_year + 1))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def covariate_paths(self, covariates: CovariateConfig) -> dict[str, str]:
        """Paths of the covariate tables; none unless covariates are enabled."""
        return {t: self.path(t) for t in self.tables if t in covariates.names} if covariates.enabled else {}


@dataclass(frozen=True)
class PipelineConfig:
    n_states: int = 6
    em: EMConfig = field(default_factory=EMConfig)
    inference: InferenceConfig = field(default_factory=InferenceConfig)
    covariates: CovariateConfig = field(default_factory=CovariateConfig)
    io: IOConfig = field(default_factory=IOConfig)

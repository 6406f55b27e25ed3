"""Settings of the profile operators; their values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PrepConfig:
    T: int = 70
    min_profile_months: int = 12
    prod_threshold_abs: float = 0.01
    prod_threshold_rel: float = 0.01
    smooth_window: int = 5
    smooth_poly: int = 2
    winsorize_low: float = 0.01
    winsorize_high: float = 0.99
    normalize_by_peak: bool = True
    eps: float = 1e-9
    clamp_nonnegative: bool = True
    interpolate_gaps: bool = True
    tensor_channels: tuple[str, ...] = ("r_oil_norm", "wc", "gor", "dr_oil_norm")
    #: "reference": from the start of the previous month to the end of this one; "calendar": the month's own days.
    days_mode: str = "reference"


@dataclass(frozen=True)
class ForecastConfig:
    T: int = 70
    T_pref: int = 20
    K: int = 15
    q: float = 0.90
    eps: float = 1e-9
    clip_max: float = 3.0


@dataclass(frozen=True)
class ManifoldConfig:
    channels: tuple[str, ...] = ("r_oil_norm", "wc")
    channel_weights: tuple[float, ...] = (0.7, 0.3)
    #: Warped distances: "exact", or "refined" within radius of the path of coarser series, for long ones.
    warp: str = "exact"
    radius: int = 6
    k_refine: int = 40
    n_neighbors: int = 30
    min_dist: float = 0.05
    n_components: int = 2
    seed: int = 43
    #: Rounds of forces over all edges; None: 500 up to 10,000 profiles, 200 beyond.
    epochs: int | None = None


@dataclass(frozen=True)
class ClusterConfig:
    min_cluster_size: int = 50
    min_samples: int = 12
    cluster_selection_epsilon: float = 0.0
    allow_single_cluster: bool = False
    lof_neighbors: int = 30


@dataclass(frozen=True)
class BaselineConfig:
    signal: str = "bopd"
    start_fraction: float = 0.05
    min_consec: int = 1
    horizon: int = 70
    clip_quantile: float = 0.995

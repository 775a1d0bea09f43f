"""Parameters of the analysis, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# The numeric definitions the results depend on.
EPS = 1e-10

REQUIRED_COLUMNS = (
    "machine_id",
    "time",
    "average_usage",
    "maximum_usage",
    "resource_request",
    "assigned_memory",
)
CRITICAL_COLUMNS = ("machine_id", "time", "average_usage")
TIME_COLUMNS = ("time", "start_time", "end_time")
METRIC_COLUMNS = (
    "resource_request",
    "average_usage",
    "maximum_usage",
    "random_sample_usage",
    "assigned_memory",
    "page_cache_memory",
    "cycles_per_instruction",
    "memory_accesses_per_instruction",
)
OUTLIER_COLUMNS = ("average_usage", "maximum_usage", "resource_request")
FEATURE_COLUMNS = (
    "cpu_mean",
    "cpu_std",
    "cpu_cv",
    "peak_usage",
    "over_provision_ratio",
    "memory_mean",
)
RADAR_COLUMNS = (
    "cpu_mean_mean",
    "cpu_cv_mean",
    "over_provision_ratio_mean",
    "memory_mean_mean",
)

# workload type -> (model strategy, name shown in reports)
STRATEGIES = {
    "stable_low_load": ("arima", "ARIMA"),
    "periodic": ("seasonal_arima", "Seasonal_ARIMA"),
    "bursty": ("lstm", "LSTM"),
    "volatile": ("conservative", "Conservative_Baseline"),
}
DEFAULT_STRATEGY = ("arima", "ARIMA")


@dataclass(frozen=True)
class Pricing:
    cpu_hour: float = 0.05
    memory_gb_hour: float = 0.01
    interval_minutes: int = 5

    @property
    def hours(self) -> float:
        return self.interval_minutes / 60


@dataclass(frozen=True)
class Policy:
    """Prediction-driven scaling: one multiplicative step up or down."""

    up: float = 0.75
    down: float = 0.40
    factor: float = 1.25
    floor: float = 0.1
    ceiling: float = 1.0
    guard: float = 1.2  # never scale below guard * predicted usage
    start: float = 1.3  # starting capacity relative to the first known value


@dataclass(frozen=True)
class Autoscaler:
    """Reactive threshold scaling."""

    up: float = 0.8
    down: float = 0.3
    factor: float = 1.25
    floor: float = 0.1
    ceiling: float = 1.0
    start: float = 1.5
    cooldown: int = 3
    guard: float = 1.2


@dataclass(frozen=True)
class Forecasting:
    order: tuple = (5, 1, 0)
    season: int = 12
    lookback: int = 12
    alpha: float = 0.3
    percentile: float = 0.75
    unknown_machine: float = 0.5
    min_points: int = 20  # shorter series repeat their last value
    train_share: float = 0.8


@dataclass(frozen=True)
class Clustering:
    k: int = 4
    restarts: int = 10
    max_iter: int = 300
    seed: int = 42
    eps: float = 0.5
    min_samples: int = 10


SLA_LIMIT = 0.95
BACKTEST_LIMIT = 0.9
STATIC_BUFFER = 1.2
MOVING_AVERAGE_WINDOW = 12
ORACLE_BUFFER = 1.1
CAPACITY_FLOOR = 0.1

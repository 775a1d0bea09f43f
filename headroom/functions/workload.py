"""Workload types and the forecast strategy chosen for each."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from headroom.params import DEFAULT_STRATEGY, STRATEGIES


def workload_type(cpu_mean: Column, cpu_cv: Column) -> Column:
    """Type of a cluster from its mean load and variability; a missing input counts as 0.5."""
    mean, cv = F.coalesce(cpu_mean, F.lit(0.5)), F.coalesce(cpu_cv, F.lit(0.5))
    return (
        F.when((mean < 0.3) & (cv < 0.3), "stable_low_load")
        .when((cv > 0.6) & (mean > 0.5), "volatile")
        .when(cv > 0.6, "bursty")
        .otherwise("periodic")
    )


def _lookup(kind: Column, position: int) -> Column:
    out = F.lit(DEFAULT_STRATEGY[position])
    for name, strategy in STRATEGIES.items():
        out = F.when(kind == name, strategy[position]).otherwise(out)
    return out


def model_strategy(kind: Column) -> Column:
    return _lookup(kind, 0)


def report_strategy(kind: Column) -> Column:
    return _lookup(kind, 1)

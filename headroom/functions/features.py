"""Row-level features of the windowed table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from headroom.params import EPS


def temporal_features(df: DataFrame, time: str = "time") -> DataFrame:
    """Cyclic hour and weekday (Monday = 0), weekend and business-hours flags."""
    if time not in df.columns:
        return df
    hour, day = F.hour(time), F.weekday(F.col(time))
    turn = 2 * math.pi
    return df.withColumns(
        {
            "hour_sin": F.sin(turn * hour / 24),
            "hour_cos": F.cos(turn * hour / 24),
            "dow_sin": F.sin(turn * day / 7),
            "dow_cos": F.cos(turn * day / 7),
            "is_weekend": (day >= 5).cast("int"),
            "is_business_hours": hour.between(9, 17).cast("int"),
        }
    )


def burstiness(mean: Column, peak: Column) -> Column:
    return (peak - mean) / (mean + EPS)


def stability(mean: Column, std: Column) -> Column:
    return 1 / (1 + std / (mean + EPS))


def workload_features(df: DataFrame) -> DataFrame:
    """Burstiness and stability per window, from the columns that exist."""
    have = set(df.columns)
    mean = F.col("average_usage_mean")
    out = {}
    if {"average_usage_mean", "maximum_usage_max"} <= have:
        out["burstiness"] = burstiness(mean, F.col("maximum_usage_max"))
    if {"average_usage_mean", "average_usage_std"} <= have:
        out["stability"] = stability(mean, F.col("average_usage_std"))
    return df.withColumns(out) if out else df


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def over_provisioning_columns(df: DataFrame) -> DataFrame:
    """Request/usage ratio, wasted resources and efficiency per window."""
    if not {"resource_request_mean", "average_usage_mean"} <= set(df.columns):
        return df
    request, usage = F.col("resource_request_mean"), F.col("average_usage_mean")
    return df.withColumns(
        {
            "over_provision_ratio": request / (usage + EPS),
            "wasted_resources": clip(request - usage, high=float("inf")),
            "utilization_efficiency": clip(usage / (request + EPS)),
        }
    )


def finite(value: Column) -> Column:
    """NaN and null to 0, +infinity to 1, -infinity to 0."""
    inf = float("inf")
    return (
        F.when(value.isNull() | F.isnan(value), 0.0)
        .when(value == inf, 1.0)
        .when(value == -inf, 0.0)
        .otherwise(value)
    )

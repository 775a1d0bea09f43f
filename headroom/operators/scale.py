"""Standardised feature table for clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from headroom.functions.features import finite
from headroom.params import FEATURE_COLUMNS
from headroom.session import stage


def available_features(columns: Sequence[str]) -> list[str]:
    names = [c for c in FEATURE_COLUMNS if c in columns]
    if not names:
        raise ValueError("no clustering features among the columns")
    return names


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean, over its population deviation.

    A constant column only loses its mean.  The two passes of the deviation
    are one row each and enter as scalar subqueries.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {
            c: (F.col(c) - stats[f"m_{c}"])
            / F.when(stats[f"s_{c}"] == 0, 1.0).otherwise(stats[f"s_{c}"])
            for c in columns
        }
    )


def scaled_features(profiles: DataFrame, key: str = "machine_id") -> DataFrame:
    """(machine, features...) ready for clustering.

    The raw features, one row per machine, are written once: both the
    statistics and the scaling read them.
    """
    names = available_features(profiles.columns)
    clean = profiles.select(key, *[finite(F.col(c)).alias(c) for c in names])
    return standardise(stage(clean, "raw-features"), names)

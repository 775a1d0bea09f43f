"""Metric text, epoch times and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROSECOND_MEAN = 1e12  # a larger mean epoch value is read as microseconds


def parse_metric(text: Column) -> Column:
    """A number, the ``cpus`` entry of a map, or the mean of a list; else 0.

    Works on strings such as ``0.7``, ``{'cpus': 0.1, 'memory': 0.2}`` and
    ``[0.1, 0.3]``.  A missing value stays missing.
    """
    number = text.try_cast("double")
    cpus = F.from_json(text, "cpus double").getField("cpus")
    values = F.from_json(text, "array<double>")
    mean = F.when(
        F.size(values) > 0,
        F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0)),
    )
    is_list = F.ltrim(text).startswith("[")
    value = F.coalesce(number, F.when(is_list, mean).otherwise(cpus), F.lit(0.0))
    return F.when(F.trim(text) != "", F.nullif(value, F.lit(float("nan"))))


def numeric_or_null(text: Column) -> Column:
    return F.nullif(text.try_cast("double"), F.lit(float("nan")))


def epoch_to_timestamp(epoch: Column, unit: str) -> Column:
    """Epoch seconds (``s``) or microseconds (``us``) as a zone-free timestamp in UTC."""
    value = epoch.try_cast("double")
    micros = value if unit == "us" else value * 1_000_000
    return F.convert_timezone(
        F.current_timezone(),
        F.lit("UTC"),
        F.timestamp_micros(micros.try_cast("long")).cast("timestamp_ntz"),
    )


def normalise_timestamp(column: Column) -> Column:
    """Text to timestamp; what cannot be read becomes null."""
    return F.try_to_timestamp(column.cast("string")).cast("timestamp_ntz")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds from one zone-free timestamp to another, with microseconds."""
    return micros_between(earlier, later) / 1_000_000


def micros_between(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))

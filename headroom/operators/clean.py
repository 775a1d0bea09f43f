"""Cleaning of the raw trace: gaps, invalid rows, outliers, timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from headroom.functions.parse import normalise_timestamp
from headroom.operators.ordered import BROADCAST_ROWS, CHUNK, order_chunks
from headroom.operators.quantiles import exact_quantiles
from headroom.params import CRITICAL_COLUMNS, OUTLIER_COLUMNS, TIME_COLUMNS
from headroom.session import stage

WHOLE_ROWS = 500_000  # machines with more rows are filled chunk by chunk


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def drop_critical_nulls(df: DataFrame) -> DataFrame:
    have = [c for c in CRITICAL_COLUMNS if c in df.columns]
    return df.dropna(subset=have) if have else df


def other_columns(df: DataFrame, *known: str) -> list[str]:
    """All further columns that have an order, for rows alike in the known ones."""
    no_order = (T.MapType, T.VariantType)
    return [f.name for f in df.schema if f.name not in known and not isinstance(f.dataType, no_order)]


def _looked_over(df: DataFrame, columns: Sequence[str], key: str) -> tuple[list[str], int]:
    """The columns that have anything to fill and the rows of the largest machine; rows are counted, not moved."""
    if not columns:
        return [], 0
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]
    counted = df.groupBy(F.col(key).alias("_machine")).agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    largest, *found = counted.agg(F.max("_rows"), *[F.sum(f"_n{i}") for i in range(len(columns))]).first()
    return [c for c, n in zip(columns, found, strict=True) if n], largest or 0


def fill_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    key: str = "machine_id",
    time: str = "time",
    ties: Sequence[str] | None = None,
    width: str = "1 day",
    limit: int = 5_000_000,
) -> DataFrame:
    """Per machine and in time order: forward fill, backward fill, then 0.

    After a forward fill only the rows before a machine's first known value
    are still empty, so the backward fill is that first value.  A machine of
    up to ``WHOLE_ROWS`` (or ``limit``) rows is filled in one go.  Larger ones
    are filled inside chunks; the last known value of each chunk is carried to
    the following ones.  Rows of one instant follow ``ties``, or all other
    columns in turn, so that the result does not depend on how the rows came in.
    """
    df = drop_critical_nulls(df)
    named = set(ties or ())
    ties = other_columns(df, key, time) if ties is None else ties
    skip = {key, time, *CRITICAL_COLUMNS, *named}
    columns = [c for c in (columns or numeric_columns(df)) if c not in skip]
    columns, largest = _looked_over(df, columns, key)
    if not columns:
        return df
    whole = min(limit, WHOLE_ROWS)
    if largest <= whole:
        return _fill_machines(df, columns, key, [time, *ties])
    large = df.groupBy(key).count().filter(F.col("count") > whole).select(key)
    large = stage(large, "large-machines")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    rest = _fill_machines(df.join(large, key, "left_anti"), columns, key, [time, *ties])
    chunked = _fill_chunks(df.join(large, key, "left_semi"), columns, key, time, ties, width, limit)
    return rest.unionByName(chunked)


def _or_zero(df: DataFrame, column: str, *values: Column) -> Column:
    return F.coalesce(*values, F.lit(0).cast(df.schema[column].dataType))


def _fill_machines(df: DataFrame, columns: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """Machines that fit a window as a whole: one shuffle and one sort of the rows."""
    machine = Window.partitionBy(key).orderBy(*order)
    upto = machine.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everywhere = machine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        *[
            _or_zero(
                df, c, F.last(c, ignorenulls=True).over(upto), F.first(c, ignorenulls=True).over(everywhere)
            ).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def _fill_chunks(
    df: DataFrame, columns: Sequence[str], key: str, time: str, ties: Sequence[str], width: str, limit: int
) -> DataFrame:
    """Machines of any size, chunk by chunk of their order."""
    chunks = order_chunks(df, key, time, ties, width, limit)
    order = [time, *ties]
    inside = (
        Window.partitionBy(key, *CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))

    edges = chunks.groupBy(key, *CHUNK).agg(
        *[F.max(known(c))["v"].alias(f"_last_{c}") for c in columns],
        *[F.min(known(c))["v"].alias(f"_first_{c}") for c in columns],
    )
    machine = Window.partitionBy(key).orderBy(*CHUNK)
    earlier = machine.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.desc("_bucket"), F.desc("_slice"))
    carried = edges.select(
        key,
        *CHUNK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
        *[
            F.last(f"_first_{c}", ignorenulls=True)
            .over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            .alias(f"_next_{c}")
            for c in columns
        ],
    )
    # shares the (machine, chunk) partitioning of the window below
    joined = chunks.withColumns(
        {f"_fwd_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns}
    ).join(carried, [key, *CHUNK])
    return joined.select(
        *[
            _or_zero(df, c, F.col(f"_fwd_{c}"), F.col(f"_carry_{c}"), F.col(f"_next_{c}")).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def valid_row(columns: Sequence[str]) -> Column:
    """The row filter; a null metric counts as the 0 it would be filled with."""
    ok = F.lit(True)
    if "average_usage" in columns:
        ok = ok & F.coalesce(F.col("average_usage"), F.lit(0.0)).between(0.0, 1.5)
    if "maximum_usage" in columns:
        ok = ok & (F.coalesce(F.col("maximum_usage"), F.lit(0.0)) >= 0.0)
    if {"start_time", "end_time"} <= set(columns):
        ok = ok & F.coalesce(F.col("end_time") > F.col("start_time"), F.lit(False))
    return ok


def remove_invalid(df: DataFrame) -> DataFrame:
    """Keep rows with usable values and a positive duration."""
    return df.filter(valid_row(df.columns))


def outlier_bounds(
    df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, **narrowing
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound of each column over all rows; ``narrowing`` goes to the quantiles."""
    columns = [c for c in (columns or OUTLIER_COLUMNS) if c in df.columns]
    if method == "iqr":
        bounds = {}
        for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75], **narrowing).items():
            bounds[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        return bounds
    if method != "zscore":
        raise ValueError(f"unknown outlier method: {method}")
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    ).first()
    nan = float("nan")
    out = {}
    for c in columns:
        mean, std = row[f"m_{c}"], row[f"s_{c}"]
        known = mean is not None and std is not None
        out[c] = (mean - 3 * std, mean + 3 * std) if known else (nan, nan)
    return out


def cap_to_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Limit each column to [max(0, lower), upper]; undefined bounds change nothing."""
    capped = {}
    for c, (low, high) in bounds.items():
        if low == low and high == high:
            floor = max(0.0, low)
            value = F.least(F.greatest(F.col(c), F.lit(floor)), F.lit(high))
            capped[c] = F.when(F.col(c).isNotNull(), value)
    return df.withColumns(capped) if capped else df


def cap_outliers(
    df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, **narrowing
) -> DataFrame:
    """Cap, never drop, values outside the bounds over all rows."""
    return cap_to_bounds(df, outlier_bounds(df, method, columns, **narrowing))


def normalise_times(df: DataFrame) -> DataFrame:
    """Turn text time columns into timestamps, unreadable ones into null."""
    text = {
        c: normalise_timestamp(F.col(c))
        for c in TIME_COLUMNS
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)
    }
    return df.withColumns(text) if text else df


def _clean(df: DataFrame, ties: Sequence[str] | None, method: str, **chunking):
    filled = fill_missing(df, ties=ties, **chunking)
    valid = stage(remove_invalid(filled), "valid-rows")
    return valid, outlier_bounds(valid, method)


def clean_trace(
    df: DataFrame, ties: Sequence[str] | None = None, method: str = "iqr", **chunking
) -> DataFrame:
    """Fill, remove invalid rows, cap outliers, normalise timestamps.

    The rows are not sorted; consumers that need an order ask for it.
    """
    valid, bounds = _clean(df, ties, method, **chunking)
    return normalise_times(cap_to_bounds(valid, bounds))


def _nulls(columns: Sequence[str]) -> Column:
    """How many of the columns are null in a row."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("long")
    return total


def cleaning_report(
    df: DataFrame, ties: Sequence[str] | None = None, method: str = "iqr", **chunking
) -> DataFrame:
    """How many cells and rows each cleaning stage touched: (metric, value)."""
    numeric = numeric_columns(df)

    present = F.lit(True)
    for c in CRITICAL_COLUMNS:
        if c in df.columns:
            present = present & F.col(c).isNotNull()
    others = [c for c in df.columns if c not in numeric]
    before = df.agg(
        F.sum(_nulls(df.columns)).alias("nulls"),
        F.coalesce(F.sum(F.when(present, _nulls(others))), F.lit(0)).alias("left"),
        F.count_if(present).alias("rows"),
    )
    valid, bounds = _clean(df, ties, method, **chunking)
    outside = F.lit(0)
    for c, (low, high) in bounds.items():
        outside = outside + ((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))).cast("long")
    end = valid.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.sum(outside).alias("capped"))).scalar()
    values = {
        "missing_values_handled": F.col("nulls") - F.col("left"),
        "invalid_rows_removed": F.col("rows") - end["rows"],
        "outliers_capped": end["capped"],
    }
    lines = [
        F.struct(F.lit(name).alias("metric"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))
        for name, value in values.items()
    ]
    return before.select(F.inline(F.array(*lines)))

"""Time windows, machine profiles and the per-machine series.

Raw rows are only ever grouped here, with partial aggregation before the
shuffle.  After ``window_aggregate`` a machine has at most one row per time
window, so a machine's series is bounded by the length of the trace, however
many raw rows it had; windows over ``machine_id`` are used on such tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.functions.parse import micros_between
from headroom.operators.ordered import CHUNK, order_chunks
from headroom.params import EPS, Forecasting
from headroom.session import stage

# The statistics kept per window.
WINDOW_STATISTICS = {
    "average_usage": ("mean", "std", "min", "max"),
    "maximum_usage": ("mean", "max"),
    "resource_request": ("mean", "max"),
    "assigned_memory": ("mean",),
    "page_cache_memory": ("mean",),
    "cycles_per_instruction": ("mean",),
    "memory_accesses_per_instruction": ("mean",),
}
_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def window_start(time: str, minutes: int) -> Column:
    """Start of the tumbling window, counted from the epoch."""
    return F.window(F.col(time), f"{minutes} minutes")["start"]


def window_statistics(columns: Sequence[str]) -> list[Column]:
    return [
        _AGGREGATES[name](column).alias(f"{column}_{name}")
        for column, names in WINDOW_STATISTICS.items()
        if column in columns
        for name in names
    ]


def window_aggregate(
    df: DataFrame, minutes: int = 5, key: str = "machine_id", time: str = "time"
) -> DataFrame:
    """One row per machine and time window, from the metrics that exist."""
    return df.groupBy(key, window_start(time, minutes).alias("time")).agg(*window_statistics(df.columns))


def machine_profiles(windowed: DataFrame, key: str = "machine_id") -> DataFrame:
    """One row per machine: usage statistics, ratios and the number of windows."""
    have = set(windowed.columns)
    aggs = []
    if "average_usage_mean" in have:
        use = "average_usage_mean"
        aggs += [
            F.avg(use).alias("cpu_mean"),
            F.stddev_samp(use).alias("cpu_std"),
            F.max(use).alias("cpu_max"),
            F.min(use).alias("cpu_min"),
        ]
    if "maximum_usage_max" in have:
        aggs.append(F.max("maximum_usage_max").alias("peak_usage"))
    for source, name in (
        ("resource_request_mean", "request_mean"),
        ("assigned_memory_mean", "memory_mean"),
        ("cycles_per_instruction_mean", "cpi_mean"),
    ):
        if source in have:
            aggs.append(F.avg(source).alias(name))
    out = windowed.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("n_observations"))
    if "average_usage_mean" in have:
        out = out.withColumn("cpu_cv", F.col("cpu_std") / (F.col("cpu_mean") + EPS))
        if "resource_request_mean" in have:
            out = out.withColumn("over_provision_ratio", F.col("request_mean") / (F.col("cpu_mean") + EPS))
    return out


def usage_series(
    windowed: DataFrame, value: str = "average_usage_mean", key: str = "machine_id", time: str = "time"
) -> DataFrame:
    """(machine, step, time, y): steps count from 0 in time order."""
    step = F.row_number().over(Window.partitionBy(key).orderBy(time)).cast("long") - 1
    return windowed.select(key, step.alias("step"), time, F.col(value).alias("y"))


def lag_sequences(
    series: DataFrame, lookback: int = 12, key: str = "machine_id", order: str = "step", y: str = "y"
) -> DataFrame:
    """Each value with the ``lookback`` values before it, oldest first."""
    machine = Window.partitionBy(key).orderBy(order)
    lags = [F.lag(y, i).over(machine) for i in range(lookback, 0, -1)]
    rank = F.row_number().over(machine)
    return (
        series.select(key, order, F.array(*lags).alias("x"), F.col(y).alias("target"), rank.alias("_n"))
        .filter(F.col("_n") > lookback)
        .drop("_n")
    )


def keep_long_series(series: DataFrame, at_least: int, key: str = "machine_id") -> DataFrame:
    """Rows of the machines with at least that many windows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return series.withColumn("_n", n).filter(F.col("_n") >= at_least).drop("_n")


def train_test_split(
    series: DataFrame,
    share: float = Forecasting.train_share,
    test_steps: int | None = None,
    key: str = "machine_id",
    order: str = "step",
) -> DataFrame:
    """Mark each row ``train`` or ``test`` in time order, with ``h`` = 1.. in the test part.

    The test part is the rest of the series; ``test_steps`` limits it.
    """
    machine = Window.partitionBy(key)
    cut = F.floor(F.count(F.lit(1)).over(machine) * share)
    at = F.row_number().over(machine.orderBy(order))
    h = (F.col("_at") - F.col("_cut")).cast("int")
    out = series.withColumns({"_cut": cut, "_at": at}).withColumns(
        {
            "part": F.when(h <= 0, "train").otherwise("test"),
            "h": F.when(h > 0, h),
        }
    )
    if test_steps is not None:
        out = out.filter(F.col("h").isNull() | (F.col("h") <= test_steps))
    return out.drop("_cut", "_at")


def last_values(series: DataFrame, key: str = "machine_id", order: str = "step", y: str = "y") -> DataFrame:
    return series.groupBy(key).agg(F.max_by(y, order).alias("last_value"))


# --- reports over the raw trace ---------------------------------------------


def density_report(df: DataFrame, key: str = "machine_id", time: str = "time") -> DataFrame:
    """Rows, time span in seconds and distinct machines."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(time).alias("time_start"),
        F.max(time).alias("time_end"),
        (micros_between(F.min(time), F.max(time)) / 1_000_000).alias("duration_seconds"),
        F.count_distinct(key).alias("unique_machines"),
    )


def rows_per_machine(df: DataFrame, key: str = "machine_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def top_machines(counts: DataFrame, n: int = 10, by: str = "n_rows", key: str = "machine_id") -> DataFrame:
    """The machines with the largest counts; the id breaks ties."""
    return counts.orderBy(F.desc(by), key).limit(n)


def busiest_machine(df: DataFrame, key: str = "machine_id") -> DataFrame:
    return top_machines(rows_per_machine(df, key), 1, key=key)


def time_gaps(
    df: DataFrame,
    key: str = "machine_id",
    time: str = "time",
    width: str = "1 day",
    limit: int = 5_000_000,
) -> DataFrame:
    """Gaps between consecutive samples of a machine: (machine, gap_micros, n).

    Equal times are counted before the shuffle and give gaps of 0.  Distinct
    times are compared inside chunks of a machine, and the ends of
    neighbouring chunks with each other.
    """
    moments = df.filter(F.col(time).isNotNull()).groupBy(key, time).agg(F.count(F.lit(1)).alias("n"))
    chunks = order_chunks(stage(moments, "moments"), key, time, (), width, limit)
    inside = Window.partitionBy(key, *CHUNK).orderBy(time)
    gap = micros_between(F.lag(time).over(inside), F.col(time))
    within = chunks.select(key, "n", gap.alias("gap")).select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("long").alias("gap_micros"), (F.col("n") - 1).alias("n")),
                F.struct(F.col("gap").alias("gap_micros"), F.lit(1).cast("long").alias("n")),
            )
        ),
    )
    ends = chunks.groupBy(key, *CHUNK).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    before = F.lag("last").over(Window.partitionBy(key).orderBy(*CHUNK))
    between = ends.select(
        key, micros_between(before, F.col("first")).alias("gap_micros"), F.lit(1).cast("long").alias("n")
    )
    return (
        within.unionByName(between)
        .filter(F.col("gap_micros").isNotNull() & (F.col("n") > 0))
        .groupBy(key, "gap_micros")
        .agg(F.sum("n").alias("n"))
    )


def describe_gaps(gaps: DataFrame, key: str = "machine_id") -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the gaps in seconds.

    A machine has few distinct gap lengths: their sum cannot exceed the length
    of the trace, so there are at most sqrt(2 * length in microseconds).
    """
    gap, n = F.col("gap_micros") / 1_000_000, F.col("n")
    count = F.sum(n)
    mean = F.sum(gap * n) / count
    squares = F.sum(gap * gap * n) - count * mean * mean
    q = F.percentile(gap, [0.25, 0.5, 0.75], n)
    return (
        gaps.groupBy(key)
        .agg(
            count.alias("n_gaps"),
            mean.alias("mean_gap"),
            F.when(count > 1, F.sqrt(F.greatest(F.lit(0.0), squares) / F.nullif(count - 1, F.lit(0)))).alias("std_gap"),
            F.min(gap).alias("min_gap"),
            q.alias("q"),
            F.max(gap).alias("max_gap"),
        )
        .select(
            key,
            "n_gaps",
            "mean_gap",
            "std_gap",
            "min_gap",
            F.col("q")[0].alias("q25"),
            F.col("q")[1].alias("q50"),
            F.col("q")[2].alias("q75"),
            "max_gap",
        )
    )

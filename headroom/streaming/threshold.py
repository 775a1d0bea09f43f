"""The threshold autoscaler as keyed state on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from headroom.operators.capacity import autoscaler_step
from headroom.params import Autoscaler
from headroom.session import stage_path
from headroom.streaming.windows import read_trace_stream, run_available


def stream_threshold(
    stream: DataFrame,
    settings: Autoscaler = Autoscaler(),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Capacity after each usage value, starting at 1.5 times a machine's first one.

    The step is the one of the batch fold.  Within a micro-batch rows are taken
    in order; batches must arrive in order.
    """

    def advance(
        keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        usage = rows[y].tolist()
        capacity, wait = state.get if state.exists else (usage[0] * settings.start, 0)
        out = []
        for value in usage:
            capacity, wait = map(float, autoscaler_step(capacity, wait, value, settings))
            out.append(capacity)
        state.update((float(capacity), int(wait)))
        yield pd.DataFrame({key: [keys[0]] * len(out), order: rows[order].tolist(), y: usage, "capacity": out})

    kinds = dict(stream.dtypes)
    return stream.select(key, order, y).groupBy(key).applyInPandasWithState(
        advance,
        f"{key} {kinds[key]}, {order} {kinds[order]}, {y} double, capacity double",
        "capacity double, wait int",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def threshold_by_stream(
    series: DataFrame, settings: Autoscaler = Autoscaler(), files_per_batch: int | None = None
) -> DataFrame:
    """Feed a finite series through the stream and return every capacity."""
    spark = series.sparkSession
    folder, out, state = (stage_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    series.write.parquet(folder)
    stream = stream_threshold(read_trace_stream(spark, folder, series, files_per_batch), settings)
    run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)

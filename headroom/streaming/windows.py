"""Window aggregation on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headroom.operators.windows import window_statistics
from headroom.session import stage, stage_path


def read_trace_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files that appear in ``folder``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_window_aggregate(
    stream: DataFrame,
    minutes: int = 5,
    delay: str = "1 hour",
    key: str = "machine_id",
    time: str = "time",
    by: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """``window_aggregate`` with a watermark: rows later than ``delay`` are left out.

    ``by`` and ``extra`` are further keys and further aggregates.
    Watermarks need timestamps with a zone, so zone-free times are read in the
    session's zone and given back without one.
    """
    zone_free = dict(stream.dtypes)[time] == "timestamp_ntz"
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    # the watermark stays with the window column, so the start is taken afterwards
    grouped = timed.groupBy(key, *by, F.window(time, f"{minutes} minutes"))
    grouped = grouped.agg(*window_statistics(stream.columns), *extra)
    start = F.col("window.start").cast("timestamp_ntz") if zone_free else F.col("window.start")
    return grouped.withColumn("window", start).withColumnRenamed("window", "time")


def run_available(stream: DataFrame, out: str, state: str) -> None:
    """Process what is there, append results to ``out``, stop.

    Input progress and operator state live in ``state`` next to the results, so
    a restarted run goes on where the last one ended.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


CLOSING, ROWS = "_closing", "_rows"


def closing_rows(table: DataFrame, time: str, minutes: int, delay: str) -> DataFrame:
    """One marked row, far enough in the future to close every open window."""
    behind = F.expr(f"interval {2 * minutes} minutes") + F.expr(f"interval {delay}")
    end = table.agg(F.max(time).alias("end")).filter("end IS NOT NULL").select((F.col("end") + behind).alias("end"))
    known = {time: F.col("end"), CLOSING: F.lit(True)}
    return end.select(*[known.get(c, F.lit(None).cast(table.schema[c].dataType)).alias(c) for c in table.columns])


def window_aggregate_by_stream(
    trace: DataFrame,
    minutes: int,
    delay: str = "1 hour",
    files_per_batch: int | None = None,
    key: str = "machine_id",
    time: str = "time",
) -> DataFrame:
    """Feed a finite trace through the stream and return all of its windows.

    A second run with one closing row moves the watermark past the last
    window, so that nothing stays behind in the state.  Raises if the
    watermark left rows out, which several batches do to a trace whose files
    are not in time order.
    """
    spark = trace.sparkSession
    folder, out, state = (stage_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    trace.withColumn(CLOSING, F.lit(False)).write.parquet(folder)
    stored = spark.read.parquet(folder)
    end = stage(closing_rows(stored, time, minutes, delay), "stream-end")
    rows = stored.filter(F.col(time).isNotNull()).count()
    like = stored.limit(0)
    read = read_trace_stream(spark, folder, like, files_per_batch)
    stream = stream_window_aggregate(read, minutes, delay, key, time, [CLOSING], [F.count(F.lit(1)).alias(ROWS)])
    run_available(stream, out, state)
    end.write.mode("append").parquet(folder)
    run_available(stream, out, state)
    found = spark.read.schema(stream.schema).parquet(out).filter(~F.col(CLOSING))
    counted = found.agg(F.sum(ROWS)).first()[0] or 0
    if counted != rows:
        raise ValueError(f"{rows - counted} of {rows} rows came later than {delay} and were left out")
    return found.drop(CLOSING, ROWS)

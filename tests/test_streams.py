from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_capacity import by_machine, random_series
from test_windows import series

from headroom.operators.capacity import first_value, threshold_fold
from headroom.operators.windows import window_aggregate
from headroom.streaming.threshold import stream_threshold, threshold_by_stream
from headroom.streaming.windows import read_trace_stream, run_available, window_aggregate_by_stream

START = datetime(2024, 1, 1)


def trace(spark):
    rng = np.random.default_rng(2)
    rows = [
        (f"m{rng.integers(4)}", START + timedelta(seconds=int(s)), float(v))
        for s, v in zip(rng.integers(0, 86400, 300), rng.random(300).round(3))
    ]
    return spark.createDataFrame(rows, "machine_id string, time timestamp_ntz, average_usage double")


def keyed(df):
    return {(r["machine_id"], r["time"]): tuple(None if v is None else round(v, 9) for v in r[2:]) for r in df.collect()}


def test_windows_of_a_stream_equal_the_batch(spark):
    df = trace(spark)
    assert keyed(window_aggregate_by_stream(df, 30)) == keyed(window_aggregate(df, 30))


def test_windows_over_several_batches(spark):
    # six files in time order, one per micro-batch
    df = trace(spark).repartitionByRange(6, "time")
    got = window_aggregate_by_stream(df, 30, delay="1 day", files_per_batch=1)
    assert keyed(got) == keyed(window_aggregate(df, 30))


def test_rows_left_out_are_an_error(spark):
    # files in no order of time: the watermark of the first ones closes windows of later ones
    df = trace(spark).repartition(8, "average_usage")
    with pytest.raises(ValueError, match="left out"):
        window_aggregate_by_stream(df, 30, delay="1 minute", files_per_batch=1)


def test_a_machine_of_any_name(spark):
    df = trace(spark).withColumn("machine_id", F.lit("~end~"))
    assert keyed(window_aggregate_by_stream(df, 45 * 1440)) == keyed(window_aggregate(df, 45 * 1440))


def test_threshold_state_equals_the_fold(spark):
    df = series(spark, random_series(6, longest=30))
    start = df.withColumn("start", first_value("y") * 1.5)
    wanted = by_machine(threshold_fold(start, "start", "capacity"))
    assert by_machine(threshold_by_stream(df)) == wanted


def test_threshold_state_goes_on_after_a_restart(spark, tmp_path):
    df = series(spark, random_series(7, longest=30)).cache()
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.filter("step < 10").write.parquet(folder)
    stream = stream_threshold(read_trace_stream(spark, folder, df))
    run_available(stream, out, state)
    df.filter("step >= 10").write.mode("append").parquet(folder)
    run_available(stream, out, state)
    start = df.withColumn("start", first_value("y") * 1.5)
    assert by_machine(spark.read.parquet(out)) == by_machine(threshold_fold(start, "start", "capacity"))

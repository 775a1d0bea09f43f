from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom.functions.features import finite, over_provisioning_columns, temporal_features, workload_features
from headroom.operators import windows as win
from headroom.operators.scale import available_features, scaled_features

START = datetime(2024, 1, 1)


def series(spark, values):
    rows = [(m, i, float(v)) for m, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "machine_id string, step long, y double")


def test_window_statistics(spark):
    rows = [("a", START, 0.2, 0.3), ("a", START + timedelta(minutes=4), 0.4, 0.9), ("a", START + timedelta(minutes=5), 0.6, 0.7)]
    df = spark.createDataFrame(rows, "machine_id string, time timestamp_ntz, average_usage double, maximum_usage double")
    one, two = win.window_aggregate(df, 5).orderBy("time").collect()
    assert one["average_usage_mean"] == pytest.approx(0.3) and one["average_usage_std"] == pytest.approx(np.std([0.2, 0.4], ddof=1))
    assert (one["average_usage_min"], one["average_usage_max"], one["maximum_usage_max"]) == (0.2, 0.4, 0.9)
    assert two["average_usage_std"] is None and two["time"] == START + timedelta(minutes=5)
    assert "resource_request_mean" not in one.asDict()


def test_profiles(spark):
    df = spark.createDataFrame(
        [("a", 0.2, 0.5), ("a", 0.4, 0.7), ("b", 0.5, 0.5)],
        "machine_id string, average_usage_mean double, resource_request_mean double",
    )
    rows = {r["machine_id"]: r for r in win.machine_profiles(df).collect()}
    assert rows["a"]["n_observations"] == 2 and rows["b"]["cpu_std"] is None
    assert rows["a"]["over_provision_ratio"] == pytest.approx(0.6 / (0.3 + 1e-10))
    assert rows["a"]["cpu_cv"] == pytest.approx(np.std([0.2, 0.4], ddof=1) / (0.3 + 1e-10))


def test_scaling_uses_the_population_deviation(spark):
    values = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(str(i), v, 5.0, None) for i, v in enumerate(values)], "machine_id string, cpu_mean double, peak_usage double, cpu_std double")
    rows = sorted(scaled_features(df).collect())
    wanted = (np.array(values) - np.mean(values)) / np.std(values)
    assert [r["cpu_mean"] for r in rows] == pytest.approx(list(wanted))
    assert {r["peak_usage"] for r in rows} == {0.0} and {r["cpu_std"] for r in rows} == {0.0}
    with pytest.raises(ValueError):
        available_features(["x"])


def test_replacing_what_is_not_finite(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (0.5,)], "v double")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [0.0, 0.0, 1.0, 0.0, 0.5]


def test_temporal_features(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 6, 6),), (datetime(2024, 1, 8, 17, 59),), (datetime(2024, 1, 8, 18),)], "time timestamp_ntz")
    rows = temporal_features(df).collect()
    assert [r["is_weekend"] for r in rows] == [1, 0, 0] and [r["is_business_hours"] for r in rows] == [0, 1, 0]
    assert rows[0]["hour_sin"] == pytest.approx(1.0) and rows[1]["dow_cos"] == pytest.approx(1.0)
    assert temporal_features(df, "other").columns == ["time"]


def test_window_level_ratios(spark):
    df = spark.createDataFrame(
        [(0.2, 0.1, 0.8, 0.5), (0.5, None, 0.5, 0.25)],
        "average_usage_mean double, average_usage_std double, maximum_usage_max double, resource_request_mean double",
    )
    rows = over_provisioning_columns(workload_features(df)).collect()
    assert rows[0]["burstiness"] == pytest.approx(3.0) and rows[1]["stability"] is None
    assert rows[0]["stability"] == pytest.approx(1 / 1.5) and rows[0]["wasted_resources"] == pytest.approx(0.3)
    assert rows[1]["wasted_resources"] == 0.0 and rows[1]["utilization_efficiency"] == 1.0


def test_lags(spark):
    got = win.lag_sequences(series(spark, {"a": range(5), "b": range(3)}), 3).collect()
    assert sorted((r["machine_id"], r["x"], r["target"]) for r in got) == [
        ("a", [0.0, 1.0, 2.0], 3.0),
        ("a", [1.0, 2.0, 3.0], 4.0),
    ]


@pytest.mark.parametrize("n", [1, 3, 6, 9, 10])
def test_split(spark, n):
    rows = win.train_test_split(series(spark, {"a": range(n)}), 0.8, 2).orderBy("step").collect()
    train = int(n * 0.8)
    assert [r["y"] for r in rows if r["part"] == "train"] == list(range(train))
    assert [(r["h"], r["y"]) for r in rows if r["part"] == "test"] == [(i + 1, v) for i, v in enumerate(range(train, min(n, train + 2)))]
    whole = win.train_test_split(series(spark, {"a": range(n)}), 0.8, None)
    assert whole.count() == n


def test_long_series_and_last_values(spark):
    df = series(spark, {"a": range(5), "b": range(6)})
    assert {r["machine_id"] for r in win.keep_long_series(df, 6).collect()} == {"b"}
    assert {r["machine_id"]: r["last_value"] for r in win.last_values(df).collect()} == {"a": 4.0, "b": 5.0}


@pytest.mark.parametrize("width, limit", [("1 minute", 5), ("1 minute", 10**6), ("1 day", 20), ("1 day", 10**6)])
def test_gaps_across_chunks(spark, width, limit):
    rng = np.random.default_rng(1)
    rows = [(f"m{rng.integers(3)}", START + timedelta(seconds=int(rng.integers(0, 600)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "machine_id string, time timestamp_ntz")
    got = {r["machine_id"]: r for r in win.describe_gaps(win.time_gaps(df, width=width, limit=limit)).collect()}
    pdf = pd.DataFrame(rows, columns=["m", "t"]).sort_values(["m", "t"])
    for m, part in pdf.groupby("m"):
        gaps = part["t"].diff().dropna().dt.total_seconds()
        row = got[m]
        assert row["n_gaps"] == len(gaps) and row["mean_gap"] == pytest.approx(gaps.mean())
        assert row["std_gap"] == pytest.approx(gaps.std()) and row["max_gap"] == gaps.max()
        assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(list(gaps.quantile([0.25, 0.5, 0.75])))


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",)], "machine_id string")
    top = win.top_machines(win.rows_per_machine(df), 2).collect()
    assert [tuple(r) for r in top] == [("b", 2), ("c", 2)]
    assert win.busiest_machine(df).first()["machine_id"] == "b"

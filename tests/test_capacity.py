import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from test_windows import series

from headroom.operators import capacity as cap
from headroom.params import Autoscaler, Policy

EPS = 1e-10


def plain_threshold(y, start, up=0.8, down=0.3, cooldown=3, guard=1.2):
    capacity, wait, out = start, 0, []
    for u in y:
        ratio = u / (capacity + EPS)
        if wait:
            wait -= 1
        elif ratio > up:
            capacity, wait = min(capacity * 1.25, 1.0), cooldown
        elif ratio < down:
            capacity, wait = max(capacity / 1.25, u * guard, 0.1), cooldown
        out.append(capacity)
    return out


def random_series(seed, machines=4, longest=40):
    rng = np.random.default_rng(seed)
    return {f"m{i}": list(rng.random(rng.integers(1, longest)).round(3)) for i in range(machines)}


def by_machine(df, column="capacity", order="step"):
    out = {}
    for r in df.orderBy("machine_id", order).collect():
        out.setdefault(r["machine_id"], []).append(r[column])
    return out


def test_threshold_fold_across_batches(spark, small_batches):
    values = random_series(1)
    got = by_machine(cap.threshold_capacity(series(spark, values)))
    assert got == {m: plain_threshold(y, float(np.median(y)) * 1.5) for m, y in values.items()}


def test_simple_threshold(spark):
    values = random_series(2)
    got = by_machine(cap.threshold_simple(series(spark, values)))
    wanted = {m: plain_threshold(y, y[0] * 1.5, cooldown=0, guard=0.0) for m, y in values.items()}
    assert {m: pytest.approx(c) for m, c in got.items()} == wanted


def test_cooldown_of_three():
    state, seen = (0.4, 0), []
    for _ in range(6):
        state = cap.autoscaler_step(*state, 0.39)
        seen.append(state)
    assert seen == [(0.5, 3), (0.5, 2), (0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)]


@pytest.mark.parametrize(
    "capacity, predicted, action, after",
    [
        (0.5, 0.4, "scale_up", 0.625),
        (0.9, 0.8, "scale_up", 1.0),
        (0.5, 0.1, "scale_down", 0.4),
        (0.11, 0.01, "scale_down", 0.1),
        (2.0, 0.75, "scale_down", 1.6),
        (0.5, 0.3, "keep", 0.5),
        (0.8, 0.75 * 0.8, "keep", 0.8),
        (0.0, 0.5, "scale_up", 0.0),
    ],
)
def test_policy_step_and_columns_agree(spark, capacity, predicted, action, after):
    step = cap.policy_step(capacity, predicted)
    assert step[:2] == (pytest.approx(after), action)
    df = spark.createDataFrame([(capacity, predicted)], "c double, p double")
    row = df.withColumns(cap.decide(F.col("c"), F.col("p"))).first()
    assert (row["recommended_capacity"], row["action"]) == step[:2]
    assert row["confidence"] == pytest.approx(step[2])


def test_confidence():
    assert cap.policy_step(1.0, 0.5)[2] == pytest.approx(1.0)
    assert cap.policy_step(1.0, 0.9)[2] == pytest.approx(0.8)
    assert cap.policy_step(0.1, 0.9)[2] == 1.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_bounds_after_a_change(usage):
    capacity, wait = usage[0] * 1.5, 0
    for u in usage:
        before = capacity
        capacity, wait = cap.autoscaler_step(capacity, wait, u, Autoscaler(cooldown=0, guard=0.0))
        if capacity > before:
            assert capacity <= 1.0 or before < 0.1
        if capacity < before:
            assert capacity >= 0.1


def plain_policy(predicted, start, p=Policy()):
    out = []
    for v in predicted:
        start = cap.policy_step(start, v, p)[0]
        out.append(start)
    return out


def test_policy_and_replay(spark, small_batches):
    values = random_series(3)
    df = series(spark, values).withColumnRenamed("y", "predicted")
    got = by_machine(cap.policy_capacity(df))
    assert got == {m: plain_policy(y, y[0] * 1.3) for m, y in values.items()}
    forecast = spark.createDataFrame(
        [(m, i + 1, float(v)) for m, y in values.items() for i, v in enumerate(y)], "machine_id string, h int, y_pred double"
    )
    last = spark.createDataFrame([(m, 0.4) for m in values], "machine_id string, last_value double")
    got = by_machine(cap.policy_replay(forecast, last), order="h")
    assert got == {m: plain_policy(y, 0.4 * 1.3) for m, y in values.items()}


def test_replay_of_a_forecast_that_holds_the_last_values(spark, capsys):
    rows = [("a", 1, 0.5, 0.4), ("a", 2, 0.9, 0.4), ("b", 1, 0.1, 0.8), ("c", 1, 0.1, None)]
    forecast = spark.createDataFrame(rows, "machine_id string, h int, y_pred double, last_value double")
    replayed = cap.policy_replay(forecast)
    got = by_machine(replayed, order="h")
    assert got["a"] == plain_policy([0.5, 0.9], 0.4 * 1.3) and got["b"] == plain_policy([0.1], 0.8 * 1.3)
    last = forecast.select("machine_id", "last_value").distinct()
    joined = cap.policy_replay(forecast.drop("last_value"), last)
    assert repr(sorted(map(tuple, joined.collect()))) == repr(sorted(map(tuple, replayed.select(joined.columns).collect())))
    replayed.explain()
    assert "Join" not in capsys.readouterr().out


def test_backtest(spark):
    y = [0.5, 0.9, 0.2, 0.3]
    df = series(spark, {"a": y}).withColumn("predicted", F.col("y") * 0.9).withColumn("start", F.lit(0.6))
    row = cap.policy_backtest(df, "start").first()
    capacity = plain_policy([v * 0.9 for v in y], 0.6)
    late = sum(v > 0.9 * c for v, c in zip(y, capacity))
    assert row["total_cost"] == pytest.approx(sum(capacity)) and row["sla_violations"] == late
    assert row["sla_violation_rate"] == pytest.approx(late / 4 * 100)
    assert row["avg_utilization"] == pytest.approx(np.mean(y) / np.mean(capacity))


@pytest.mark.parametrize("n", [1, 11, 12, 13, 30])
def test_moving_average(spark, n):
    y = np.random.default_rng(n).random(n)
    got = by_machine(cap.moving_average_capacity(series(spark, {"a": y})))["a"]
    wanted = [max(0.1, 1.2 * (y[: i + 1].mean() if i < 12 else y[i - 12 : i].mean())) for i in range(n)]
    assert got == pytest.approx(wanted)


def test_baselines_in_one_pass(spark, small_batches):
    values = random_series(4)
    df = series(spark, values)
    long = cap.baseline_capacities(df)
    got = by_machine(long.filter("strategy = 'threshold'"))
    assert got == by_machine(cap.threshold_capacity(df))
    assert by_machine(long.filter("strategy = 'moving_average'")) == by_machine(cap.moving_average_capacity(df))
    assert by_machine(long.filter("strategy = 'static'")) == by_machine(cap.static_capacity(df))


def test_strategies_in_one_pass(spark, small_batches):
    values = random_series(5)
    df = series(spark, values).withColumn("predicted", cap.moving_average())
    long = cap.strategy_capacities(df)
    assert by_machine(long.filter("strategy = 'proposed'")) == by_machine(cap.policy_capacity(df))
    assert by_machine(long.filter("strategy = 'threshold'")) == by_machine(cap.threshold_simple(df))
    assert by_machine(long.filter("strategy = 'oracle'")) == by_machine(cap.oracle_capacity(df))
    assert long.count() == 4 * sum(map(len, values.values()))


def test_decisions_need_both_sides(spark):
    have = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "machine_id string, current_capacity double")
    use = spark.createDataFrame([("a", 0.49), ("c", 0.1)], "machine_id string, predicted_usage double")
    got = cap.scaling_decisions(have, use)
    assert [(r["machine_id"], r["action"]) for r in got.collect()] == [("a", "scale_up")]
    assert [tuple(r) for r in cap.action_distribution(got).collect()] == [("scale_up", 1)]

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from headroom.functions import metrics as M
from headroom.functions.rounding import rounded
from headroom.operators import compare
from headroom.params import Pricing


def pairs(spark, a, b, names="a double, b double"):
    return spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], names)


def one(df, column):
    return df.agg(column).first()[0]


def test_prediction_errors(spark):
    a, p = np.array([0.0, 1.0, 2.0]), np.array([1.0, 1.5, 1.0])
    df = pairs(spark, a, p)
    assert one(df, M.rmse("a", "b")) == pytest.approx(np.sqrt(np.mean((a - p) ** 2)))
    assert one(df, M.mae("a", "b")) == pytest.approx(np.mean(abs(a - p)))
    assert one(df, M.mape("a", "b")) == pytest.approx(50.0)
    assert one(df, M.mape_epsilon("a", "b")) == pytest.approx(np.mean(abs((a - p) / (a + 1e-10))) * 100)
    assert one(df, M.smape("a", "b")) == pytest.approx(np.mean(2 * abs(a - p) / (a + p)) * 100)


def test_errors_without_usable_rows(spark):
    df = pairs(spark, [0.0, 0.0], [0.0, 0.0])
    assert one(df, M.mape("a", "b")) == float("inf") and one(df, M.smape("a", "b")) == 0.0


def test_costs(spark):
    use, cap = np.array([0.2, 0.5, 0.9]), np.array([0.4, 0.5, 0.6])
    df = pairs(spark, use, cap, "u double, c double")
    unit = 0.05 / 12
    assert one(df, M.total_cost("c")) == pytest.approx(cap.sum() * unit)
    assert one(df, M.total_cost("c", memory="u")) == pytest.approx(cap.sum() * unit + use.sum() * 0.01 / 12)
    assert one(df, M.total_cost("c", Pricing(cpu_hour=1.0, interval_minutes=60))) == pytest.approx(cap.sum())
    assert one(df, M.wasted_cost("u", "c")) == pytest.approx(0.2 * unit)
    assert one(df, M.cost_efficiency("u", "c")) == pytest.approx(use.sum() / cap.sum())
    assert one(df, M.average_utilisation("u", "c")) == pytest.approx(np.mean(use / (cap + 1e-10)))
    assert one(df, M.utilisation_variance("u", "c")) == pytest.approx(np.var(use / (cap + 1e-10)))
    assert one(df, M.over_provisioning("u", "c")) == pytest.approx(np.mean(cap / (use + 1e-10)))
    assert one(df, M.sla_violations("u", "c")) == 2
    assert one(df, M.sla_violation_rate("u", "c")) == pytest.approx(200 / 3)
    assert one(df, M.sla_violation_rate("u", "c") + M.sla_compliance("u", "c")) == pytest.approx(100.0)


def test_usage_at_the_limit_is_no_violation(spark):
    df = pairs(spark, [0.95 * 0.8], [0.8])
    assert one(df, M.sla_violations("a", "b")) == 0


def test_reduction(spark):
    df = pairs(spark, [2.0, 0.0], [1.0, 1.0])
    assert [r[0] for r in df.select(M.cost_reduction("a", "b")).collect()] == [50.0, 0.0]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=20))
def test_waste_is_at_most_the_cost(spark, rows):
    df = spark.createDataFrame(rows, "u double, c double")
    row = df.agg(M.wasted_cost("u", "c").alias("w"), M.total_cost("c").alias("t")).first()
    assert row["w"] <= row["t"] + 1e-12


def capacities(spark):
    rows = []
    for m, use in {"a": [0.2, 0.4], "b": [0.5, 0.1]}.items():
        for s, u in enumerate(use):
            for name, c in (("static", max(use) * 1.2), ("threshold", u * 1.1 + 0.05)):
                rows.append((m, s, name, c, u))
    return spark.createDataFrame(rows, "machine_id string, step long, strategy string, capacity double, usage double")


def test_strategy_comparison(spark):
    rows = {r["strategy"]: r for r in compare.compare_strategies(capacities(spark)).collect()}
    assert rows["static"]["cost_reduction_pct"] == 0.0
    static, threshold = 2 * (0.48 + 0.6), (1.2 * 1.1 + 0.2)
    assert rows["threshold"]["cost_reduction_pct"] == pytest.approx((static - threshold) / static * 100)
    by = compare.compare_strategies(capacities(spark), ["machine_id"])
    one = {(r["machine_id"], r["strategy"]): r["cost_reduction_pct"] for r in by.collect()}
    assert one["a", "threshold"] == pytest.approx((0.96 - 0.76) / 0.96 * 100)


def test_baseline_comparison(spark):
    base = capacities(spark)
    proposed = base.filter("strategy = 'threshold'").drop("strategy")
    rows = {r["method"]: r for r in compare.compare_baselines(base, proposed).collect()}
    assert sorted(rows) == ["proposed", "static", "threshold"]
    assert rows["proposed"]["total_cost"] == pytest.approx(rows["threshold"]["total_cost"])
    assert rows["static"]["utilization"] == pytest.approx((0.3 / 0.48 + 0.3 / 0.6) / 2 * 100)


def test_free_baseline(spark):
    df = spark.createDataFrame([("a", 0, "static", 0.0, 0.0)], "machine_id string, step long, strategy string, capacity double, usage double")
    assert compare.compare_strategies(df).first()["cost_reduction_pct"] == 0.0


def test_report_text(spark):
    text = compare.cost_report(compare.compare_strategies(capacities(spark))).filter("strategy = 'static'").first()["report"]
    assert text.splitlines()[0] == "Strategy: STATIC" and "SLA Violations:    0" in text and "Cost Reduction:    0.0%" in text


def test_methods_under_each_other(spark):
    a = spark.createDataFrame([(1.0, 2.0)], "rmse double, total_cost double")
    b = spark.createDataFrame([(3.0,)], "rmse double")
    rows = {r["method"]: r for r in compare.results_table({"x": a, "y": b}).collect()}
    assert rows["x"]["total_cost"] == 2.0 and rows["y"]["total_cost"] is None


def test_sizing_extras(spark):
    df = spark.createDataFrame([(0.5, 0.1, 1.0), (0.5, 0.1, 0.7), (0.5, 0.1, 0.8)], "p double, s double, c double")
    got = df.select(*[c.alias(n) for n, c in compare.buffered_capacity(F.col("p"), F.col("s"), 2.0, 0.25, F.col("c"), 0.1).items()]).collect()
    assert [(r["allocated"], r["action"], r["capacity"]) for r in got] == [
        (0.75, "scale_down", 0.75),
        (0.75, "scale_up", 0.75),
        (0.75, "keep", 0.8),
    ]
    assert df.select(compare.margin_capacity(F.col("p"), F.col("s"))).first()[0] == pytest.approx(0.55)
    assert one(df, compare.penalised_cost("c", "p", 1.0, 0.5)) == pytest.approx(2.5 + 0.5 * 1.0)


def test_autocorrelation(spark):
    y = np.random.default_rng(1).random(30)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "machine_id string, step long, y double")
    assert compare.autocorrelation(df).first()["autocorrelation"] == pytest.approx(np.corrcoef(y[1:], y[:-1])[0, 1])


def test_rounding(spark):
    df = spark.createDataFrame([(0.5, [0.1234567], float("inf"), None, 1)], "a double, b array<double>, c double, d double, e int")
    assert tuple(rounded(df, 3).first()) == (0.5, [0.123], float("inf"), None, 1)

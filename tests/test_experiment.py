import pytest
from pyspark.sql import functions as F
from test_forecast import walk
from test_windows import series

from headroom.operators.capacity import moving_average, policy_capacity
from headroom.params import Clustering
from headroom.plans import experiment as exp
from headroom.sources.adapters import usage_trace

FAST = exp.Settings(clustering=Clustering(restarts=2))


def test_full_experiment(spark, data_folder):
    tables = exp.full_experiment(usage_trace(spark, data_folder), ["event_id"], FAST)
    counts = tables["counts"].first()
    # the whole test part of every machine
    n = tables["windowed"].groupBy("machine_id").count().filter("count >= 6")
    assert counts["n_observations"] == sum(r["count"] - int(r["count"] * 0.8) for r in n.collect())
    assert counts["n_machines"] == n.count() > 0
    rows = {r["strategy"]: r for r in tables["comparison"].collect()}
    assert sorted(rows) == ["moving_average", "proposed", "static", "threshold"]
    assert rows["static"]["cost_reduction_pct"] == 0.0 and rows["static"]["sla_violations"] == 0
    assert tables["cluster_stats"].agg(F.sum("size")).first()[0] == tables["profiles"].count()
    assert {r[0] for r in tables["models"].select("strategy").distinct().collect()} <= {
        "arima",
        "seasonal_arima",
        "lstm",
        "conservative",
    }
    summary = exp.experiment_summary(tables)
    assert {r["method"] for r in summary.collect()} >= {"Static", "Threshold", "Proposed"}


def test_busiest_machines_only_and_raw_types(spark, data_folder):
    settings = exp.Settings(clustering=Clustering(k=2, restarts=1), machines=5, types_on="raw")
    tables = exp.full_experiment(usage_trace(spark, data_folder), ["event_id"], settings)
    assert tables["counts"].first()["n_machines"] <= 5


def test_clusters_sweep(spark, data_folder):
    rows = exp.cluster_sweep(usage_trace(spark, data_folder), [2, 3], ["event_id"], FAST).collect()
    assert sorted(r["n_clusters"] for r in rows) == [2, 3]


def test_threshold_sweep_equals_single_runs(spark):
    from headroom.params import Policy

    df = series(spark, {"a": walk(40, 1), "b": walk(25, 2)}).withColumn("predicted", moving_average())
    swept = {(r["up"], r["down"]): r for r in exp.threshold_sweep(df, [(0.75, 0.4), (0.6, 0.2)]).collect()}
    for up, down in swept:
        alone = policy_capacity(df, settings=Policy(up=up, down=down)).agg(F.sum("capacity")).first()[0]
        assert swept[up, down]["total_cost"] == pytest.approx(alone * 0.05 / 12)


def test_comparison_from_a_trace(spark, data_folder):
    tables = exp.model_comparison(usage_trace(spark, data_folder), ["event_id"], 8, 40, FAST)
    n = tables["errors"].count()
    assert 0 < n <= 8 and tables["values"].select("machine_id").distinct().count() == n
    assert tables["averages"].first()["arima_rmse"] > 0


def test_model_comparison(spark):
    values = {"a": walk(60, 3), "b": walk(55, 4), "short": walk(40, 5)}
    kinds = spark.createDataFrame(
        [("a", "stable_low_load", "arima"), ("b", "volatile", "conservative")],
        "machine_id string, workload_type string, strategy string",
    )
    table, errors = exp.compare_models(series(spark, values), kinds)
    rows = {r["machine_id"]: r for r in errors.collect()}
    assert sorted(rows) == ["a", "b"] and table.filter("machine_id = 'a'").count() == 12
    assert rows["a"]["hybrid_rmse"] == pytest.approx(rows["a"]["arima_rmse"])
    assert rows["b"]["hybrid_strategy"] == "conservative"

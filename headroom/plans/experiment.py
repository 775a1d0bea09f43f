"""The whole analysis, from raw trace to cost comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from headroom.functions import metrics as M
from headroom.functions.features import over_provisioning_columns, temporal_features
from headroom.functions.workload import model_strategy, workload_type
from headroom.operators import capacity as cap
from headroom.operators import forecast as fc
from headroom.operators.clean import clean_trace
from headroom.operators.cluster import (
    PARALLEL_FITS,
    assign_strategies,
    cluster_report,
    cluster_stats,
    feature_vectors,
    kmeans,
)
from headroom.operators.compare import baseline_results, reduction_against
from headroom.operators.lloyd import best_fits, labels_of
from headroom.operators.scale import available_features, scaled_features
from headroom.operators.windows import (
    WINDOW_STATISTICS,
    keep_long_series,
    last_values,
    machine_profiles,
    top_machines,
    train_test_split,
    usage_series,
    window_aggregate,
)
from headroom.params import TIME_COLUMNS, Autoscaler, Clustering, Policy
from headroom.session import stage
from headroom.sources.sinks import average_metrics
from headroom.sources.trace import sample_machines


@dataclass(frozen=True)
class Settings:
    window_minutes: int = 5
    clustering: Clustering = field(default_factory=Clustering)
    policy: Policy = field(default_factory=Policy)
    autoscaler: Autoscaler = field(default_factory=Autoscaler)
    train_share: float = 0.8
    steps: int | None = None  # only so many steps of the test part; None takes all
    min_windows: int = 6
    machines: int | None = None  # only the busiest machines; None takes all
    types_on: str = "scaled"  # or "raw": which feature means decide the workload type
    pooled: bool = True


def machine_types(
    profiles: DataFrame, settings: Settings = Settings(), key: str = "machine_id"
) -> tuple[DataFrame, DataFrame]:
    """Cluster the machines: (machine, cluster, workload_type, strategies) and cluster statistics."""
    names = available_features(profiles.columns)
    labels, _ = kmeans(feature_vectors(scaled_features(profiles, key), names, key), settings.clustering)
    labels = stage(labels.withColumnRenamed("id", key), "clusters")
    if settings.types_on == "raw":
        described = profiles.join(labels.select(key, "cluster"), key)
    else:
        described = labels.select("cluster", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    stats = cluster_stats(described, names)
    return assign_strategies(labels, stats, key), stats


Types = Callable[[DataFrame, Settings], tuple[DataFrame, DataFrame]]


def observed_windows(trace: DataFrame, ties: Sequence[str] | None, minutes: int) -> DataFrame:
    """Cleaned and windowed trace, staged for the steps that share it.

    Columns the windows do not use are dropped before the trace is shuffled,
    unless they decide the order of rows of one instant.
    """
    if ties is not None:
        used = {"machine_id", *TIME_COLUMNS, *ties, *WINDOW_STATISTICS}
        trace = trace.select(*[c for c in trace.columns if c in used])
    return stage(window_aggregate(clean_trace(trace, ties), minutes), "windows")


def _forecast(windowed: DataFrame, s: Settings, types: Types) -> dict[str, DataFrame]:
    profiles = machine_profiles(windowed)

    def typed() -> tuple[DataFrame, DataFrame]:
        strategies, stats = types(profiles, s)
        return stage(strategies, "strategies"), stats

    def parted() -> tuple[DataFrame, DataFrame, DataFrame]:
        series = usage_series(windowed)
        if s.machines is not None:
            chosen = top_machines(profiles, s.machines, "n_observations").select("machine_id")
            series = series.join(chosen, "machine_id", "left_semi")
        split = train_test_split(keep_long_series(series, s.min_windows), s.train_share, s.steps)
        split = stage(split, "split", ("part",))
        test = split.filter("part = 'test'").select("machine_id", "h", "y")
        baselines = stage(cap.baseline_capacities(test, s.autoscaler, order="h"), "baselines")
        return split.filter("part = 'train'").drop("part", "h"), test, baselines

    # the fits of the clusters are many short jobs, and neither side needs the other
    with ThreadPoolExecutor(1) as pool:
        found = pool.submit(typed)
        train, test, baselines = parted()
        strategies, stats = found.result()

    models = stage(fc.fit_hybrid(train, strategies, s.pooled), "models")
    forecasts = test.join(fc.predict_test(models, test), ["machine_id", "h"])
    forecasts = stage(forecasts.join(last_values(train), "machine_id"), "forecasts")
    return {
        "windowed": over_provisioning_columns(temporal_features(windowed)),
        "profiles": profiles,
        "strategies": strategies,
        "cluster_stats": stats,
        "cluster_report": cluster_report(stats),
        "models": models.join(strategies.select("machine_id", "workload_type"), "machine_id", "left"),
        "forecasts": forecasts,
        "test": test,
        "baselines": baselines,
    }


def _proposed(forecasts: DataFrame, policy: Policy) -> DataFrame:
    """Capacities of the policy over the forecasts, as a strategy."""
    walked = cap.policy_replay(forecasts, settings=policy)
    return walked.select(
        "machine_id", "h", F.lit("proposed").alias("strategy"), "capacity", F.col("y").alias("usage"), "y_pred"
    )


def full_experiment(
    trace: DataFrame, ties: Sequence[str] | None = None, settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """The experiment on a raw trace: clean, window, then ``experiment_on_windows``."""
    windowed = observed_windows(trace, ties, settings.window_minutes)
    return experiment_on_windows(windowed, settings)


def experiment_on_windows(
    windowed: DataFrame, settings: Settings = Settings(), types: Types = machine_types
) -> dict[str, DataFrame]:
    """Result tables: comparison, prediction_metrics, counts, cluster tables, models, forecasts, capacities.

    Models are fitted on the train part of each series and scored on the steps
    right after it; baselines run per machine on the same steps.  ``types``
    gives strategies and cluster statistics for the profiles.
    """
    tables = _forecast(windowed, settings, types)
    proposed = stage(_proposed(tables["forecasts"], settings.policy).drop("y_pred"), "proposed")
    capacities = tables.pop("baselines").unionByName(proposed)
    tables["capacities"] = capacities
    tables["comparison"] = reduction_against(baseline_results(capacities))
    tables["prediction_metrics"] = tables["forecasts"].agg(*M.prediction_metrics("y", "y_pred"))
    tables["counts"] = tables["forecasts"].agg(
        F.count_distinct("machine_id").alias("n_machines"), F.count(F.lit(1)).alias("n_observations")
    )
    return tables


def experiment_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per method, with the forecast errors beside them."""
    errors = tables["prediction_metrics"].agg(F.first(F.struct("rmse", "mae", "mape"))).scalar()
    return tables["comparison"].select(
        F.initcap("strategy").alias("method"),
        "total_cost",
        "cost_reduction_pct",
        (F.col("utilization") * 100).alias("utilization_pct"),
        "sla_violations",
        "sla_violation_rate",
        errors["rmse"].alias("rmse"),
        errors["mae"].alias("mae"),
        errors["mape"].alias("mape"),
    )


# --- sensitivity ----------------------------------------------------------------------


def threshold_sweep(
    series: DataFrame,
    thresholds: Sequence[tuple[float, float]],
    predicted: str = "predicted",
    settings: Policy = Policy(),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Cost and service of the policy for several (up, down) limits, in one job.

    Every row is replayed once per pair of limits; nothing else is repeated.
    """
    limits = F.array(*[F.struct(F.lit(u).alias("up"), F.lit(d).alias("down")) for u, d in thresholds])
    begun = (
        series.select(key, order, y, predicted)
        .withColumn("_start", cap.first_value(predicted, key, order) * settings.start)
        .withColumn("_static", cap.static_level(y, key))
        .withColumn("limit", F.explode(limits))
        .select("*", F.col("limit.up").alias("up"), F.col("limit.down").alias("down"))
        .drop("limit")
    )
    walked = cap.policy_fold(
        begun, "_start", predicted, settings, [key, "up", "down"], order, ("up", "down")
    )
    cost, static = M.total_cost("capacity"), M.total_cost("_static")
    return walked.groupBy("up", "down").agg(
        cost.alias("total_cost"),
        M.cost_reduction(static, cost).alias("cost_reduction"),
        M.average_utilisation(y, "capacity").alias("utilization"),
        M.sla_violation_rate(y, "capacity").alias("sla_violations"),
    )


def fitted_routes(profiles: DataFrame, ks: Sequence[int], settings: Settings = Settings()) -> DataFrame:
    """(n_clusters, machine_id, strategy) for each k, all of them fitted together."""
    names = available_features(profiles.columns)
    vectors = feature_vectors(scaled_features(profiles), names)
    found = best_fits(vectors, [replace(settings.clustering, k=k) for k in ks])
    numbers = F.array(*[F.lit(k) for k in found])
    labels = labels_of(vectors, found).select(F.col("id").alias("machine_id"), "x", F.posexplode("labels"))
    labels = labels.select(
        F.element_at(numbers, F.col("pos") + 1).alias("n_clusters"),
        "machine_id",
        F.col("col").alias("cluster"),
        *[F.col("x")[i].alias(c) for i, c in enumerate(names)],
    )
    if settings.types_on == "raw":
        labels = labels.drop(*names).join(profiles.select("machine_id", *names), "machine_id")
    return routes_of(labels)


def routes_of(labels: DataFrame) -> DataFrame:
    """(n_clusters, machine_id, strategy) out of (n_clusters, machine_id, cluster, cpu_mean, cpu_cv)."""
    kinds = labels.groupBy("n_clusters", "cluster").agg(F.avg("cpu_mean").alias("m"), F.avg("cpu_cv").alias("c"))
    kinds = kinds.select("n_clusters", "cluster", model_strategy(workload_type(F.col("m"), F.col("c"))).alias("strategy"))
    return labels.select("n_clusters", "machine_id", "cluster").join(kinds, ["n_clusters", "cluster"]).drop("cluster")


Routes = Callable[[DataFrame, Sequence[int], Settings], DataFrame]


def cluster_sweep(
    trace: DataFrame, ks: Sequence[int], ties: Sequence[str] | None = None, settings: Settings = Settings()
) -> DataFrame:
    """``sweep_on_windows`` on a raw trace, which is cleaned and windowed once."""
    return sweep_on_windows(observed_windows(trace, ties, settings.window_minutes), ks, settings)


def sweep_on_windows(
    windowed: DataFrame, ks: Sequence[int], settings: Settings = Settings(), routes: Routes = fitted_routes
) -> DataFrame:
    """Cost and service of the experiment for several numbers of clusters.

    (n_clusters, cost_reduction, utilization, sla_violations).  A model depends
    on the machine and its method, not on the number of clusters that led to the
    method: each pair is fitted, forecast and replayed once, however many
    settings share it.  Only the pooled regression is fitted per setting, as its
    machines differ.
    """
    s = settings
    profiles = machine_profiles(windowed)
    series = usage_series(windowed)
    if s.machines is not None:
        chosen = top_machines(profiles, s.machines, "n_observations").select("machine_id")
        series = series.join(chosen, "machine_id", "left_semi")
    split = train_test_split(keep_long_series(series, s.min_windows), s.train_share, s.steps)
    split = stage(split, "split", ("part",))
    train = split.filter("part = 'train'").drop("part", "h")
    test = split.filter("part = 'test'").select("machine_id", "h", "y")

    # a variant is a method, and the setting too where the setting decides the fit
    pooled = (F.col("strategy") == "lstm") & F.lit(s.pooled)
    variant = F.when(pooled, F.concat_ws("-", "strategy", "n_clusters")).otherwise(F.col("strategy"))
    routed = stage(routes(profiles, ks, s).withColumn("variant", variant), "routes")

    def fitted(name: str, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
        machines = routed.filter(F.col("variant") == name).select("machine_id").distinct()
        return fit(train.join(machines, "machine_id", "left_semi")).withColumn("variant", F.lit(name))

    bursty = [f"lstm-{k}" for k in ks] if s.pooled else ["lstm"]
    fits: dict[str, Callable[[DataFrame], DataFrame]] = {
        "arima": fc.fit_ar,
        "seasonal_arima": fc.fit_seasonal_ar,
        "conservative": fc.fit_conservative,
        **dict.fromkeys(bursty, fc.fit_pooled if s.pooled else fc.fit_weighted),
    }
    # the pooled fits are jobs of their own and run side by side
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        models = list(pool.map(lambda f: fitted(*f), fits.items()))
    models = stage(reduce(DataFrame.unionByName, models), "models")

    ahead = fc.predict_test(models, test, carry=["variant"]).select("machine_id", "variant", "h", "y_pred")
    begun = test.join(ahead, ["machine_id", "h"]).join(last_values(train), "machine_id")
    begun = begun.withColumn("_start", F.col("last_value") * s.policy.start)
    walked = cap.policy_fold(begun, "_start", "y_pred", s.policy, ["machine_id", "variant"], "h")
    walked = walked.groupBy("machine_id", "variant").agg(
        M.total_cost("capacity").alias("total_cost"),
        M.average_utilisation("y", "capacity").alias("utilization"),
        M.sla_violations("y", "capacity").alias("violations"),
        F.count(F.lit(1)).alias("n"),
    )
    level = test.select("machine_id", cap.static_level("y").alias("capacity"))
    static = level.agg(M.total_cost("capacity").alias("static")).scalar()
    n, cost = F.sum("n"), F.sum("total_cost")
    return (
        routed.join(walked, ["machine_id", "variant"])
        .groupBy("n_clusters")
        .agg(
            cost.alias("total_cost"),
            (F.sum(F.col("utilization") * F.col("n")) / n).alias("utilization"),
            (F.sum("violations") / n * 100).alias("sla_violations"),
        )
        .select(
            "n_clusters",
            M.cost_reduction(static, F.col("total_cost")).alias("cost_reduction"),
            "utilization",
            "sla_violations",
        )
    )


# --- comparison of forecast methods ---------------------------------------------------


def compare_models(
    series: DataFrame,
    strategies: DataFrame,
    share: float = 0.8,
    min_windows: int = 50,
    key: str = "machine_id",
) -> tuple[DataFrame, DataFrame]:
    """Forecast values and error table of three methods, per machine.

    Each method is fitted on the first part of a series and forecasts all of
    the rest.  Gives (machine, h, actual, arima, lstm, hybrid) and the errors.
    """
    split = train_test_split(keep_long_series(series, min_windows, key), share, None, key)
    split = stage(split, "comparison", ("part",))
    train = split.filter("part = 'train'").drop("part", "h")
    test = split.filter("part = 'test'").select(key, "h", F.col("y").alias("actual"))
    arima = stage(fc.fit_ar(train), "arima-models")
    hybrid = fc.fit_hybrid(train, strategies, arima=arima)
    fitted = {"arima": arima, "lstm": fc.fit_pooled(train), "hybrid": hybrid}
    models = reduce(DataFrame.unionByName, [m.withColumn("method", F.lit(name)) for name, m in fitted.items()])
    # all methods are scored in one pass and meet in one row per step
    ahead = fc.predict_test(models, test, key, ["method"]).groupBy(key, "h")
    ahead = ahead.agg(*[F.max(F.when(F.col("method") == name, F.col("y_pred"))).alias(name) for name in fitted])
    values = stage(test.join(ahead.dropna(subset=list(fitted)), [key, "h"]), "comparison-values")
    errors = values.groupBy(key).agg(
        *[
            metric("actual", name).alias(f"{name}_{label}")
            for name in fitted
            for label, metric in (("rmse", M.rmse), ("mape", M.mape_epsilon))
        ]
    )
    kinds = strategies.select(key, "workload_type", F.col("strategy").alias("hybrid_strategy"))
    return values, errors.join(kinds, key, "left")


def model_comparison(
    trace: DataFrame,
    ties: Sequence[str] | None = None,
    machines: int | None = None,
    min_windows: int = 50,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """The comparison from a raw trace: values, errors and average errors.

    ``machines`` draws a sample of machines first.
    """
    if machines is not None:
        trace = sample_machines(trace, machines)
    windowed = observed_windows(trace, ties, settings.window_minutes)
    strategies, _ = machine_types(machine_profiles(windowed), settings)
    series = usage_series(windowed)
    values, errors = compare_models(series, strategies, settings.train_share, min_windows)
    return {"values": values, "errors": errors, "averages": average_metrics(errors)}

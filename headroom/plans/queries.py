"""Named queries over the test tables.

Each takes (spark, folder) and returns a DataFrame over whole tables.  Doubles
are rounded at the very end, so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headroom.functions import metrics as M
from headroom.functions.features import over_provisioning_columns, temporal_features, workload_features
from headroom.functions.parse import parse_metric
from headroom.functions.rounding import rounded
from headroom.operators import capacity as cap
from headroom.operators import arma, clean, cluster, compare, density
from headroom.operators import forecast as fc
from headroom.operators import recurrent
from headroom.operators import windows as win
from headroom.operators.blocks import kth_distances
from headroom.operators.halo import dbscan_halo
from headroom.operators.keyed import keyed_quantiles
from headroom.operators.lloyd import lloyd
from headroom.operators.scale import available_features, scaled_features
from headroom.plans import experiment as exp
from headroom.session import stage, stage_path
from headroom.sources import sinks
from headroom.sources.adapters import points, usage_trace, windowed_usage
from headroom.sources.sinks import average_metrics
from headroom.sources.trace import (
    preview,
    read_report,
    read_trace_csv,
    read_trace_groups,
    read_trace_parquet,
    sample_machines,
    trace_summary,
    validate_schema,
)
from headroom.streaming.threshold import threshold_by_stream
from headroom.streaming.windows import window_aggregate_by_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TIES = ["event_id"]
DIGITS = 8
HORIZON = 6
DENSITY = {"eps": 0.9, "min_samples": 5}
SMALL_NETWORK = recurrent.Network(units=4, lags=2)
SEASONAL_START = [0.3, 0.1, -0.1, 0.05, 0.02, 0.2, 0.4]  # phi, seasonal phi, seasonal theta
FOLDS = [2, 3]
CLUSTER_NUMBERS = [2, 3, 4]
SWEEP = [(0.65, 0.40), (0.75, 0.40), (0.85, 0.40), (0.75, 0.30)]


def query(name: str, digits: int = DIGITS) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # timestamps are zone-free; conversions to epoch time read them as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(build(spark, sf_dir), digits)

        QUERIES[name] = run
        return build

    return register


# --- shared inputs --------------------------------------------------------------------


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.usage_series(windowed_usage(spark, sf_dir), "y")


def shared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series as a table, for queries that read it more than once."""
    return stage(series(spark, sf_dir), "series")


def predicted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("predicted", cap.moving_average())


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.window_aggregate(usage_trace(spark, sf_dir), 1440)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.machine_profiles(daily(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    table = profiles(spark, sf_dir)
    return scaled_features(table), available_features(table.columns)


def quadrants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Scaled features with the simple label."""
    table, names = features(spark, sf_dir)
    return table.withColumn("cluster", quadrant()), names


def density_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    table, names = features(spark, sf_dir)
    return table, density.feature_points(table, names), names


def split_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = stage(win.train_test_split(series(spark, sf_dir), 0.8), "split")
    return split.filter("part = 'train'").drop("part", "h"), split.filter("part = 'test'")


def quadrant() -> Column:
    """A simple label out of scaled features: above or below average load and variability."""
    return (F.col("cpu_mean") > 0).cast("int") + 2 * (F.col("cpu_cv") > 0).cast("int")


def simple_types(described: DataFrame, _settings: exp.Settings) -> tuple[DataFrame, DataFrame]:
    """Strategies and cluster statistics with the simple label in place of a fitted one."""
    marked = scaled_features(described).withColumn("cluster", quadrant())
    stats = cluster.cluster_stats(marked, available_features(described.columns))
    return cluster.assign_strategies(marked, stats), stats


def simple_routes(described: DataFrame, ks: list[int], _settings: exp.Settings) -> DataFrame:
    """Strategies for several numbers of clusters, with the simple label folded to so many."""
    marked = scaled_features(described).withColumn("n_clusters", F.explode(F.array(*[F.lit(k) for k in ks])))
    return exp.routes_of(marked.withColumn("cluster", quadrant() % F.col("n_clusters")))


def folded_labels(spark: SparkSession, sf_dir: str, ks: list[int]) -> DataFrame:
    """Points with their label folded to 2, 3, ... clusters."""
    labels = F.array(*[F.col("cluster") % k for k in ks])
    return stage(points(spark, sf_dir).select("id", "x", labels.alias("labels")), "folded")


def simple_strategies(table: DataFrame) -> DataFrame:
    """Strategies of the machines of a series, routed by the simple label."""
    described = win.machine_profiles(table.select("machine_id", F.col("y").alias("average_usage_mean")))
    return simple_types(described, exp.Settings())[0]


def series_strategies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = shared_series(spark, sf_dir)
    described = win.machine_profiles(table.select("machine_id", F.col("y").alias("average_usage_mean")))
    return table, exp.machine_types(described)[0]


# --- sources, cleaning ----------------------------------------------------------------


@query("trace_summary")
def _(spark, sf_dir):
    return trace_summary(usage_trace(spark, sf_dir))


@query("density_report", 6)
def _(spark, sf_dir):
    return win.density_report(usage_trace(spark, sf_dir))


@query("top_machines")
def _(spark, sf_dir):
    return win.top_machines(win.rows_per_machine(usage_trace(spark, sf_dir)))


@query("time_gaps", 4)
def _(spark, sf_dir):
    return win.describe_gaps(win.time_gaps(usage_trace(spark, sf_dir)))


@query("parse_metric")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    v = F.col("value").cast("string")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("{'cpus': "), v, F.lit(", 'memory': "), k, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), v, F.lit(", "), k, F.lit("]")))
        .when(F.col("event_type") == "purchase", v)
        .when(F.col("event_type") == "signup", F.concat(F.lit("{'memory': "), k, F.lit("}")))
        .otherwise("n/a")
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", parse_metric(text).alias("metric"))


@query("sample_machines")
def _(spark, sf_dir):
    return sample_machines(usage_trace(spark, sf_dir), 20).select("machine_id", "event_id", "average_usage")


@query("fill_missing")
def _(spark, sf_dir):
    filled = clean.fill_missing(usage_trace(spark, sf_dir), ties=TIES)
    return filled.select("machine_id", "event_id", "time", "average_usage", "assigned_memory")


@query("remove_invalid")
def _(spark, sf_dir):
    kept = clean.remove_invalid(usage_trace(spark, sf_dir))
    return kept.select("machine_id", "event_id", "start_time", "end_time", "average_usage", "maximum_usage")


def _capped(df: DataFrame, method: str) -> DataFrame:
    return clean.cap_outliers(df, method).select(
        "machine_id", "event_id", "average_usage", "maximum_usage", "resource_request"
    )


@query("cap_outliers_iqr")
def _(spark, sf_dir):
    return _capped(usage_trace(spark, sf_dir), "iqr")


@query("cap_outliers_zscore")
def _(spark, sf_dir):
    return _capped(usage_trace(spark, sf_dir), "zscore")


@query("clean_trace")
def _(spark, sf_dir):
    return clean.clean_trace(usage_trace(spark, sf_dir), TIES)


@query("cleaning_report")
def _(spark, sf_dir):
    return clean.cleaning_report(usage_trace(spark, sf_dir), TIES)


@query("fill_missing_hours")
def _(spark, sf_dir):
    # many rows of a machine share an hour, and nothing says which comes first
    hourly = usage_trace(spark, sf_dir).withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return clean.fill_missing(hourly).select("machine_id", "event_id", "time", "average_usage", "assigned_memory")


@query("fill_missing_hot")
def _(spark, sf_dir):
    filled = clean.fill_missing(usage_trace(spark, sf_dir), ties=TIES, width="10 days", limit=50)
    return filled.select("machine_id", "event_id", "time", "average_usage", "assigned_memory")


@query("time_gaps_hot", 4)
def _(spark, sf_dir):
    return win.describe_gaps(win.time_gaps(usage_trace(spark, sf_dir), width="10 days", limit=50))


@query("cap_outliers_narrowed")
def _(spark, sf_dir):
    return clean.cap_outliers(usage_trace(spark, sf_dir), rank_rows=50).select(
        "machine_id", "event_id", "average_usage", "maximum_usage", "resource_request"
    )


@query("drop_critical_nulls")
def _(spark, sf_dir):
    holes = usage_trace(spark, sf_dir).withColumns(
        {
            "machine_id": F.when(F.col("event_id") % 101 != 0, F.col("machine_id")),
            "time": F.when(F.col("event_id") % 103 != 0, F.col("time")),
            "average_usage": F.when(F.col("event_id") % 107 != 0, F.col("average_usage")),
        }
    )
    return clean.drop_critical_nulls(holes).select("machine_id", "event_id", "time", "average_usage")


@query("normalise_times")
def _(spark, sf_dir):
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss")
    written = usage_trace(spark, sf_dir).withColumns(
        {"time": F.when(F.col("event_id") % 7 == 0, "no time").otherwise(text), "start_time": text, "end_time": F.lit("")}
    )
    return clean.normalise_times(written).select("event_id", "time", "start_time", "end_time")


@query("busiest_machine")
def _(spark, sf_dir):
    return win.busiest_machine(usage_trace(spark, sf_dir))


@query("preview")
def _(spark, sf_dir):
    return preview(usage_trace(spark, sf_dir).orderBy("event_id")).select("machine_id", "event_id", "time", "average_usage")


@query("busiest_machines_windows")
def _(spark, sf_dir):
    described = profiles(spark, sf_dir)
    return win.top_machines(described, 100, "n_observations").select("machine_id", "n_observations")


# --- readers and writers: written to the shared folder and read back --------------------


def _as_text(trace: DataFrame, unit: str) -> DataFrame:
    """The trace as the raw files have it: metrics as maps, lists or numbers, times as epoch values."""
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    stamp = micros if unit == "us" else F.floor(micros / 1_000_000)
    usage = F.col("average_usage").cast("string")
    return trace.select(
        "machine_id",
        F.col("event_id").cast("string").alias("instance_index"),
        F.when(F.col("event_id") % 13 != 0, stamp.cast("string")).alias("time"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{'cpus': "), usage, F.lit(", 'memory': 0.5}")))
        .otherwise(F.concat(F.lit("["), usage, F.lit("]")))
        .alias("average_usage"),
        F.col("maximum_usage").cast("string").alias("maximum_usage"),
        F.when(F.col("event_id") % 5 != 0, F.col("resource_request").cast("string")).otherwise("bad").alias("resource_request"),
        F.col("assigned_memory").cast("string").alias("assigned_memory"),
    )


def _written(table: DataFrame, folder: str) -> None:
    table.write.mode("append").option("header", True).option("escape", '"').csv(folder)


_RAW = ("machine_id", "instance_index", "time", "average_usage", "maximum_usage", "resource_request", "assigned_memory")
_MAPS = ("average_usage",)


@query("read_csv")
def _(spark, sf_dir):
    folder = stage_path(spark, "raw-trace")
    _written(_as_text(usage_trace(spark, sf_dir), "us"), folder)
    return validate_schema(read_trace_csv(spark, f"{folder}/*.csv", _MAPS)).select(*_RAW)


@query("read_csv_units")
def _(spark, sf_dir):
    # files in microseconds and files in seconds under one glob
    folder, trace = stage_path(spark, "raw-trace"), usage_trace(spark, sf_dir)
    _written(_as_text(trace.filter("event_id % 3 = 0"), "s"), folder)
    _written(_as_text(trace.filter("event_id % 3 <> 0"), "us"), folder)
    return read_trace_csv(spark, f"{folder}/*.csv", _MAPS).select(*_RAW)


@query("read_groups")
def _(spark, sf_dir):
    # the second group of files has another header
    folder, raw = stage_path(spark, "raw-trace"), _as_text(usage_trace(spark, sf_dir), "us")
    _written(raw.filter("instance_index % 3 = 0"), f"{folder}/a")
    _written(raw.filter("instance_index % 3 <> 0").drop("assigned_memory"), f"{folder}/b")
    return read_trace_groups(spark, [f"{folder}/a", f"{folder}/b"], text_metrics=_MAPS).select(*_RAW)


@query("read_report")
def _(spark, sf_dir):
    # files with the header asked for, and files with another one
    folder, raw = stage_path(spark, "raw-trace"), _as_text(usage_trace(spark, sf_dir), "us")
    _written(raw.filter("instance_index % 3 = 0"), f"{folder}/a")
    _written(raw.filter("instance_index % 3 <> 0").drop("assigned_memory"), f"{folder}/b")
    told = read_report(spark, [f"{folder}/a/*.csv", f"{folder}/b/*.csv"], raw.columns)
    group = F.regexp_extract("file", "/([ab])/[^/]*$", 1).alias("folder")
    return told.groupBy(group, "status").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_without_time", "n_bad")])


@query("read_parquet")
def _(spark, sf_dir):
    folder = stage_path(spark, "raw-trace")
    usage_trace(spark, sf_dir).withColumn("time", F.when(F.col("event_id") % 13 != 0, F.col("time"))).write.parquet(folder)
    return read_trace_parquet(spark, folder).select("machine_id", "event_id", "time", "average_usage")


@query("results_written", 6)
def _(spark, sf_dir):
    folder = stage_path(spark, "results")
    comparison = compare.compare_strategies(_strategies(spark, sf_dir))
    sinks.write_results({"comparison": comparison}, folder)
    return spark.read.schema(comparison.schema).json(f"{folder}/comparison")


@query("forecast_values_written")
def _(spark, sf_dir):
    folder = stage_path(spark, "forecast-values")
    train, test = split_series(spark, sf_dir)
    predicted = fc.predict_test(fc.fit_weighted(train), test).select("machine_id", "h", "y_pred")
    values = test.select("machine_id", "h", F.col("y").alias("actual")).join(predicted, ["machine_id", "h"])
    sinks.write_forecast_values(values, folder)
    return spark.read.option("header", True).schema("h int, actual double, y_pred double, machine_id string").csv(folder)


@query("forecast_ranges_written")
def _(spark, sf_dir):
    folder = stage_path(spark, "forecast-ranges")
    train, test = split_series(spark, sf_dir)
    predicted = fc.predict_test(fc.fit_weighted(train), test).select("machine_id", "h", "y_pred")
    values = test.select("machine_id", "h", F.col("y").alias("actual")).join(predicted, ["machine_id", "h"])
    sinks.write_forecast_ranges(values, folder)
    return spark.read.parquet(folder)


@query("metrics_written", 6)
def _(spark, sf_dir):
    folder = stage_path(spark, "metrics")
    sinks.write_metrics(_one_step(spark, sf_dir).groupBy("machine_id").agg(*M.prediction_metrics("y", "before")), folder)
    names = "rmse double, mae double, mape double"
    each = spark.read.option("header", True).schema(f"machine_id string, {names}").csv(f"{folder}/metrics")
    averages = spark.read.option("header", True).schema(names).csv(f"{folder}/averages")
    return each.unionByName(averages.withColumn("machine_id", F.lit("average")))


@query("models_stored")
def _(spark, sf_dir):
    folder = stage_path(spark, "models")
    sinks.save_models(fc.fit_weighted(series(spark, sf_dir)), folder)
    return fc.predict(sinks.load_models(spark, folder), HORIZON)


# --- windows, features ----------------------------------------------------------------


@query("window_aggregate")
def _(spark, sf_dir):
    return win.window_aggregate(usage_trace(spark, sf_dir), 60)


@query("window_aggregate_daily")
def _(spark, sf_dir):
    return daily(spark, sf_dir)


@query("temporal_features")
def _(spark, sf_dir):
    return temporal_features(win.window_aggregate(usage_trace(spark, sf_dir), 60).select("machine_id", "time"))


@query("workload_features", 6)
def _(spark, sf_dir):
    return workload_features(daily(spark, sf_dir)).select("machine_id", "time", "burstiness", "stability")


@query("over_provisioning", 6)
def _(spark, sf_dir):
    return over_provisioning_columns(daily(spark, sf_dir)).select(
        "machine_id", "time", "over_provision_ratio", "wasted_resources", "utilization_efficiency"
    )


@query("machine_profiles")
def _(spark, sf_dir):
    return profiles(spark, sf_dir)


@query("scaled_features", 7)
def _(spark, sf_dir):
    return features(spark, sf_dir)[0]


@query("usage_series")
def _(spark, sf_dir):
    return series(spark, sf_dir)


@query("lag_sequences")
def _(spark, sf_dir):
    return win.lag_sequences(series(spark, sf_dir))


@query("train_test_split")
def _(spark, sf_dir):
    return win.train_test_split(series(spark, sf_dir), 0.8).select("machine_id", "step", "part", "h", "y")


@query("long_series")
def _(spark, sf_dir):
    return win.keep_long_series(series(spark, sf_dir), 84).groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))


@query("last_values")
def _(spark, sf_dir):
    return win.last_values(series(spark, sf_dir))


# --- clusters -------------------------------------------------------------------------


@query("kmeans_clusters")
def _(spark, sf_dir):
    table, names = features(spark, sf_dir)
    return cluster.kmeans(cluster.feature_vectors(table, names))[0].select("id", "cluster")


@query("k_sweep", 6)
def _(spark, sf_dir):
    table, names = features(spark, sf_dir)
    return cluster.k_sweep(cluster.feature_vectors(table, names))


@query("pca_2d", 6)
def _(spark, sf_dir):
    table, names = features(spark, sf_dir)
    return cluster.pca_2d(cluster.feature_vectors(table, names))


@query("nearest_centroid")
def _(spark, sf_dir):
    table = points(spark, sf_dir)
    return cluster.nearest_centroid(table, cluster.centroids(table))


@query("cluster_stats", 6)
def _(spark, sf_dir):
    return cluster.cluster_stats(*quadrants(spark, sf_dir))


@query("cluster_stats_noise", 6)
def _(spark, sf_dir):
    # machines of the first quadrant count as noise
    table, names = quadrants(spark, sf_dir)
    return cluster.cluster_stats(table.withColumn("cluster", F.col("cluster") - 1), names)


@query("strategy_noise")
def _(spark, sf_dir):
    table, names = quadrants(spark, sf_dir)
    table = table.withColumn("cluster", F.col("cluster") - 1)
    # the last cluster is not described, so its machines get the default
    stats = cluster.cluster_stats(table, names).filter("cluster < 2")
    return cluster.assign_strategies(table, stats)


@query("kmeans_consistency")
def _(spark, sf_dir):
    """Every point is nearest to the mean of its own cluster, and the clusters hold all points."""
    table, names = features(spark, sf_dir)
    labels = stage(cluster.kmeans(cluster.feature_vectors(table, names))[0], "fitted")
    nearest = cluster.nearest_centroid(labels, cluster.centroids(labels)).withColumnRenamed("cluster", "nearest")
    both = labels.join(nearest, "id")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("cluster").alias("clusters"),
        F.count_if(F.col("cluster") != F.col("nearest")).alias("misplaced"),
    )


@query("pca_consistency", 6)
def _(spark, sf_dir):
    """Means, covariance and explained shares of the components."""
    table, names = features(spark, sf_dir)
    found = stage(cluster.pca_2d(cluster.feature_vectors(table, names)), "components")
    total = table.agg(sum((F.var_samp(c) for c in names), F.lit(0.0)).alias("v")).select("v").scalar()
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.abs(F.covar_samp("pc1", "pc2")).alias("covariance"),
        (F.var_samp("pc1") / total - F.max("explained_pc1")).alias("share1_error"),
        (F.var_samp("pc2") / total - F.max("explained_pc2")).alias("share2_error"),
        (F.max("explained_pc1") >= F.max("explained_pc2")).alias("ordered"),
    )


@query("best_k")
def _(spark, sf_dir):
    # one row per label stands in for a sweep
    sweep = points(spark, sf_dir).groupBy(F.col("cluster").alias("k")).agg(F.avg(F.col("x")[0]).alias("silhouette"))
    return cluster.best_k(sweep)


@query("kmeans_steps", 6)
def _(spark, sf_dir):
    """Three passes over the machines, from the means of the simple labels."""
    table, names = quadrants(spark, sf_dir)
    xs = stage(table.select("cluster", F.array(*names).alias("x")), "quadrants")
    starts = cluster.centroids(xs).orderBy("cluster").select("centre").collect()
    fit = lloyd(xs, [np.array([row["centre"] for row in starts])], 3, 0.0)[0]
    rows = [(i, int(n), fit.cost, *map(float, c)) for i, (n, c) in enumerate(zip(fit.sizes, fit.centres, strict=True))]
    return spark.createDataFrame(rows, "cluster long, n long, cost double, " + ", ".join(f"{c} double" for c in names))


@query("k_sweep_fixed", 6)
def _(spark, sf_dir):
    return cluster.sweep_scores(folded_labels(spark, sf_dir, FOLDS), FOLDS, rows=64)


@query("k_sweep_squared", 6)
def _(spark, sf_dir):
    return cluster.sweep_scores(folded_labels(spark, sf_dir, FOLDS), FOLDS, rows=None)


@query("best_k_swept")
def _(spark, sf_dir):
    return cluster.best_k(cluster.sweep_scores(folded_labels(spark, sf_dir, FOLDS), FOLDS, rows=None))


@query("cluster_summary", 6)
def _(spark, sf_dir):
    return cluster.cluster_summary(*quadrants(spark, sf_dir))


@query("cluster_sizes")
def _(spark, sf_dir):
    return cluster.cluster_sizes(quadrants(spark, sf_dir)[0])


@query("cluster_report")
def _(spark, sf_dir):
    return cluster.cluster_report(cluster.cluster_stats(*quadrants(spark, sf_dir)))


@query("workload_types", 6)
def _(spark, sf_dir):
    stats = cluster.cluster_stats(*quadrants(spark, sf_dir))
    return stats.select("cluster", "cpu_mean_mean", "cpu_cv_mean", "workload_type")


@query("strategy_assignment")
def _(spark, sf_dir):
    table, names = quadrants(spark, sf_dir)
    return cluster.assign_strategies(table, cluster.cluster_stats(table, names))


@query("radar_values", 6)
def _(spark, sf_dir):
    return cluster.radar_values(cluster.cluster_stats(*quadrants(spark, sf_dir)))


@query("silhouette_exact")
def _(spark, sf_dir):
    return cluster.silhouette(points(spark, sf_dir))


@query("silhouette_blocks")
def _(spark, sf_dir):
    return cluster.silhouette(points(spark, sf_dir), rows=64)


@query("silhouette_squared")
def _(spark, sf_dir):
    return cluster.silhouette_squared(points(spark, sf_dir))


@query("calinski_harabasz", 6)
def _(spark, sf_dir):
    return cluster.spread(points(spark, sf_dir)).select("calinski_harabasz")


@query("davies_bouldin", 6)
def _(spark, sf_dir):
    return cluster.davies_bouldin(points(spark, sf_dir))


@query("inertia", 6)
def _(spark, sf_dir):
    return cluster.spread(points(spark, sf_dir)).select("inertia")


@query("dbscan_labels")
def _(spark, sf_dir):
    return density.dbscan(density_points(spark, sf_dir)[1], **DENSITY).withColumnRenamed("id", "machine_id")


@query("dbscan_blocks")
def _(spark, sf_dir):
    found = density.dbscan(density_points(spark, sf_dir)[1], **DENSITY, rows=64)
    return found.withColumnRenamed("id", "machine_id")


@query("dbscan_halo")
def _(spark, sf_dir):
    # parts as small as a few points, so that halos join them
    xs = density_points(spark, sf_dir)[1]
    return dbscan_halo(xs, **DENSITY, rows=16).withColumnRenamed("id", "machine_id")


@query("gap_quartiles", 4)
def _(spark, sf_dir):
    # a few values are ranked at a time, so that brackets are narrowed
    gaps = win.time_gaps(usage_trace(spark, sf_dir)).withColumn("gap", F.col("gap_micros") / 1_000_000)
    return keyed_quantiles(gaps, ["machine_id"], "gap", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "n", rank_rows=8)


@query("conservative_levels")
def _(spark, sf_dir):
    return keyed_quantiles(series(spark, sf_dir), ["machine_id"], "y", {"level": 0.75}, rank_rows=8)


@query("autoscaler_starts")
def _(spark, sf_dir):
    medians = keyed_quantiles(series(spark, sf_dir), ["machine_id"], "y", {"median": 0.5}, rank_rows=8)
    return medians.select("machine_id", (F.col("median") * 1.5).alias("capacity"))


@query("density_sizes")
def _(spark, sf_dir):
    return density.density_sizes(density.dbscan(density_points(spark, sf_dir)[1], **DENSITY))


@query("dbscan_metrics", 6)
def _(spark, sf_dir):
    table = density_points(spark, sf_dir)[1]
    return density.dbscan_metrics(table, density.dbscan(table, **DENSITY))


@query("noise_pattern", 6)
def _(spark, sf_dir):
    table, xs, names = density_points(spark, sf_dir)
    return density.noise_pattern(table, density.dbscan(xs, **DENSITY), names)


@query("k_distances", 6)
def _(spark, sf_dir):
    return kth_distances(density_points(spark, sf_dir)[1], 10).withColumnRenamed("id", "machine_id")


@query("k_distance_blocks", 6)
def _(spark, sf_dir):
    table = density_points(spark, sf_dir)[1]
    return kth_distances(table, 10, rows=64).withColumnRenamed("id", "machine_id")


@query("k_distance_eps", 6)
def _(spark, sf_dir):
    return density.suggest_eps(density_points(spark, sf_dir)[1])


# --- forecasts ------------------------------------------------------------------------


@query("forecast_naive")
def _(spark, sf_dir):
    return fc.predict(fc.fit_naive(series(spark, sf_dir)), HORIZON)


@query("forecast_conservative")
def _(spark, sf_dir):
    return fc.predict(fc.fit_conservative(series(spark, sf_dir)), HORIZON)


@query("forecast_weighted")
def _(spark, sf_dir):
    return fc.predict(fc.fit_weighted(series(spark, sf_dir)), HORIZON)


@query("forecast_ar1")
def _(spark, sf_dir):
    return fc.predict(fc.fit_ar1(series(spark, sf_dir)), HORIZON)


@query("forecast_ar")
def _(spark, sf_dir):
    return fc.predict(fc.fit_ar(series(spark, sf_dir)), HORIZON)


@query("forecast_seasonal")
def _(spark, sf_dir):
    return fc.predict(fc.fit_seasonal_ar(series(spark, sf_dir)), HORIZON)


@query("ar_order_search", 6)
def _(spark, sf_dir):
    return fc.ar_order_search(series(spark, sf_dir))


@query("arma_order_search", 6)
def _(spark, sf_dir):
    return arma.order_search(shared_series(spark, sf_dir), max_p=2, max_d=2, max_q=2)


@query("seasonal_ma_step", 6)
def _(spark, sf_dir):
    return arma.gauss_newton_step(series(spark, sf_dir), SEASONAL_START)


@query("forecast_seasonal_ma")
def _(spark, sf_dir):
    return arma.predict_arma(arma.fit_seasonal_ma(series(spark, sf_dir)), HORIZON)


@query("ar1_likelihood", 6)
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir)
    fitted = fc.fit_ar1(table).filter(F.size("weights") == 2)
    return arma.exact_likelihood(table, fitted.withColumn("params", F.array(-F.col("weights")[0])))


@query("forecast_likeliest")
def _(spark, sf_dir):
    return arma.predict_arma(arma.fit_arma(series(spark, sf_dir), arma.Orders(p=1, d=1, q=1), exact=True), HORIZON)


@query("recurrent_readout", 6)
def _(spark, sf_dir):
    # the pooled readout of a small network, as a table: one row per input
    weights = recurrent.readout(series(spark, sf_dir), SMALL_NETWORK)
    rows = [] if weights is None else [(i, float(w)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "input int, weight double")


@query("forecast_recurrent", 6)
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir)
    return recurrent.predict_recurrent(recurrent.fit_recurrent(table, SMALL_NETWORK), HORIZON, SMALL_NETWORK)


@query("forecast_weighted_noisy")
def _(spark, sf_dir):
    return arma.predict_arma(recurrent.fit_weighted_noisy(series(spark, sf_dir), HORIZON), HORIZON)


@query("forecast_pooled")
def _(spark, sf_dir):
    return fc.predict(fc.fit_pooled(series(spark, sf_dir)), HORIZON)


@query("forecast_hybrid", 6)
def _(spark, sf_dir):
    table, strategies = series_strategies(spark, sf_dir)
    return fc.predict(fc.fit_hybrid(table, strategies), HORIZON)


@query("forecast_routed")
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir)
    return fc.predict(fc.fit_hybrid(table, simple_strategies(table)), HORIZON)


@query("comparison_routed", 6)
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir)
    return exp.compare_models(table, simple_strategies(table))[1]


@query("comparison_routed_averages", 6)
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir)
    return average_metrics(exp.compare_models(table, simple_strategies(table))[1])


@query("continued_forecast")
def _(spark, sf_dir):
    # models fitted on the train part go on from the whole series
    train, _ = split_series(spark, sf_dir)
    return fc.predict(fc.continue_from(fc.fit_weighted(train), series(spark, sf_dir)), HORIZON)


@query("forecast_default")
def _(spark, sf_dir):
    # machines whose series is too short to be fitted get the default
    table = shared_series(spark, sf_dir)
    models = fc.fit_naive(win.keep_long_series(table, 84))
    return fc.predict_machines(table, models, 3)


@query("model_comparison", 6)
def _(spark, sf_dir):
    return exp.compare_models(*series_strategies(spark, sf_dir))[1]


@query("comparison_averages", 6)
def _(spark, sf_dir):
    return average_metrics(exp.compare_models(*series_strategies(spark, sf_dir))[1])


@query("forecast_evaluation")
def _(spark, sf_dir):
    train, test = split_series(spark, sf_dir)
    predicted = fc.predict_test(fc.fit_weighted(train), test)
    errors = [M.rmse("actual", "predicted").alias("rmse"), M.mae("actual", "predicted").alias("mae")]
    errors.append(M.mape_epsilon("actual", "predicted").alias("mape"))
    return fc.evaluate_forecasts(predicted, test, errors)


# --- policies -------------------------------------------------------------------------


def _decisions(spark, sf_dir):
    table = stage(profiles(spark, sf_dir), "profiles")
    return cap.scaling_decisions(
        table.select("machine_id", F.col("request_mean").alias("current_capacity")),
        table.select("machine_id", F.col("cpu_mean").alias("predicted_usage")),
    )


@query("scaling_decisions")
def _(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query("action_distribution")
def _(spark, sf_dir):
    return cap.action_distribution(_decisions(spark, sf_dir))


@query("static_capacity")
def _(spark, sf_dir):
    return cap.static_capacity(series(spark, sf_dir)).select("machine_id", "step", "capacity")


@query("moving_average_capacity")
def _(spark, sf_dir):
    return cap.moving_average_capacity(series(spark, sf_dir)).select("machine_id", "step", "capacity")


@query("oracle_capacity")
def _(spark, sf_dir):
    return cap.oracle_capacity(series(spark, sf_dir)).select("machine_id", "step", "capacity")


@query("threshold_capacity")
def _(spark, sf_dir):
    return cap.threshold_capacity(series(spark, sf_dir)).select("machine_id", "step", "capacity")


@query("threshold_simple")
def _(spark, sf_dir):
    return cap.threshold_simple(series(spark, sf_dir)).select("machine_id", "step", "capacity")


@query("policy_capacity")
def _(spark, sf_dir):
    return cap.policy_capacity(predicted_series(spark, sf_dir)).select(
        "machine_id", "step", "current_capacity", "predicted", "action", "capacity", "confidence"
    )


@query("policy_replay")
def _(spark, sf_dir):
    train, test = split_series(spark, sf_dir)
    predicted = fc.predict_test(fc.fit_weighted(train), test).select("machine_id", "h", "y_pred")
    walked = cap.policy_replay(predicted, win.last_values(train))
    return walked.select("machine_id", "h", "y_pred", "action", "capacity")


@query("policy_backtest", 6)
def _(spark, sf_dir):
    table = predicted_series(spark, sf_dir)
    begun = table.withColumn("_start", cap.first_value("predicted") * 1.3)
    return cap.policy_backtest(begun, "_start")


@query("strategy_capacities")
def _(spark, sf_dir):
    return cap.strategy_capacities(predicted_series(spark, sf_dir))


# --- metrics --------------------------------------------------------------------------


def _one_step(spark, sf_dir):
    before = F.lag("y").over(win.Window.partitionBy("machine_id").orderBy("step"))
    return series(spark, sf_dir).withColumn("before", before).filter(F.col("before").isNotNull())


@query("prediction_metrics", 6)
def _(spark, sf_dir):
    return _one_step(spark, sf_dir).groupBy("machine_id").agg(
        *M.prediction_metrics("y", "before"),
        M.mape_epsilon("y", "before").alias("mape_epsilon"),
        M.smape("y", "before").alias("smape"),
    )


def _baselines(spark, sf_dir):
    return cap.baseline_capacities(series(spark, sf_dir))


@query("cost_metrics", 6)
def _(spark, sf_dir):
    # the usage stands in for a memory sequence
    return _baselines(spark, sf_dir).groupBy("machine_id", "strategy").agg(
        M.total_cost("capacity").alias("total_cost"),
        M.total_cost("capacity", memory="usage").alias("total_cost_with_memory"),
        M.wasted_cost("usage", "capacity").alias("wasted_cost"),
        M.cost_efficiency("usage", "capacity").alias("cost_efficiency"),
    )


@query("sla_metrics", 6)
def _(spark, sf_dir):
    return _baselines(spark, sf_dir).groupBy("machine_id", "strategy").agg(
        M.sla_violations("usage", "capacity").alias("sla_violation_count"),
        M.sla_violation_rate("usage", "capacity").alias("sla_violation_rate"),
        M.sla_compliance("usage", "capacity").alias("sla_compliance_rate"),
    )


@query("utilisation_metrics", 6)
def _(spark, sf_dir):
    return _baselines(spark, sf_dir).groupBy("machine_id", "strategy").agg(
        M.average_utilisation("usage", "capacity").alias("avg_utilization"),
        M.utilisation_variance("usage", "capacity").alias("utilization_variance"),
        M.over_provisioning("usage", "capacity").alias("over_provision_ratio"),
    )


@query("utilisation_series")
def _(spark, sf_dir):
    ratio = M.utilisation("usage", "capacity").alias("utilization")
    return _baselines(spark, sf_dir).select("machine_id", "step", "strategy", ratio)


@query("all_metrics", 6)
def _(spark, sf_dir):
    table = cap.policy_capacity(predicted_series(spark, sf_dir))
    static = table.withColumn("_static", cap.static_level())
    metrics = M.all_metrics("y", "predicted", "y", "capacity", M.total_cost("_static"))
    return static.groupBy("machine_id").agg(*metrics)


@query("results_table", 6)
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir).withColumn("predicted", cap.moving_average())
    proposed = cap.policy_capacity(table).agg(*M.all_metrics("y", "predicted", "y", "capacity"))
    averaged = table.withColumn("capacity", cap.moving_average_level())
    moving = averaged.agg(*M.all_metrics("y", "predicted", "y", "capacity"))
    return compare.results_table({"proposed": proposed, "moving_average": moving})


# --- comparisons ----------------------------------------------------------------------


def _strategies(spark, sf_dir):
    return cap.strategy_capacities(predicted_series(spark, sf_dir))


@query("compare_strategies", 6)
def _(spark, sf_dir):
    return compare.compare_strategies(_strategies(spark, sf_dir))


@query("compare_strategies_by_machine", 6)
def _(spark, sf_dir):
    return compare.compare_strategies(_strategies(spark, sf_dir), ["machine_id"])


@query("compare_baselines", 6)
def _(spark, sf_dir):
    table = shared_series(spark, sf_dir)
    proposed = cap.policy_capacity(table.withColumn("predicted", cap.moving_average()))
    return compare.compare_baselines(cap.baseline_capacities(table), proposed.withColumnRenamed("y", "usage"))


@query("cost_report")
def _(spark, sf_dir):
    return compare.cost_report(compare.compare_strategies(_strategies(spark, sf_dir)))


@query("threshold_sweep", 6)
def _(spark, sf_dir):
    return exp.threshold_sweep(predicted_series(spark, sf_dir), SWEEP)


@query("full_experiment", 6)
def _(spark, sf_dir):
    return exp.experiment_summary(exp.full_experiment(usage_trace(spark, sf_dir), TIES))


@query("experiment_routed", 6)
def _(spark, sf_dir):
    windowed = exp.observed_windows(usage_trace(spark, sf_dir), TIES, 5)
    return exp.experiment_summary(exp.experiment_on_windows(windowed, types=simple_types))


@query("cluster_sweep", 6)
def _(spark, sf_dir):
    windowed = exp.observed_windows(usage_trace(spark, sf_dir), TIES, 5)
    return exp.sweep_on_windows(windowed, CLUSTER_NUMBERS, routes=simple_routes)


@query("cleaned_costs", 6)
def _(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trace -> clean -> daily windows -> static, threshold, moving average -> cost per strategy."""
    used = ["machine_id", "event_id", "time", "start_time", "end_time", "average_usage", "maximum_usage"]
    cleaned = clean.clean_trace(usage_trace(spark, sf_dir).select(*used), TIES)
    table = win.usage_series(win.window_aggregate(cleaned, 1440))
    return compare.compare_strategies(cap.baseline_capacities(table))


# --- extras ---------------------------------------------------------------------------


@query("autocorrelation", 6)
def _(spark, sf_dir):
    return compare.autocorrelation(series(spark, sf_dir))


@query("peak_to_mean")
def _(spark, sf_dir):
    return series(spark, sf_dir).groupBy("machine_id").agg(compare.peak_to_mean().alias("peak_to_mean"))


@query("buffered_capacity", 6)
def _(spark, sf_dir):
    errors = _one_step(spark, sf_dir).groupBy("machine_id").agg(
        F.stddev_samp(F.col("y") - F.col("before")).alias("sigma"), F.max_by("y", "step").alias("predicted")
    )
    sized = compare.buffered_capacity(F.col("predicted"), F.col("sigma"), 2.33, 0.25, F.lit(1.0), 0.3)
    return errors.withColumns(sized)


@query("penalised_cost", 6)
def _(spark, sf_dir):
    cost = compare.penalised_cost("capacity", "usage", 0.05, 0.02)
    return _baselines(spark, sf_dir).groupBy("machine_id", "strategy").agg(cost.alias("penalised_cost"))


@query("margin_capacity")
def _(spark, sf_dir):
    table = profiles(spark, sf_dir)
    return table.select("machine_id", compare.margin_capacity(F.col("cpu_mean"), F.col("cpu_cv")).alias("capacity"))


# --- streams --------------------------------------------------------------------------


@query("stream_window_aggregate")
def _(spark, sf_dir):
    return window_aggregate_by_stream(usage_trace(spark, sf_dir), 60)


@query("stream_threshold")
def _(spark, sf_dir):
    return threshold_by_stream(series(spark, sf_dir)).select("machine_id", "step", "capacity")

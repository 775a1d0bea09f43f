"""k-means, cluster quality, cluster statistics and workload types."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.functions.workload import model_strategy, report_strategy, workload_type
from headroom.operators.blocks import BLOCK_ROWS, silhouettes
from headroom.operators.lloyd import best_fits, labels_of
from headroom.params import RADAR_COLUMNS, Clustering
from headroom.session import stage

NOISE = -1
PARALLEL_FITS = 10
SAME_SUM = 1e-12  # the order of sums moves a cost by less
TASK_POINTS = 200_000  # fewer points are not worth a task in each pass of each fit


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def feature_vectors(features: DataFrame, names: Sequence[str], key: str = "machine_id") -> DataFrame:
    """(id, x array, vector) staged once for the repeated passes of the fits."""
    x = F.array(*names)
    return stage(features.select(F.col(key).alias("id"), x.alias("x")), "features").withColumn(
        "vector", array_to_vector("x")
    )


def _fits(vectors: DataFrame, settings: Sequence[Clustering]) -> dict[int, KMeansModel]:
    """Best of several seeded fits for every k, of equal costs the one of the smaller seed; the fits run side by side."""
    jobs = [(c.k, c.max_iter, c.seed + i) for c in settings for i in range(c.restarts)]

    def fit(job: tuple[int, int, int]) -> tuple[float, KMeansModel]:
        k, max_iter, seed = job
        # points in blocks: the steps are the same, and a pass is one product of matrices per block
        means = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="vector", predictionCol="cluster", solver="block")
        model = means.fit(data)
        return model.summary.trainingCost, model

    data = vectors.select("vector").coalesce(math.ceil(vectors.count() / TASK_POINTS) or 1).persist()
    try:
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            done = list(pool.map(fit, jobs))
    finally:
        data.unpersist()
    best: dict[int, tuple[float, KMeansModel]] = {}
    for (k, _, _), found in zip(jobs, done, strict=True):
        if k not in best or found[0] < best[k][0] * (1 - SAME_SUM):
            best[k] = found
    return {k: model for k, (_, model) in best.items()}


def kmeans(vectors: DataFrame, settings: Clustering = Clustering()) -> tuple[DataFrame, KMeansModel]:
    """(id, x, cluster) and the model with the lowest cost of all restarts."""
    model = _fits(vectors, [settings])[settings.k]
    return model.transform(vectors).select("id", "x", "cluster"), model


def k_sweep(
    vectors: DataFrame,
    ks: Sequence[int] = range(2, 10),
    settings: Clustering = Clustering(),
    rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz) for each k.

    All restarts of all k are fitted side by side, one pass over the points per
    iteration.  ``rows`` as in ``sweep_scores``.
    """
    found = best_fits(vectors, [replace(settings, k=k) for k in ks])
    return sweep_scores(labels_of(vectors, found), list(found), rows)


def sweep_scores(labelled: DataFrame, ks: Sequence[int], rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Scores of several labellings: ``labels`` holds one label of a point for each of ``ks``.

    The distances behind all the silhouettes are computed once, block of ``rows``
    points against block.  That is quadratic; ``rows=None`` takes silhouettes of
    squared distances instead, one pass over the points.
    """
    long = labelled.select("id", "x", F.posexplode("labels").alias("m", "cluster"))
    if rows is None:
        scores = silhouette_squared(long, ["m"]).withColumnRenamed("silhouette_squared", "silhouette")
    else:
        scores = silhouettes(labelled, rows).groupBy("m").agg(F.avg("silhouette").alias("silhouette"))
    quality = spread(long, by=["m"]).select("m", "inertia", "calinski_harabasz")
    k_of = F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("m") + 1)
    return (
        quality.join(scores, "m", "left")
        .select(
            k_of.alias("k"),
            "inertia",
            F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"),
            "calinski_harabasz",
        )
    )


def best_k(sweep: DataFrame) -> DataFrame:
    """The k with the highest silhouette, the smaller one on ties."""
    return sweep.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))


# --- quality -----------------------------------------------------------------------


def centroids(points: DataFrame, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Size, mean vector and squared spread of each cluster, in one pass."""
    vector = array_to_vector("x")
    n = F.count(F.lit(1))
    variance = vector_to_array(Summarizer.variance(vector))
    within = F.aggregate(variance, F.lit(0.0), lambda s, v: s + v) * (n - 1)
    return points.groupBy(*by, cluster).agg(
        n.alias("n"),
        vector_to_array(Summarizer.mean(vector)).alias("centre"),
        within.alias("within"),
    )


def spread(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inertia and Calinski-Harabasz index in one pass over the points.

    What follows the pass works on the list of centroids, k entries.
    """
    entry = F.struct("n", "centre", "within")
    listed = centroids(points, by=by).groupBy(*by).agg(F.collect_list(entry).alias("c"))

    def add(s: Column, e: Column) -> Column:
        return F.zip_with(s, e["centre"], lambda a, b: a + b * e["n"])

    zero = F.transform(F.col("c")[0]["centre"], lambda v: v * 0.0)
    listed = listed.withColumns(
        {
            "rows": F.aggregate("c", F.lit(0).cast("long"), lambda s, e: s + e["n"]),
            "inertia": F.aggregate("c", F.lit(0.0), lambda s, e: s + e["within"]),
            "total": F.aggregate("c", zero, add),
            "k": F.size("c"),
        }
    )
    listed = listed.withColumn("mean", F.transform("total", lambda v: v / F.col("rows")))
    between = F.aggregate(
        "c", F.lit(0.0), lambda s, e: s + e["n"] * squared_distance(e["centre"], F.col("mean"))
    )
    k, rows = F.col("k"), F.col("rows")
    return listed.select(
        *by,
        "inertia",
        F.try_divide(between * (rows - k), F.col("inertia") * (k - 1)).alias("calinski_harabasz"),
        k.alias("n_clusters"),
    )


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance; infinite below two clusters.

    The comparison of clusters works on the list of centroids, k entries.
    """
    table = centroids(points).select("cluster", "centre")
    own = points.join(table, "cluster")
    widths = own.groupBy("cluster").agg(
        F.avg(F.sqrt(squared_distance(F.col("x"), F.col("centre")))).alias("width"),
        F.first("centre").alias("centre"),
    )
    listed = widths.agg(F.collect_list(F.struct("cluster", "centre", "width")).alias("c"))

    def worst(one: Column) -> Column:
        others = F.filter("c", lambda o: o["cluster"] != one["cluster"])
        apart = F.transform(
            others,
            lambda o: (one["width"] + o["width"]) / F.sqrt(squared_distance(one["centre"], o["centre"])),
        )
        return F.array_max(apart)

    total = F.aggregate(F.transform("c", worst), F.lit(0.0), lambda s, v: s + v)
    k = F.size("c")
    return listed.select(
        F.when(k > 1, total / F.nullif(k, F.lit(0))).otherwise(float("inf")).alias("davies_bouldin")
    )


def silhouette(points: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette; 0 below two clusters."""
    one = points.select("id", "x", F.array("cluster").alias("labels"))
    return silhouettes(one, rows).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette over squared distances: another number, but one pass over the points.

    The mean squared distance to a cluster is the squared distance to its
    centre plus the cluster's own spread; the k centres enter as one scalar,
    or as one row per group of ``by``.
    """
    table = centroids(points, by=by)
    everyone = F.collect_list(F.struct("cluster", "centre", "n", "within"))
    if by:
        met = points.join(table.groupBy(*by).agg(everyone.alias("everyone")), list(by))
    else:
        met = points.withColumn("everyone", table.agg(everyone).scalar())
    means = F.transform(
        F.col("everyone"),
        lambda c: F.struct(
            c["cluster"].alias("cluster"),
            c["n"].alias("n"),
            (squared_distance(F.col("x"), c["centre"]) + c["within"] / c["n"]).alias("d"),
        ),
    )
    listed = met.select(*by, "cluster", means.alias("_means"))
    own = F.filter("_means", lambda c: c["cluster"] == F.col("cluster"))[0]
    other = F.array_min(
        F.transform(F.filter("_means", lambda c: c["cluster"] != F.col("cluster")), lambda c: c["d"])
    )
    scored = listed.select(*by, own.alias("own"), other.alias("b"))
    scored = scored.withColumn("a", F.try_divide(F.col("own.d") * F.col("own.n"), F.col("own.n") - 1))
    a, b = F.col("a"), F.col("b")
    value = F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    average = F.avg(F.when(F.col("own.n") == 1, 0.0).otherwise(value)).alias("silhouette_squared")
    return scored.groupBy(*by).agg(average) if by else scored.agg(average)


def cluster_quality(points: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Silhouette, Calinski-Harabasz, Davies-Bouldin and inertia: one row."""
    return spread(points).select(
        silhouette(points, rows).scalar().alias("silhouette"),
        "calinski_harabasz",
        davies_bouldin(points).scalar().alias("davies_bouldin"),
        "inertia",
    )


# --- assignment ----------------------------------------------------------------------


def nearest_centroid(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, distance) of the closest of a few centres (cluster, centre).

    The centres, k rows, enter as one scalar; points are neither shuffled nor joined.
    """
    everyone = centres.agg(F.collect_list(F.struct("cluster", "centre"))).scalar()
    nearest = F.array_min(
        F.transform(
            F.col("centres"),
            lambda c: F.struct(
                F.sqrt(squared_distance(F.col("x"), c["centre"])).alias("distance"),
                c["cluster"].alias("cluster"),
            ),
        )
    )
    return (
        points.withColumn("centres", everyone)
        .select("id", nearest.alias("n"))
        .select("id", "n.cluster", "n.distance")
    )


def pca_2d(vectors: DataFrame) -> DataFrame:
    """Two principal components of each row, with their explained variance shares."""
    model = PCA(k=2, inputCol="vector", outputCol="p").fit(vectors)
    share = [float(v) for v in model.explainedVariance]
    p = vector_to_array("p")
    return model.transform(vectors).select(
        "id",
        p[0].alias("pc1"),
        p[1].alias("pc2"),
        F.lit(share[0]).alias("explained_pc1"),
        F.lit(share[1]).alias("explained_pc2"),
    )


# --- description ----------------------------------------------------------------------


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_stats(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Size, share of all rows, feature means and deviations, and type of each cluster.

    Noise is not described but counts in the total.
    """
    size = F.count(F.lit(1))
    functions = (("mean", F.avg), ("std", F.stddev_samp))
    grouped = rows.groupBy("cluster").agg(
        size.alias("size"), *[f(c).alias(f"{c}_{s}") for c in names for s, f in functions]
    )
    # one row per cluster is left, so the total over all of them is a small window
    share = F.col("size") / F.sum("size").over(Window.partitionBy()) * 100
    stats = grouped.withColumn("percentage", share).filter(F.col("cluster") != NOISE)
    have = set(stats.columns)

    def known(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None).cast("double")

    return stats.withColumn("workload_type", workload_type(known("cpu_mean_mean"), known("cpu_cv_mean")))


def cluster_summary(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum of each feature per cluster."""
    functions = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    return rows.groupBy("cluster").agg(*[f(c).alias(f"{c}_{s}") for c in names for s, f in functions])


def cluster_report(stats: DataFrame) -> DataFrame:
    """The statistics as formatted text columns."""
    shown = {
        "avg_cpu": ("%.3f", "cpu_mean_mean"),
        "cpu_variability": ("%.3f", "cpu_cv_mean"),
        "over_provision_ratio": ("%.2f", "over_provision_ratio_mean"),
    }
    return stats.select(
        "cluster",
        "size",
        F.format_string("%.1f%%", "percentage").alias("percentage"),
        "workload_type",
        report_strategy(F.col("workload_type")).alias("prediction_strategy"),
        *[F.format_string(f, c).alias(n) for n, (f, c) in shown.items() if c in stats.columns],
    )


def assign_strategies(labels: DataFrame, stats: DataFrame, key: str = "machine_id") -> DataFrame:
    """(machine, cluster, workload_type, strategies); noise is volatile, unknown clusters periodic."""
    types = stats.select("cluster", "workload_type")
    kind = F.when(F.col("cluster") == NOISE, "volatile").otherwise(
        F.coalesce("workload_type", F.lit("periodic"))
    )
    joined = labels.select(key, "cluster").join(types, "cluster", "left")
    return joined.select(key, "cluster", kind.alias("workload_type")).withColumns(
        {
            "prediction_strategy": report_strategy(F.col("workload_type")),
            "strategy": model_strategy(F.col("workload_type")),
        }
    )


def radar_values(stats: DataFrame) -> DataFrame:
    """Feature means limited to 1, with 0 where a feature is missing."""
    out = []
    for c in RADAR_COLUMNS:
        value = F.coalesce(F.col(c), F.lit(0.0)) if c in stats.columns else F.lit(0.0)
        out.append(F.least(value, F.lit(1.0)).alias(c))
    return stats.select("cluster", "workload_type", *out)

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.functions.workload import model_strategy, report_strategy, workload_type
from headroom.operators import cluster, density
from headroom.operators.blocks import elbow, kth_distances, near_pairs, silhouettes


def blobs(seed=0, n=90, dims=3, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (3, dims))
    x = np.concatenate([centres[i % 3] + rng.normal(0, 0.7, (1, dims)) for i in range(n)])
    if copies:
        x = np.concatenate([x, np.repeat(x[:2], copies, axis=0)])
    return x


def frame(spark, x, labels=None):
    rows = [(f"p{i:04d}", [float(v) for v in row], int(labels[i]) if labels is not None else 0) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, x array<double>, cluster int")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def plain_silhouette(x, labels):
    d, out = distances(x), []
    for i, own in enumerate(labels):
        same = (labels == own).sum()
        if same == 1:
            out.append(0.0)
            continue
        a = d[i, labels == own].sum() / (same - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("rows", [17, 4096])
def test_silhouette(spark, rows):
    x = blobs(1)
    labels = np.r_[np.arange(89) % 3, 7]  # one cluster of a single point
    got = {r["id"]: r["silhouette"] for r in silhouettes(frame(spark, x, labels).withColumn("labels", F.array("cluster")), rows).collect()}
    assert [got[f"p{i:04d}"] for i in range(90)] == pytest.approx(list(plain_silhouette(x, labels)))


def test_squared_silhouette(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    df = frame(spark, blobs(1), np.r_[np.arange(89) % 3, 7])
    judge = ClusteringEvaluator(predictionCol="cluster", featuresCol="v")
    wanted = judge.evaluate(df.withColumn("v", array_to_vector("x")))
    assert cluster.silhouette_squared(df).first()[0] == pytest.approx(wanted)


def test_quality(spark):
    x = blobs(2)
    labels = np.arange(90) % 3
    row = cluster.cluster_quality(frame(spark, x, labels), rows=32).first()
    centres = np.array([x[labels == c].mean(0) for c in range(3)])
    inertia = ((x - centres[labels]) ** 2).sum()
    between = sum((labels == c).sum() * ((centres[c] - x.mean(0)) ** 2).sum() for c in range(3))
    width = [np.sqrt(((x[labels == c] - centres[c]) ** 2).sum(1)).mean() for c in range(3)]
    apart = distances(centres)
    worst = [max((width[i] + width[j]) / apart[i, j] for j in range(3) if j != i) for i in range(3)]
    assert row["inertia"] == pytest.approx(inertia)
    assert row["calinski_harabasz"] == pytest.approx((between / 2) / (inertia / 87))
    assert row["davies_bouldin"] == pytest.approx(np.mean(worst))
    assert row["silhouette"] == pytest.approx(plain_silhouette(x, labels).mean())


def test_quality_of_one_cluster(spark):
    row = cluster.cluster_quality(frame(spark, blobs(3))).first()
    assert row["silhouette"] == 0.0 and row["davies_bouldin"] == float("inf") and row["calinski_harabasz"] is None


def plain_dbscan(x, eps, min_samples):
    near = distances(x) <= eps
    core, labels, number = near.sum(1) >= min_samples, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and labels[i] < 0:
            labels[i], todo = number, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if labels[j] < 0:
                        labels[j] = number
                        if core[j]:
                            todo.append(j)
            number += 1
    return labels


@pytest.mark.parametrize("rows", [13, 4096])
@pytest.mark.parametrize("seed, eps, copies", [(4, 0.9, 0), (5, 0.7, 12)])
def test_dbscan(spark, seed, eps, copies, rows):
    x = blobs(seed, copies=copies)
    wanted = plain_dbscan(x, eps, 5)
    got = {r["id"]: r["cluster"] for r in density.dbscan(frame(spark, x), eps, 5, rows).collect()}
    assert [got[f"p{i:04d}"] for i in range(len(x))] == wanted.tolist()
    assert -1 in wanted and wanted.max() >= 1


def test_border_point_joins_the_first_cluster(spark):
    x = np.array([[0.0], [0.1], [0.2], [1.0], [1.8], [1.9], [2.0]])
    got = density.dbscan(frame(spark, x), 0.8, 4)
    assert [r["cluster"] for r in got.orderBy("id").collect()] == plain_dbscan(x, 0.8, 4).tolist()


def test_noise_only_and_nothing(spark):
    points = frame(spark, np.arange(5.0)[:, None] * 10)
    labels = density.dbscan(points, 0.5, 2)
    assert {r["cluster"] for r in labels.collect()} == {-1}
    row = density.dbscan_metrics(points, labels).first()
    assert (row["n_clusters"], row["n_noise"], row["noise_ratio"], row["silhouette"]) == (0, 5, 1.0, None)
    assert density.dbscan(points.limit(0), 0.5, 2).count() == 0


def test_dbscan_metrics_and_noise_pattern(spark):
    x = blobs(4)
    wanted = plain_dbscan(x, 0.9, 5)
    points = frame(spark, x)
    labels = density.dbscan(points, 0.9, 5)
    row = density.dbscan_metrics(points, labels, rows=20).first()
    inside = wanted >= 0
    assert row["n_clusters"] == wanted.max() + 1 and row["n_noise"] == (~inside).sum()
    assert row["silhouette"] == pytest.approx(plain_silhouette(x[inside], wanted[inside]).mean())
    features = points.select(F.col("id").alias("machine_id"), F.col("x")[0].alias("f"))
    got = {r["is_noise"]: r["f"] for r in density.noise_pattern(features, labels, ["f"]).collect()}
    assert got[True] == pytest.approx(x[~inside, 0].mean()) and got[False] == pytest.approx(x[inside, 0].mean())


@pytest.mark.parametrize("rows", [11, 4096])
def test_kth_distance_and_elbow(spark, rows):
    x = blobs(6, copies=3)
    kth = np.sort(np.sort(distances(x), axis=1)[:, 4])
    found = kth_distances(frame(spark, x), 5, rows)
    assert sorted(r["distance"] for r in found.collect()) == pytest.approx(list(kth))
    bend = np.diff(np.diff(kth))
    assert elbow(found).first()["eps"] == pytest.approx(kth[np.argmax(bend) + 2])


def test_elbow_over_many_slices(spark):
    values = np.cumsum(np.random.default_rng(7).exponential(size=300))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, distance double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = elbow(df).first()["eps"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == pytest.approx(values[np.argmax(np.diff(np.diff(values))) + 2])


def test_dense_index(spark):
    df = spark.range(500).selectExpr("concat('k', lpad((id * 37) % 100, 3, '0')) as label")
    got = {r["label"]: r["n"] for r in density.dense_index(df, "label", "n").collect()}
    assert got == {f"k{i:03d}": i for i in range(100)}


def vectors(spark, x):
    columns = [f"f{i}" for i in range(x.shape[1])]
    rows = [(f"p{i:04d}", *map(float, row)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "machine_id string, " + ", ".join(f"{c} double" for c in columns))
    return cluster.feature_vectors(df, columns)


def test_kmeans(spark):
    from pyspark.ml.clustering import KMeans

    from headroom.params import Clustering

    x = blobs(8)
    data = vectors(spark, x)
    labels, model = cluster.kmeans(data, Clustering(k=3, restarts=4))
    centres = np.array(model.clusterCenters())
    by_id = {r["id"]: r for r in labels.collect()}
    for row in by_id.values():
        d = ((centres - np.array(row["x"])) ** 2).sum(1)
        assert row["cluster"] == d.argmin()
    assert len({r["cluster"] for r in by_id.values()}) == 3
    for seed in range(42, 46):
        single = KMeans(k=3, maxIter=300, seed=seed, featuresCol="vector").fit(data)
        assert model.summary.trainingCost <= single.summary.trainingCost + 1e-9


def test_few_points_take_one_task_a_pass(spark, monkeypatch):
    from headroom.params import Clustering

    data = vectors(spark, blobs(8)).repartition(5)
    for points, tasks in ((200_000, 1), (40, 3)):
        seen = []

        class Watched(cluster.KMeans):
            def fit(self, df):
                seen.append((df.rdd.getNumPartitions(), self.getSolver()))
                return super().fit(df)

        monkeypatch.setattr(cluster, "KMeans", Watched)
        monkeypatch.setattr(cluster, "TASK_POINTS", points)
        cluster.kmeans(data, Clustering(k=3, restarts=2))
        assert seen == [(tasks, "block")] * 2
        monkeypatch.undo()


def test_sweep_over_k(spark):
    from headroom.params import Clustering

    x = blobs(9)
    sweep = cluster.k_sweep(vectors(spark, x), range(2, 5), Clustering(restarts=3), rows=40)
    rows = {r["k"]: r for r in sweep.collect()}
    assert sorted(rows) == [2, 3, 4] and rows[2]["inertia"] > rows[3]["inertia"] > rows[4]["inertia"]
    assert cluster.best_k(sweep).first()["k"] == max(rows, key=lambda k: rows[k]["silhouette"])


def test_pca(spark):
    x = blobs(10)
    x = x - x.mean(0)
    rows = cluster.pca_2d(vectors(spark, x)).orderBy("id").collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    share = values[::-1] / values.sum()
    assert [rows[0]["explained_pc1"], rows[0]["explained_pc2"]] == pytest.approx(list(share[:2]))
    assert np.abs([r["pc1"] for r in rows]) == pytest.approx(np.abs(x @ axes[:, -1]))


def test_nearest_centroid(spark):
    x = blobs(11)
    centres = spark.createDataFrame([(4, [0.0, 0.0, 0.0]), (9, [3.0, 3.0, 3.0])], "cluster int, centre array<double>")
    for r in cluster.nearest_centroid(frame(spark, x), centres).collect():
        p = x[int(r["id"][1:])]
        d = [np.linalg.norm(p), np.linalg.norm(p - 3)]
        assert r["cluster"] == (4 if d[0] < d[1] else 9) and r["distance"] == pytest.approx(min(d))


@pytest.mark.parametrize(
    "mean, cv, kind, model, shown",
    [
        (0.2, 0.2, "stable_low_load", "arima", "ARIMA"),
        (0.3, 0.2, "periodic", "seasonal_arima", "Seasonal_ARIMA"),
        (0.2, 0.6, "periodic", "seasonal_arima", "Seasonal_ARIMA"),
        (0.5, 0.7, "bursty", "lstm", "LSTM"),
        (0.6, 0.7, "volatile", "conservative", "Conservative_Baseline"),
        (None, None, "periodic", "seasonal_arima", "Seasonal_ARIMA"),
    ],
)
def test_types_and_strategies(spark, mean, cv, kind, model, shown):
    df = spark.createDataFrame([(mean, cv)], "m double, c double")
    got = df.select(workload_type(F.col("m"), F.col("c")).alias("k")).select("k", model_strategy(F.col("k")), report_strategy(F.col("k"))).first()
    assert tuple(got) == (kind, model, shown)


def test_unknown_type_gets_the_default(spark):
    df = spark.createDataFrame([("other",)], "k string")
    assert tuple(df.select(model_strategy(F.col("k")), report_strategy(F.col("k"))).first()) == ("arima", "ARIMA")


def test_cluster_tables(spark):
    rows = [("a", 0, 0.2, 0.1), ("b", 0, 0.4, 0.3), ("c", 1, 0.9, 0.8), ("d", -1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "machine_id string, cluster int, cpu_mean double, cpu_cv double")
    stats = cluster.cluster_stats(df, ["cpu_mean", "cpu_cv"])
    got = {r["cluster"]: r for r in stats.collect()}
    assert sorted(got) == [0, 1] and got[0]["percentage"] == 50.0 and got[1]["cpu_mean_std"] is None
    assert got[1]["workload_type"] == "volatile"
    report = {r["cluster"]: r for r in cluster.cluster_report(stats).collect()}
    assert report[0]["percentage"] == "50.0%" and report[1]["avg_cpu"] == "0.900" and "over_provision_ratio" not in report[0].asDict()
    kinds = {r["machine_id"]: r for r in cluster.assign_strategies(df, stats.filter("cluster = 1")).collect()}
    assert [kinds[m]["workload_type"] for m in "abcd"] == ["periodic", "periodic", "volatile", "volatile"]
    radar = {r["cluster"]: r for r in cluster.radar_values(stats).collect()}
    assert radar[1]["memory_mean_mean"] == 0.0 and radar[1]["cpu_mean_mean"] == 0.9
    sizes = {r["cluster"]: r["size"] for r in cluster.cluster_sizes(df).collect()}
    assert sizes == {0: 2, 1: 1, -1: 1}
    summary = {r["cluster"]: r for r in cluster.cluster_summary(df, ["cpu_mean"]).collect()}
    assert (summary[0]["cpu_mean_min"], summary[0]["cpu_mean_max"]) == (0.2, 0.4)


def test_pairs_of_blocks_grow_with_the_blocks(spark):
    def pairs(side):
        corner = [F.floor(F.col("id") / side).cast("double"), (F.col("id") % side).cast("double")]
        blocks = spark.range(side * side).select(F.col("id").cast("int").alias("_block"), F.array(*corner).alias("x"))
        return near_pairs(blocks, side * side, F.lit(1.0), 2).count()

    # a block and its four neighbours
    assert pairs(6) == 5 * 36 - 4 * 6 and pairs(24) == 5 * 576 - 4 * 24


def test_blocks_without_a_bound_look_everywhere(spark):
    rows = [(k, [float(k)], float("inf") if k == 3 else 0.5) for k in range(6)]
    blocks = spark.createDataFrame(rows, "_block int, x array<double>, reach double")
    got = {tuple(r) for r in near_pairs(blocks, 6, F.col("reach"), 1).collect()}
    assert got == {(k, k) for k in range(6)} | {(3, k) for k in range(6)}

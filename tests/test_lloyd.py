"""Many k-means fits in the same passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.operators import cluster, lloyd
from headroom.params import Clustering
from headroom.plans import experiment as exp
from headroom.sources.adapters import usage_trace


def points(spark, x, parts=4):
    rows = [(f"p{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, x array<double>").repartition(parts)


def blobs(seed, n=120, dims=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (4, dims))
    return centres[np.arange(n) % 4] + rng.normal(0, 0.6, (n, dims))


def plain(x, centres, passes):
    """The same steps one point at a time; centres of the last pass and their cost."""
    centres = np.array(centres, dtype=float)
    for i in range(passes):
        own = np.array([((centres - p) ** 2).sum(1).argmin() for p in x])
        cost = sum(((centres[c] - p) ** 2).sum() for c, p in zip(own, x, strict=True))
        means = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if i == passes - 1 or np.abs(means - centres).max() == 0:
            return centres, cost, own
        centres = means


def test_fits_side_by_side_equal_fits_alone(spark, small_batches):
    x = blobs(1)
    starts = [x[:2], x[3:8], x[10:13]]
    for passes in (1, 3, 50):
        for fit, start in zip(lloyd.lloyd(points(spark, x), starts, passes, 0.0), starts, strict=True):
            centres, cost, own = plain(x, start, passes)
            assert fit.centres == pytest.approx(centres) and fit.cost == pytest.approx(cost)
            assert fit.sizes.tolist() == np.bincount(own, minlength=len(start)).tolist()


def test_a_centre_without_points_stays_and_ties_go_to_the_first(spark):
    x = np.array([[0.0], [0.0], [2.0], [1.0]])
    fit = lloyd.lloyd(points(spark, x), [np.array([[0.0], [2.0], [90.0]])], 1)[0]
    assert fit.sizes.tolist() == [3, 1, 0] and fit.cost == 1.0
    fit = lloyd.lloyd(points(spark, x), [np.array([[0.0], [2.0], [90.0]])], 9)[0]
    assert fit.centres[2, 0] == 90.0 and fit.sizes.sum() == 4


def test_passes_follow_the_longest_fit(spark, monkeypatch):
    x = blobs(2)
    passes, real = [], lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda p, fits: passes.append(len(fits)) or real(p, fits))
    found = lloyd.best_fits(points(spark, x), [Clustering(k, 5, 300, 42) for k in range(2, 8)])
    assert sorted(found) == list(range(2, 8)) and passes[0] == 30
    # finished fits leave, so the passes hold fewer and fewer fits
    assert passes == sorted(passes, reverse=True) and max(f.passes for f in found.values()) <= len(passes) < 60
    costs = [found[k].cost for k in sorted(found)]
    assert costs == sorted(costs, reverse=True)


def test_costs_are_not_above_single_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = blobs(3)
    data = points(spark, x).withColumn("vector", array_to_vector("x"))
    found = lloyd.best_fits(data, [Clustering(4, 10, 300, 42)])[4]
    single = KMeans(k=4, maxIter=300, seed=42, featuresCol="vector").fit(data).summary.trainingCost
    assert found.cost <= single + 1e-6


def test_partitions_do_not_matter(spark):
    x = blobs(4)
    one, other = (lloyd.best_fits(points(spark, x, n), [Clustering(3, 4, 100, 1)])[3] for n in (1, 7))
    assert one.centres == pytest.approx(other.centres)


def test_a_hot_point_does_not_fill_the_sample(spark):
    # two thirds of the rows are one point; three centres are found all the same
    x = np.concatenate([np.zeros((200, 2)), blobs(5, 100, 2) + 40])
    found = lloyd.best_fits(points(spark, x), [Clustering(3, 3, 50, 1)], sample_rows=60)[3]
    assert found.sizes.min() > 0 and found.sizes.max() == 200


def test_few_and_no_points(spark):
    same = points(spark, np.ones((5, 2)))
    fit = lloyd.best_fits(same, [Clustering(4, 2, 10, 1)])[4]
    assert fit.k == 1 and fit.cost == 0.0 and fit.sizes.tolist() == [5]
    none = spark.createDataFrame([], "id string, x array<double>")
    assert lloyd.best_fits(none, [Clustering()]) == {}
    with pytest.raises(ValueError, match="fit fewer"):
        lloyd.lloyd(same, [np.zeros((3_000_000, 2))], 1)


def test_labels_and_squared_sweep(spark):
    x = blobs(6)
    found = lloyd.best_fits(points(spark, x), [Clustering(k, 3, 50, 1) for k in (2, 4)])
    labelled = lloyd.labels_of(points(spark, x), found)
    for row in labelled.collect():
        p = np.array(row["x"])
        assert row["labels"] == [((found[k].centres - p) ** 2).sum(1).argmin() for k in (2, 4)]
    exact = {r["k"]: r for r in cluster.sweep_scores(labelled, [2, 4], rows=50).collect()}
    squared = {r["k"]: r for r in cluster.sweep_scores(labelled, [2, 4], rows=None).collect()}
    for m, k in enumerate((2, 4)):
        assert exact[k]["inertia"] == pytest.approx(found[k].cost) == pytest.approx(squared[k]["inertia"])
        alone = labelled.select("id", "x", F.col("labels")[m].alias("cluster"))
        assert squared[k]["silhouette"] == pytest.approx(cluster.silhouette_squared(alone).first()[0])
        assert exact[k]["silhouette"] == pytest.approx(cluster.silhouette(alone).first()[0])


def test_one_setting_of_the_sweep_is_the_experiment(spark, data_folder):
    from headroom.plans.queries import simple_routes, simple_types

    windowed = exp.observed_windows(exp.sample_machines(usage_trace(spark, data_folder), 30), ["event_id"], 1440)
    whole = exp.experiment_on_windows(windowed, types=simple_types)["comparison"].filter("strategy = 'proposed'").first()
    rows = {r["n_clusters"]: r for r in exp.sweep_on_windows(windowed, [3, 4], routes=simple_routes).collect()}
    assert sorted(rows) == [3, 4]
    assert rows[4]["cost_reduction"] == pytest.approx(whole["cost_reduction_pct"])
    assert rows[4]["utilization"] == pytest.approx(whole["utilization"])
    assert rows[4]["sla_violations"] == pytest.approx(whole["sla_violation_rate"])



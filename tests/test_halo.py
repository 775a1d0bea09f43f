"""Density clustering by parts of the space and halos."""

import numpy as np
import pytest

from headroom.operators import density, halo


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def blobs(seed, dims, n=260):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-4, 4, (6, dims))
    x = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.35, (n, dims))
    return np.concatenate([x, rng.uniform(-6, 6, (40, dims)), x[:10]])


def plain(x, eps, least):
    """Clusters by walking from core point to core point."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i], open_ = i, [i]
        while open_:
            k = open_.pop()
            for j in np.flatnonzero(near[k] & core & (label < 0)):
                label[j] = i
                open_.append(j)
    for i in np.flatnonzero(~core):
        touched = label[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    numbers = {v: k for k, v in enumerate(sorted(set(label[core])))}
    return [numbers.get(v, -1) for v in label]


@pytest.mark.parametrize("seed, dims, rows", [(1, 2, 20), (2, 6, 20), (3, 3, 1000)])
def test_halo_clusters_are_the_clusters(spark, seed, dims, rows):
    x = blobs(seed, dims)
    eps = 0.45 * np.sqrt(dims)
    found = halo.dbscan_halo(frame(spark, x), eps, 6, rows=rows).collect()
    assert [r["cluster"] for r in sorted(found)] == plain(x, eps, 6)
    assert len({r["cluster"] for r in found}) > 2


def test_dense_parts_are_cut_into_chunks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.05, (150, 3)), rng.uniform(-3, 3, (60, 3))])
    found = halo.dbscan_halo(frame(spark, x), 0.5, 5, rows=25).collect()
    assert [r["cluster"] for r in sorted(found)] == plain(x, 0.5, 5)


@pytest.mark.parametrize("dims", [1, 2, 4, 6])
def test_places_are_bounded_and_cover_what_is_near(dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.uniform(0, 10, (1500, dims)), rng.normal(5, 0.2, (1500, dims))])
    eps = 0.6
    tree, parts = halo.split_space(x[::2], eps, 20)
    assert parts > 3
    rows, part, own = halo.places(x, tree, eps)
    assert np.bincount(rows).max() <= 2**dims
    assert np.array_equal(np.sort(rows[own]), np.arange(len(x)))  # everyone lives somewhere, once
    home = np.empty(len(x), dtype=int)
    home[rows[own]] = part[own]
    there = set(zip(rows.tolist(), part.tolist(), strict=True))
    for i in range(0, len(x), 37):
        near = np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(1)) <= eps)
        assert all((j, home[i]) in there for j in near.tolist())


def test_halo_of_few_points(spark):
    assert halo.dbscan_halo(frame(spark, []), 0.5, 2).count() == 0
    assert [r["cluster"] for r in sorted(halo.dbscan_halo(frame(spark, [[1.0, 2.0]] * 3 + [[9.0, 9.0]]), 0.5, 3).collect())] == [0, 0, 0, -1]
    dealt = halo.with_halo(
        frame(spark, blobs(5, 2)).groupBy("x").agg({"id": "min", "*": "count"}).toDF("x", "w", "id").select("id", "x", "w"), 0.3, 20
    )
    told = halo.halo_copies(dealt).first()
    assert told["parts"] > 1 and 0 < told["copies"] and told["most"] <= 4
    assert density.NOISE == -1

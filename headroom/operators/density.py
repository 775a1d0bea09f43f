"""Density clustering: points with enough neighbours within eps, joined up.

Copies of a point are merged first and carry their number.  Neighbours are
counted inside a point's own block first; only points with too few of them look
at other blocks.  Core points are joined up inside their block, and then only
components of blocks are, by one link each; points and pairs of points never
leave a task for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from headroom.operators.blocks import (
    BLOCK_ROWS,
    boxes_near,
    elbow,
    kth_distances,
    met_blocks,
    near_box,
    over_rows,
    packed,
    silhouettes,
    spatial_blocks,
    squared_limit,
    squared_stripes,
    unflattened,
)
from headroom.operators.ordered import range_slices
from headroom.params import Clustering
from headroom.session import stage

NOISE = -1


def feature_points(features: DataFrame, names: list[str], key: str = "machine_id") -> DataFrame:
    """(id, x) out of feature columns."""
    return features.select(F.col(key).alias("id"), F.array(*names).alias("x"))


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number distinct values 0, 1, ... in order, without one task holding them all."""
    sliced = range_slices(df.select(column).distinct(), [column], "index")
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select("_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(column)) - 1
    return sliced.join(offsets, "_slice").select(column, (F.col("_offset") + rank).cast("int").alias(name))


def count_inside(dims: int, eps: float):
    """(id, n): the weight within eps of every point of a block that lives there, inside the block."""
    limit = squared_limit(eps)

    def count(block: dict) -> pd.DataFrame:
        x, own = unflattened(block["x"], dims), np.asarray(block["own"], dtype=bool)
        weights, ids = np.asarray(block["w"], dtype=float), np.asarray(block["id"])[own]
        found = [(squares <= limit) @ weights for _, squares in squared_stripes(x[own], x)]
        return pd.DataFrame({"id": ids, "n": np.concatenate([np.zeros(0), *found]).astype(np.int64)})

    return count


def count_outside(dims: int, eps: float):
    """(id, n): the weight of the second block's points within eps of every point of the first, where there is any."""
    limit = squared_limit(eps)

    def count(pair: dict) -> pd.DataFrame:
        x, weights = unflattened(pair["x"], dims), np.asarray(pair["r_w"], dtype=float)
        at = near_box(x, pair["r_low"], pair["r_high"], eps * eps)
        n = [(squares <= limit) @ weights for _, squares in squared_stripes(x[at], unflattened(pair["r_x"], dims))]
        n = np.concatenate([np.zeros(0), *n]).astype(np.int64)
        return pd.DataFrame({"id": np.asarray(pair["id"])[at[n > 0]], "n": n[n > 0]})

    return count


def _components(x: np.ndarray, limit: float) -> np.ndarray:
    """The first row of every row's component; a step asks the rows not yet reached only."""
    component, left = np.arange(len(x)), np.arange(len(x))
    while len(left):
        first, edge = left[0], left[:1]
        left = left[1:]
        while len(edge) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for _, squares in squared_stripes(x[edge], x[left]):
                hit |= (squares <= limit).any(axis=0)
            edge, left = left[hit], left[~hit]
            component[edge] = first
    return component


def connect_inside(dims: int, eps: float):
    """A block of core points, sorted by id, with the components inside it: their numbers and smallest ids."""
    limit = squared_limit(eps)

    def connect(block: dict) -> pd.DataFrame:
        component = _components(unflattened(block["x"], dims), limit)
        first, number = np.unique(component, return_inverse=True)
        return pd.DataFrame([block | {"number": number, "root": np.asarray(block["id"])[first]}])

    return connect


def connect_outside(dims: int, eps: float):
    """(id, root): components of two blocks that touch.

    The largest component of the first block goes ahead: what it has met once
    need not be asked again.
    """
    limit = squared_limit(eps)

    def connect(pair: dict) -> pd.DataFrame:
        x, y = unflattened(pair["x"], dims), unflattened(pair["r_x"], dims)
        number, other = np.asarray(pair["number"]), np.asarray(pair["r_number"])
        at = near_box(x, pair["r_low"], pair["r_high"], eps * eps)
        to = near_box(y, pair["low"], pair["high"], eps * eps)
        found: set[tuple[int, int]] = set()
        if len(at) and len(to):
            main = np.bincount(number[at]).argmax()
            ahead, rest = at[number[at] == main], at[number[at] != main]
            asked, start, size = to, 0, 8
            while start < len(ahead) and len(asked):
                met = np.zeros(len(asked), dtype=bool)
                for _, squares in squared_stripes(x[ahead[start : start + size]], y[asked]):
                    met |= (squares <= limit).any(axis=0)
                names = np.unique(other[asked[met]])
                found |= {(int(main), int(b)) for b in names}
                asked = asked[~np.isin(other[asked], names)]
                start, size = start + size, size * 4
            for rows, squares in squared_stripes(x[rest], y[to]):
                i, j = np.nonzero(squares <= limit)
                links = np.unique(number[rest[rows]][i] * (len(y) + 1) + other[to[j]])
                found |= {(int(v) // (len(y) + 1), int(v) % (len(y) + 1)) for v in links}
        edges = [(pair["root"][a], pair["r_root"][b]) for a, b in sorted(found)]
        return pd.DataFrame(edges, columns=["id", "root"], dtype=object)

    return connect


def adopt_near(dims: int, eps: float):
    """(id, cluster): the smallest cluster of the second block's core points within eps."""
    limit = squared_limit(eps)

    def adopt(pair: dict) -> pd.DataFrame:
        x, cluster = unflattened(pair["x"], dims), np.asarray(pair["r_cluster"], dtype=np.int64)
        none = np.iinfo(np.int64).max
        at = near_box(x, pair["r_low"], pair["r_high"], eps * eps)
        y = unflattened(pair["r_x"], dims)
        low = [np.where(squares <= limit, cluster, none).min(axis=1) for _, squares in squared_stripes(x[at], y)]
        low = np.concatenate([np.zeros(0, dtype=np.int64), *low])
        return pd.DataFrame({"id": np.asarray(pair["id"])[at[low < none]], "cluster": low[low < none].astype(np.int32)})

    return adopt


def components(stars: DataFrame) -> DataFrame:
    """Smallest id connected to each id, from (id, root) edges: (id, label)."""
    labels = stage(stars.groupBy("id").agg(F.min(F.least("id", "root")).alias("label")), "labels")
    while True:
        lowest = stars.join(labels, "id").groupBy("root").agg(F.min("label").alias("low"))
        pulled = stars.join(lowest, "root").groupBy("id").agg(F.min("low").alias("low"))
        hopped = (
            labels.join(pulled, "id")
            .select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        )
        jump = hopped.select(F.col("id").alias("label"), F.col("label").alias("further"))
        updated = stage(
            hopped.join(jump, "label", "left").select(
                "id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"
            ),
            "labels",
        )
        if updated.filter(F.col("label") != F.col("old")).isEmpty():
            return updated.select("id", "label")
        labels = updated.select("id", "label")


def dbscan(
    points: DataFrame,
    eps: float = Clustering.eps,
    min_samples: int = Clustering.min_samples,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, x) -> (id, cluster), -1 for noise; a point counts among its own neighbours.

    Clusters are numbered by their smallest core id; a border point joins the
    first of its clusters.
    """
    points = stage(points.select("id", "x"), "points")
    dims = points.select(F.size("x")).first()
    if dims is None:
        return points.select("id", F.lit(NOISE).alias("cluster"))
    dims = dims[0]
    kind = dict(points.dtypes)["id"]
    distinct = points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    blocks, _ = spatial_blocks(distinct.withColumn("own", F.lit(True)), dims, eps, rows)
    return joined_up(points, blocks, dims, eps, min_samples, kind)


def joined_up(
    points: DataFrame, blocks: DataFrame, dims: int, eps: float, min_samples: int, kind: str, part: Sequence[str] = ()
) -> DataFrame:
    """(id, cluster) of all points out of their blocks (id, x, w, own, _block).

    A point may have copies in several blocks and is counted where it is its
    block's ``own``.  Blocks are compared if they agree in ``part``; copies of
    a core point join components too.
    """
    keys, near = ["_block", *part], boxes_near(dims, F.lit(eps))
    for c in part:
        near = near & (F.col(c) == F.col(f"r_{c}"))
    apart = near & (F.col("_block") != F.col("r_block"))
    every = packed(blocks, dims, ("id", "w", "own"), keys)
    inside = stage(over_rows(every, count_inside(dims, eps), f"id {kind}, n bigint"), "inside")
    # what has enough neighbours in its own block looks no further
    own = blocks.filter("own").drop("w", "own")
    few = packed(own.join(inside.filter(F.col("n") < min_samples).select("id"), "id"), dims, ("id",), keys)
    outside = over_rows(met_blocks(few, every.drop("id", "own"), dims, apart), count_outside(dims, eps), f"id {kind}, n bigint")
    degree = inside.unionByName(outside).groupBy("id").agg((F.sum("n") >= min_samples).alias("core"))
    known = stage(blocks.drop("w").join(degree, "id"), "degrees")

    core = packed(known.filter("core"), dims, ("id",), keys)
    shape = ", ".join(f"{c} {t}" for c, t in core.dtypes) + f", number array<int>, root array<{kind}>"
    core = stage(over_rows(core, connect_inside(dims, eps), shape), "core-blocks")
    upper = near & (F.col("_block") < F.col("r_block"))
    joined = met_blocks(core.drop("id"), core.drop("id"), dims, upper)
    links = over_rows(joined, connect_outside(dims, eps), f"id {kind}, root {kind}")
    # from here on one row per component of a block; copies of a point join the components they are in
    rooted = core.select(F.transform("number", lambda v: F.col("root")[v]).alias("root"), "id")
    rooted = rooted.select(F.inline(F.arrays_zip("id", "root")))
    lowest = stage(rooted.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")), "rooted")
    copied = rooted.join(lowest.filter("low < high").select("id", "low"), "id").select(F.col("root").alias("id"), F.col("low").alias("root"))
    alone = core.select(F.explode("root").alias("id")).select("id", F.col("id").alias("root"))
    labels = components(stage(alone.unionByName(links).unionByName(copied).distinct(), "stars"))
    # components are numbered by their smallest core id
    labels = labels.join(dense_index(labels, "label", "cluster"), "label").select(F.col("id").alias("low"), "cluster")
    clusters = stage(lowest.join(labels, "low").select("id", "cluster"), "core-clusters")

    rest = packed(known.filter("own AND NOT core"), dims, ("id",), keys)
    around = packed(known.filter("core").join(clusters, "id"), dims, ("cluster",), keys)
    border = over_rows(met_blocks(rest, around, dims, near), adopt_near(dims, eps), f"id {kind}, cluster int")
    border = border.groupBy("id").agg(F.min("cluster").alias("cluster"))
    named = clusters.unionByName(border).join(own.select("id", "x"), "id").select("x", "cluster")
    found = points.join(named, "x", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
    return stage(found, "dbscan")


def density_sizes(labels: DataFrame) -> DataFrame:
    """Points of every cluster and of the noise: (cluster, size)."""
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def noise_counts(labels: DataFrame) -> DataFrame:
    """Clusters, noise points and their share: one row."""
    noise = F.count_if(F.col("cluster") == NOISE)
    return labels.agg(
        F.count_distinct(F.nullif(F.col("cluster"), F.lit(NOISE))).alias("n_clusters"),
        noise.alias("n_noise"),
        F.try_divide(noise, F.count(F.lit(1))).alias("noise_ratio"),
    )


def dbscan_metrics(points: DataFrame, labels: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Noise counts and the silhouette of the points that are in a cluster.

    The silhouette needs two clusters and more points than clusters.
    """
    counts = noise_counts(labels)
    kept = points.select("id", "x").join(labels.filter(F.col("cluster") != NOISE), "id").withColumn(
        "labels", F.array("cluster")
    )
    score = silhouettes(kept, rows).agg(
        F.struct(F.avg("silhouette").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    found = counts.withColumn("score", score.scalar())
    usable = (F.col("n_clusters") > 1) & (F.col("score.n") > F.col("n_clusters"))
    return found.select("n_clusters", "n_noise", "noise_ratio", F.when(usable, F.col("score.s")).alias("silhouette"))


def noise_pattern(features: DataFrame, labels: DataFrame, names: list[str], key: str = "machine_id") -> DataFrame:
    """Mean features of noise and of clustered machines."""
    flagged = features.join(labels.withColumnRenamed("id", key), key)
    return flagged.groupBy((F.col("cluster") == NOISE).alias("is_noise")).agg(
        *[F.avg(c).alias(c) for c in names]
    )


def suggest_eps(points: DataFrame, k: int = Clustering.min_samples, rows: int = BLOCK_ROWS) -> DataFrame:
    """eps at the elbow of the sorted k-th neighbour distances."""
    return elbow(kth_distances(points, k, rows))

"""Density clustering over a split of the space in all of its dimensions.

Space is split near the medians of a sample, in whichever dimension a part is
widest.  A point lives in one part and is copied, as its halo, to the parts
within eps, so every part knows all neighbours of its own points.  Parts are
joined up by themselves; a copy has one identity in all of them, and that
merges their labels.

A part is cut only where both sides stay two eps wide.  The box of everything
within eps of a point is then no wider than any part, each part it meets holds
one of its corners, and a point has at most 2^dimensions places however dense
its surroundings are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from headroom.operators.blocks import BLOCK_ROWS, matrix, spatial_blocks
from headroom.operators.density import NOISE, joined_up
from headroom.params import Clustering
from headroom.session import stage

SAMPLE_POINTS = 100_000  # the split is decided on these, and nothing else is
LEAST_SAMPLED = 16  # of a part
SLACK = 1 + 1e-9


@dataclass
class Split:
    """Below ``cut`` in ``dimension`` lies ``below``, else ``above``; a part has a number instead."""

    dimension: int = -1
    cut: float = 0.0
    below: Split | None = None
    above: Split | None = None
    part: int = -1


def split_space(sample: np.ndarray, eps: float, most: int) -> tuple[Split, int]:
    """(tree, number of parts): parts of at most ``most`` sampled points, unless they are too narrow to cut."""
    dims, made = sample.shape[1], 0

    def grow(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> Split:
        nonlocal made
        if len(points) > most:
            widths = points.max(axis=0) - points.min(axis=0)
            for k in np.argsort(-widths, kind="stable"):
                if high[k] - low[k] < 4 * eps:
                    continue
                cut = float(np.clip(np.median(points[:, k]), low[k] + 2 * eps, high[k] - 2 * eps))
                below = points[:, k] < cut
                if 0 < below.sum() < len(points):
                    under, over = high.copy(), low.copy()
                    under[k] = over[k] = cut
                    return Split(int(k), cut, grow(points[below], low, under), grow(points[~below], over, high))
        made += 1
        return Split(part=made - 1)

    return grow(sample, np.full(dims, -np.inf), np.full(dims, np.inf)), made


def places(x: np.ndarray, tree: Split, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, own): every part a point lives in or is copied to."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    reach = eps * SLACK

    def go(node: Split, rows: np.ndarray, own: np.ndarray) -> None:
        if not len(rows):
            return
        if node.below is None:
            found.append((rows, node.part, own))
            return
        v = x[rows, node.dimension]
        left, right = v - reach < node.cut, v + reach >= node.cut
        go(node.below, rows[left], own[left] & (v[left] < node.cut))
        go(node.above, rows[right], own[right] & (v[right] >= node.cut))

    go(tree, np.arange(len(x)), np.ones(len(x), dtype=bool))
    if not found:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=bool)
    rows, own = (np.concatenate([f[k] for f in found]) for k in (0, 2))
    return rows, np.concatenate([np.full(len(f[0]), f[1]) for f in found]), own


def with_halo(distinct: DataFrame, eps: float, rows: int, sample_points: int = SAMPLE_POINTS) -> DataFrame:
    """Points (id, x, w) with ``part`` and ``own``: a row for the part a point lives in, and one per copy."""
    n = distinct.count()
    sample = distinct.select("x").orderBy(F.xxhash64("x"), "x").limit(sample_points).toPandas()
    if sample.empty:
        return distinct.withColumns({"part": F.lit(0), "own": F.lit(True)})
    most = max(LEAST_SAMPLED, int(rows * len(sample) / n))
    tree, _ = split_space(matrix(sample["x"]), eps, most)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, part, own = places(matrix(batch["x"]), tree, eps)
                yield batch.iloc[row].assign(part=part, own=own)

    kinds = dict(distinct.dtypes)
    return distinct.select("id", "x", "w").mapInPandas(deal, f"id {kinds['id']}, x {kinds['x']}, w long, part int, own boolean")


def dbscan_halo(
    points: DataFrame,
    eps: float = Clustering.eps,
    min_samples: int = Clustering.min_samples,
    rows: int = BLOCK_ROWS,
    sample_points: int = SAMPLE_POINTS,
) -> DataFrame:
    """(id, x) -> (id, cluster), -1 for noise: the clusters of ``dbscan``, by parts and halos.

    Copies of a point are merged first.  The sample only decides where parts
    end, never which points are near.  Parts above ``rows`` points, where
    space cannot be cut any further, are worked on as pairs of chunks; with more
    points chunks grow first, up to a few thousand.  An
    empty table gives no rows; equal points fall together.
    """
    points = stage(points.select("id", "x"), "points")
    kind = dict(points.dtypes)["id"]
    distinct = stage(points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "distinct-points")
    dealt = stage(with_halo(distinct, eps, rows, sample_points), "halo")
    dims = points.select(F.size("x")).first()
    if dims is None:
        return points.select("id", F.lit(NOISE).alias("cluster"))
    # a chunk is what a block has of one part
    blocks, _ = spatial_blocks(dealt, dims[0], eps, rows, ["part"])
    # a copy is a core point where it lives and in every halo, which joins the parts
    return joined_up(points, blocks, dims[0], eps, min_samples, kind, ["part"])


def halo_copies(dealt: DataFrame) -> DataFrame:
    """(parts, points, copies, most): how much the halos add, and the most places one point has."""
    each = dealt.groupBy("id").agg(F.count(F.lit(1)).alias("places"))
    return each.agg(
        F.lit(dealt.agg(F.count_distinct("part")).first()[0]).alias("parts"),
        F.count(F.lit(1)).alias("points"),
        (F.sum("places") - F.count(F.lit(1))).alias("copies"),
        F.max("places").alias("most"),
    )


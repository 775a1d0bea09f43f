"""Many k-means fits at once: every restart and every k takes its step in the same pass over the points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from headroom.params import Clustering
from headroom.session import stage

SAMPLE_ROWS = 20_000  # points the starting centres are drawn from
TOLERANCE = 1e-4  # a fit whose centres move no further is finished
SAME_COST = 1e-9  # the order of sums moves a cost by less
MAX_NUMBERS = 4_000_000  # numbers in the centres of all fits, which go to every task
CHUNK_NUMBERS = 2_000_000  # distances a task holds at a time


@dataclass
class Fit:
    """Centres of one fit, and the cost of the points at these centres."""

    k: int
    centres: np.ndarray
    cost: float = float("inf")
    sizes: np.ndarray | None = None
    passes: int = 0


def starting_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance to those before.

    Fewer where the sample has fewer distinct points.
    """
    draw = np.random.default_rng([seed, k])
    chosen = [sample[draw.integers(len(sample))]]
    away = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k and away.sum() > 0:
        chosen.append(sample[draw.choice(len(sample), p=away / away.sum())])
        away = np.minimum(away, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _assigned(x: np.ndarray, stacked: np.ndarray, ends: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first centre, number of centres, nearest centre of each row) for every fit."""
    distance = (stacked**2).sum(1) - 2.0 * (x @ stacked.T)
    first = 0
    for end in ends:
        yield first, end - first, distance[:, first:end].argmin(1)
        first = end


def _pass(points: DataFrame, fits: Sequence[Fit]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sum and squared distances of the points of every centre.

    Tasks return one row per centre, and these are added up before they reach
    the driver: one row per centre of all fits.
    """
    stacked = np.concatenate([f.centres for f in fits])
    ends = np.cumsum([len(f.centres) for f in fits]).tolist()
    width = stacked.shape[1]
    if stacked.size > MAX_NUMBERS:
        raise ValueError(f"{stacked.size} numbers in the centres of {len(fits)} fits; fit fewer at a time")
    chunk = max(1, CHUNK_NUMBERS // len(stacked))
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, cost = np.zeros(len(stacked), dtype=np.int64), np.zeros(stacked.shape), np.zeros(len(stacked))
        for batch in batches:
            every = batch.to_numpy(dtype=float)
            for at in range(0, len(every), chunk):
                x = every[at : at + chunk]
                for first, k, nearest in _assigned(x, stacked, ends):
                    own = slice(first, first + k)
                    n[own] += np.bincount(nearest, minlength=k)
                    off = ((x - stacked[first + nearest]) ** 2).sum(1)
                    cost[own] += np.bincount(nearest, weights=off, minlength=k)
                    for d in range(width):
                        total[own, d] += np.bincount(nearest, weights=x[:, d], minlength=k)
        met = np.flatnonzero(n)
        out = pd.DataFrame(total[met], columns=names)
        yield out.assign(centre=met, n=n[met], cost=cost[met])

    schema = "centre long, n long, cost double, " + ", ".join(f"{c} double" for c in names)
    # plain columns reach Python as they are; an array column is an object per row there, in every pass
    added = points.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)]).mapInPandas(lambda b: (o[["centre", "n", "cost", *names]] for o in sums(b)), schema)
    rows = added.groupBy("centre").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)]).toPandas()
    n, cost, total = np.zeros(len(stacked), dtype=np.int64), np.zeros(len(stacked)), np.zeros(stacked.shape)
    at = rows["centre"].to_numpy()
    n[at], cost[at], total[at] = rows["n"], rows["cost"], rows[names]
    return n, cost, total


def lloyd(points: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tolerance: float = TOLERANCE) -> list[Fit]:
    """Fits from the given centres, all of them advanced in each pass over the points (x array).

    Takes as many passes as the longest fit, at most ``max_iter``; finished fits
    leave the passes.  A fit holds the centres its cost was measured at.  Of
    equally near centres the first one takes a point; a centre without points stays.
    """
    fits = [Fit(len(c), np.asarray(c, dtype=float)) for c in starts]
    going, ahead = list(fits), [f.centres for f in fits]
    for _ in range(max_iter):
        for f, centres in zip(going, ahead, strict=True):
            f.centres = centres
        n, cost, total = _pass(points, going)
        moving, ahead, first = [], [], 0
        for f in going:
            own = slice(first, first + f.k)
            first += f.k
            f.sizes, f.cost, f.passes = n[own], float(cost[own].sum()), f.passes + 1
            means = np.where(n[own, None] > 0, total[own] / np.maximum(n[own, None], 1), f.centres)
            if ((means - f.centres) ** 2).sum(1).max() > tolerance**2:
                moving.append(f)
                ahead.append(means)
        going = moving
        if not going:
            break
    return fits


def best_fits(
    vectors: DataFrame, settings: Sequence[Clustering], sample_rows: int = SAMPLE_ROWS, tolerance: float = TOLERANCE
) -> dict[int, Fit]:
    """The cheapest of all restarts for every k; of equal costs, up to rounding, the one of the smaller seed.

    Centres start at points of a sample of ``sample_rows``, which is drawn by a
    hash of the id and so does not depend on partitions, nor on how often a
    point occurs.  No points: no fits.
    """
    drawn = vectors.select("id", "x").orderBy(F.xxhash64("id"), "id", "x").limit(sample_rows).toPandas()
    if drawn.empty:
        return {}
    sample = np.stack(drawn["x"].to_numpy())
    asked = [(c.k, c.seed + i, c.max_iter) for c in settings for i in range(c.restarts)]
    points = vectors.select("x").persist()
    try:
        fits: list[Fit] = []
        for limit in sorted({m for _, _, m in asked}):
            starts = [starting_centres(sample, k, seed) for k, seed, m in asked if m == limit]
            fits += lloyd(points, starts, limit, tolerance)
    finally:
        points.unpersist()
    asked.sort(key=lambda a: a[2])
    best: dict[int, Fit] = {}
    for (k, _, _), fit in zip(asked, fits, strict=True):
        if k not in best or fit.cost < best[k].cost * (1 - SAME_COST):
            best[k] = fit
    return best


def nearest_of(x: str, centres: np.ndarray) -> Column:
    """Number of the nearest centre of an array column, the first one on ties."""
    def squared(c: Sequence[float]) -> Column:
        return F.aggregate(
            F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    return F.array_min(F.array(*[F.struct(squared(c), F.lit(i).alias("at")) for i, c in enumerate(centres)]))["at"]


def labels_of(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``vectors`` (id, x) with ``labels``, one number per k in the order of ``fits``; staged."""
    labels = F.array(*[nearest_of("x", f.centres) for f in fits.values()])
    return stage(vectors.select("id", "x", labels.alias("labels")), "sweep")

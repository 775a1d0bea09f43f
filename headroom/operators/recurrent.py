"""A recurrent, non-linear forecaster, and noise for forecasts.

The recurrent part is a fixed random network: its state takes in one scaled
value per step and is never trained.  Only the readout is, a ridge regression
of the next value on the state and the last values, pooled over all machines
out of sums of products that are added up across partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from headroom.operators.arma import machine_arrays, matrices
from headroom.operators.forecast import fit_weighted
from headroom.params import Forecasting


@dataclass(frozen=True)
class Network:
    """A fixed network; two with the same numbers are the same network."""

    units: int = 24
    lags: int = Forecasting.lookback
    radius: float = 0.7  # how fast the state forgets
    gain: float = 2.0
    ridge: float = 1e-4  # times the number of rows, on all weights but the intercept
    seed: int = 11

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state to state, value to state, shift)."""
        rng = np.random.default_rng(self.seed)
        inner = rng.uniform(-1, 1, (self.units, self.units))
        inner *= self.radius / np.abs(np.linalg.eigvals(inner)).max()
        return inner, self.gain * rng.uniform(-1, 1, self.units), rng.uniform(-1, 1, self.units)

    @property
    def size(self) -> int:
        """Inputs of the readout: 1, the last values, newest first, and the state."""
        return 1 + self.lags + self.units


def scaled(y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(series as parts of their own range, lowest values, ranges); a flat series is 0."""
    inside = np.arange(y.shape[1]) < lengths[:, None]
    low = np.where(inside, y, np.inf).min(axis=1)
    span = np.where(inside, y, -np.inf).max(axis=1) - low
    return np.where(inside, y - low[:, None], 0.0) / np.where(span > 0, span, 1.0)[:, None], low, span


def walk(x: np.ndarray, network: Network) -> Iterator[tuple[int, np.ndarray]]:
    """(step, inputs of the readout after it) from the first step with all lags on, all series side by side."""
    inner, into, shift = network.weights()
    state = np.zeros((len(x), network.units))
    for t in range(x.shape[1]):
        state = np.tanh(state @ inner.T + x[:, t : t + 1] * into + shift)
        if t >= network.lags - 1:
            recent = x[:, t - network.lags + 1 : t + 1][:, ::-1]
            yield t, np.concatenate([np.ones((len(x), 1)), recent, state], axis=1)


def readout_sums(arrays: DataFrame, network: Network, min_points: int) -> DataFrame:
    """(i, j, s): sums of products of the readout's inputs and the value that follows, the last of both.

    A task hands on one small matrix per batch of machines.
    """
    size = network.size + 1
    i, j = (a.ravel() for a in np.indices((size, size)))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = np.zeros((size, size))
            for _, y, lengths in matrices(batch["values"]):
                long = lengths >= min_points
                if not long.any():
                    continue
                x, _, _ = scaled(y[long], lengths[long])
                for t, inputs in walk(x[:, :-1], network):
                    there = t + 1 < lengths[long]
                    row = np.concatenate([inputs, x[:, t + 1 : t + 2]], axis=1)[there]
                    total += row.T @ row
            yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

    return arrays.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def solve_readout(sums: np.ndarray, network: Network) -> np.ndarray:
    """Ridge weights out of the matrix of sums; its first entry is the number of rows."""
    gram, target = sums[:-1, :-1].copy(), sums[:-1, -1]
    gram[np.diag_indices(len(gram))] += network.ridge * sums[0, 0] * (np.arange(len(gram)) > 0)
    return np.linalg.solve(gram, target)


def readout(series: DataFrame, network: Network = Network(), key: str = "machine_id", order: str = "step", y: str = "y") -> np.ndarray | None:  # noqa: B008
    """The readout's weights, pooled over all machines; None without a machine that is long enough."""
    sums = readout_sums(machine_arrays(series, key, order, y), network, network.lags + 10)
    # (inputs + 1)^2 numbers, however many machines there are
    held = np.zeros((network.size + 1, network.size + 1))
    for row in sums.collect():
        held[row["i"], row["j"]] = row["s"]
    return solve_readout(held, network) if held[0, 0] else None


def fit_recurrent(
    series: DataFrame, network: Network = Network(), key: str = "machine_id", order: str = "step", y: str = "y"  # noqa: B008
) -> DataFrame:
    """One row per machine: (machine, strategy, readout, state, recent, low, span).

    ``state`` and ``recent`` are where the series has brought the network.
    Series shorter than the lags and 10 do not train and repeat their last
    value, as all do where none is long enough; null values are left out.
    """
    weights = readout(series, network, key, order, y)
    inner, into, shift = network.weights()

    def bring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for places, levels, lengths in matrices(batch["values"]):
                x, low, span = scaled(levels, lengths)
                state = np.zeros((len(x), network.units))
                for t in range(x.shape[1]):
                    after = np.tanh(state @ inner.T + x[:, t : t + 1] * into + shift)
                    state = np.where((t < lengths)[:, None], after, state)
                long = (lengths >= network.lags + 10) & (weights is not None)
                yield pd.DataFrame(
                    {
                        key: batch[key].to_numpy()[places],
                        "strategy": "recurrent",
                        "readout": [None if not k else weights.tolist() for k in long],
                        "state": state.tolist(),
                        "recent": [x[i, max(n - network.lags, 0) : n][::-1].tolist() for i, n in enumerate(lengths)],
                        "low": low,
                        "span": span,
                    }
                )

    arrays = machine_arrays(series, key, order, y)
    schema = "strategy string, readout array<double>, state array<double>, recent array<double>, low double, span double"
    return arrays.mapInPandas(bring, f"{key} {dict(arrays.dtypes)[key]}, {schema}")


def predict_recurrent(models: DataFrame, steps: int, network: Network = Network(), key: str = "machine_id") -> DataFrame:  # noqa: B008
    """(machine, strategy, h, y_pred) for h = 1..steps; forecasts go back into the network, unclipped.

    Forecasts of fitted machines are limited to [0, 1].
    """
    inner, into, shift = network.weights()

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fitted = batch["readout"].notna().to_numpy()
            out = np.empty((len(batch), steps))
            newest = batch["recent"].map(lambda v: v[0]).to_numpy(dtype=float)
            span, low = batch["span"].to_numpy(), batch["low"].to_numpy()
            out[:] = (low + span * newest)[:, None]
            if fitted.any():
                part = batch[fitted]
                weights, state, recent = (np.stack(part[c].to_numpy()).astype(float) for c in ("readout", "state", "recent"))
                for h in range(steps):
                    inputs = np.concatenate([np.ones((len(part), 1)), recent, state], axis=1)
                    following = (inputs * weights).sum(axis=1)
                    out[fitted, h] = np.clip(low[fitted] + span[fitted] * following, 0.0, 1.0)
                    recent = np.concatenate([following[:, None], recent[:, :-1]], axis=1)
                    state = np.tanh(state @ inner.T + following[:, None] * into + shift)
            yield pd.DataFrame(
                {
                    key: np.repeat(batch[key].to_numpy(), steps),
                    "strategy": np.repeat(batch["strategy"].to_numpy(), steps),
                    "h": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(batch)),
                    "y_pred": out.ravel(),
                }
            )

    kind = dict(models.dtypes)[key]
    return models.mapInPandas(ahead, f"{key} {kind}, strategy string, h int, y_pred double")


# --- noise -----------------------------------------------------------------------------------------

HALF = 13  # hexadecimal digits of one uniform number: 52 bits


def normal(parts: list[Column]) -> Column:
    """A standard normal number out of what names it: the same wherever and whenever it is made.

    The MD5 of the parts gives two uniform numbers, and these one normal one.
    """
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    one, two = (F.conv(F.substring(digest, 1 + k * HALF, HALF), 16, 10).cast("double") for k in (0, 1))
    unit = float(16**HALF)
    return F.sqrt(-2 * F.log((one + 1) / unit)) * F.cos(2 * np.pi * (two / unit))


def fit_weighted_noisy(
    series: DataFrame,
    steps: int,
    share: float = 0.1,
    seed: int = 42,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
    **options,
) -> DataFrame:
    """``fit_weighted`` with noise for the next ``steps`` values, as models for ``arma.predict_arma``.

    Noise is normal with ``share`` of the series' own spread (population
    standard deviation); it goes into the values that later ones are made of.
    It depends on machine, step and ``seed`` only.  Series shorter than the
    lookback have none.
    """
    models = fit_weighted(series, key=key, order=order, y=y, **options)
    spread = series.groupBy(key).agg(F.stddev_pop(y).alias("_spread"))
    scale = F.when(F.size("weights") > 1, share * F.coalesce("_spread", F.lit(0.0))).otherwise(0.0)
    noise = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: scale * normal([F.lit(seed), F.col(key), h]))
    return models.join(spread, key).withColumn("shocks", noise).drop("_spread")

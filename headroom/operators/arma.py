"""Autoregressive models with moving-average terms, plain and seasonal.

A model of (p, d, q) and, over a season s, (P, D, Q) says that the
differenced series, filtered by both autoregressive lag polynomials, is white
noise filtered by both moving-average ones.  Lag polynomials are multiplied,
so the seasonal and the plain terms interact.

Orders are searched by two regressions in sums of products per machine.  Fits
then work on whole series, bounded by the length of the trace: a batch of
machines is one matrix, every recursion steps through time once for all of
them, and Gauss-Newton steps are solved for all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.operators.forecast import difference_weights, lag_moments, solve_normal
from headroom.params import Forecasting
from headroom.session import stage

BATCH_CELLS = 1 << 21  # machines times steps worked on at a time
ITERATIONS = 12
HALVINGS = 5
STATIONARY = 0.98  # largest root a start may have


@dataclass(frozen=True)
class Orders:
    """(p, d, q) and the seasonal (P, D, Q); a season is differenced once at most."""

    p: int = Forecasting.order[0]
    d: int = Forecasting.order[1]
    q: int = 0
    seasonal_p: int = 0
    seasonal_d: int = 0
    seasonal_q: int = 0
    season: int = Forecasting.season

    def __post_init__(self):
        if max(self.seasonal_p, self.seasonal_d, self.seasonal_q) > 1 or min(self.p, self.d, self.q) < 0:
            raise ValueError("seasonal orders are 0 or 1, others 0 or more")
        if not self.size:
            raise ValueError("a model needs one term at least")

    @property
    def size(self) -> int:
        return self.p + self.seasonal_p + self.q + self.seasonal_q

    @property
    def reach(self) -> int:
        """The longest autoregressive lag."""
        return self.p + self.season * self.seasonal_p

    @property
    def shocks(self) -> int:
        """The longest moving-average lag."""
        return self.q + self.season * self.seasonal_q

    def split(self, params: np.ndarray) -> list[np.ndarray]:
        """phi, seasonal phi, theta, seasonal theta out of (machines, size)."""
        return np.split(params, np.cumsum([self.p, self.seasonal_p, self.q]), axis=1)

    def differences(self) -> np.ndarray:
        return difference_weights(self.d, self.season if self.seasonal_d else None)


SEASONAL = Orders(p=Forecasting.order[0], d=1, q=0, seasonal_p=1, seasonal_d=1, seasonal_q=1)


# --- order search --------------------------------------------------------------------------


def order_search(
    series: DataFrame,
    max_p: int = 5,
    max_d: int = 2,
    max_q: int = 5,
    long_lags: int | None = None,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """(machine, p, d, q, aic) with the lowest AIC over all orders but (0, d, 0).

    Two least-squares stages per degree of differencing.  A long
    autoregression over ``long_lags`` lags (max_p + max_q) gives residuals;
    these are a second series, and the value is regressed on its own lags and
    the residuals'.  One matrix of sums serves every (p, q) of a degree, over
    the rows that have all lags.  (1, 1, 0) where nothing can be fitted.
    """
    long_lags = max(long_lags or max_p + max_q, max_p, 1)
    names = [f"x{i}" for i in range(1, max_p + 1)] + [f"e{i}" for i in range(1, max_q + 1)]
    grid = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1) if p + q]

    @F.pandas_udf("array<double>")
    def long_weights(gram: pd.Series, xty: pd.Series) -> pd.Series:
        g = np.stack(gram.to_numpy()).astype(float).reshape(-1, long_lags, long_lags)
        return pd.Series(list(solve_normal(g, np.stack(xty.to_numpy()).astype(float))))

    @F.pandas_udf("array<double>")
    def criteria(gram: pd.Series, xty: pd.Series, yty: pd.Series, m: pd.Series) -> pd.Series:
        g = np.stack(gram.to_numpy()).astype(float).reshape(-1, len(names), len(names))
        b = np.stack(xty.to_numpy()).astype(float)
        total, count = yty.to_numpy(dtype=float), m.to_numpy(dtype=float)
        out = np.full((len(g), len(grid)), np.nan)
        for k, (p, q) in enumerate(grid):
            at = [*range(p), *range(max_p, max_p + q)]
            own, part = g[:, at][:, :, at], b[:, at]
            found = solve_normal(own, part)
            left = total - 2 * (found * part).sum(1) + np.einsum("ni,nij,nj->n", found, own, found)
            left = np.maximum(left, 1e-12 * np.maximum(total, 1e-300))
            usable = (count > p + q + 1) & (total > 0)
            safe = np.where(usable, count, 1.0)
            out[:, k] = np.where(usable, safe * np.log(left / safe) + 2 * (p + q + 1), np.nan)
        return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in out])

    tables = []
    for d in range(max_d + 1):
        long_fit = lag_moments(series, range(1, long_lags + 1), d, None, key, order, y)
        long_fit = long_fit.select(key, long_weights("gram", "xty").alias("_long"))
        sums = _residual_moments(series, long_fit, names, long_lags, d, key, order, y)
        found = sums.select(key, F.posexplode(criteria("gram", "xty", "yty", "m")).alias("at", "aic"))
        tables.append(found.withColumn("d", F.lit(d)))
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    p, q = (F.element_at(F.array(*[F.lit(g[k]) for g in grid]), F.col("at") + 1) for k in (0, 1))
    best = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", p.alias("p"), "d", q.alias("q"))))
    return every.groupBy(key).agg(best.alias("b")).select(
        key,
        *[F.coalesce(F.col(f"b.{c}"), F.lit(n)).alias(c) for c, n in (("p", 1), ("d", 1), ("q", 0))],
        F.col("b.aic").alias("aic"),
    )


def _residual_moments(
    series: DataFrame, long_fit: DataFrame, names: Sequence[str], long_lags: int, d: int, key: str, order: str, y: str
) -> DataFrame:
    """Sums of products of the differenced value, its lags x1, x2, ... and the long fit's residuals' e1, e2, ..."""
    machine = Window.partitionBy(key).orderBy(F.desc(order))  # in which an earlier value is a lead
    value = F.lit(0.0)
    for i, w in enumerate(difference_weights(d, None)):
        value = value + float(w) * F.lead(y, i).over(machine)
    rows = series.select(key, order, value.alias("w"))
    rows = rows.withColumns({f"x{i}": F.lead("w", i).over(machine) for i in range(1, long_lags + 1)}).join(long_fit, key)
    fitted = F.lit(0.0)
    for i in range(1, long_lags + 1):
        fitted = fitted + F.col("_long")[i - 1] * F.col(f"x{i}")
    rows = rows.withColumn("e", F.col("w") - fitted)
    lags = [int(n[1:]) for n in names if n[0] == "e"]
    rows = rows.withColumns({f"e{i}": F.lead("e", i).over(machine) for i in lags})
    whole = F.col(f"e{max(lags)}" if lags else "e").isNotNull()

    def total(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.when(whole, F.col(a) * F.col(b))), F.lit(0.0))

    gram = {(a, b): total(a, b) for i, a in enumerate(names) for b in names[i:]}
    return rows.groupBy(key).agg(
        F.count_if(whole).alias("m"),
        F.array(*[gram.get((a, b), gram.get((b, a))) for a in names for b in names]).alias("gram"),
        F.array(*[total(a, "w") for a in names]).alias("xty"),
        total("w", "w").alias("yty"),
    )


# --- recursions over many machines ---------------------------------------------------------------


def lag_polynomials(first: np.ndarray, seasonal: np.ndarray, season: int, sign: float) -> np.ndarray:
    """(machines, lags): the product of 1 + sign * sum first_k B^k and 1 + sign * seasonal B^season."""
    n, p = first.shape
    out = np.zeros((n, p + season * seasonal.shape[1] + 1))
    out[:, 0], out[:, 1 : p + 1] = 1.0, sign * first
    if seasonal.shape[1]:
        out[:, season:] += sign * seasonal * np.concatenate([np.ones((n, 1)), sign * first], axis=1)
    return out


def filtered(x: np.ndarray, polynomial: np.ndarray) -> np.ndarray:
    """The lag polynomial applied to every row of ``x``; nothing comes before the first column."""
    out = polynomial[:, :1] * x
    for k in np.flatnonzero(polynomial.any(axis=0))[1:]:
        out[:, k:] += polynomial[:, k : k + 1] * x[:, :-k]
    return out


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:, k:] = x[:, : x.shape[1] - k]
    return out


def unfiltered(x: np.ndarray, polynomial: np.ndarray) -> np.ndarray:
    """What ``polynomial`` filters to ``x``.  Steps shorter than the shortest lag go together."""
    lags = np.flatnonzero(polynomial.any(axis=0))[1:]
    if not len(lags):
        return x
    out = x.copy()
    for at in range(0, x.shape[1], block := int(lags[0])):
        end = min(at + block, x.shape[1])
        for k in lags:
            first = max(at - k, 0)
            if end - k > first:
                out[:, first + k : end] -= polynomial[:, k : k + 1] * out[:, first : end - k]
    return out


def residuals(w: np.ndarray, inside: np.ndarray, params: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, their slopes in every parameter); zero before the longest lag and outside the series."""
    phi, seasonal_phi, theta, seasonal_theta = orders.split(params)
    own, seasonal = lag_polynomials(phi, seasonal_phi[:, :0], 0, -1.0), _one_lag(seasonal_phi, orders.season, -1.0)
    below = lag_polynomials(theta, seasonal_theta, orders.season, 1.0)
    own_below, seasonal_below = lag_polynomials(theta, seasonal_theta[:, :0], 0, 1.0), _one_lag(seasonal_theta, orders.season, 1.0)

    def shock(x: np.ndarray) -> np.ndarray:
        return unfiltered(np.where(inside, x, 0.0), below)

    e = shock(filtered(filtered(w, own), seasonal))
    slopes = [shock(-lagged(filtered(w, seasonal), k)) for k in range(1, orders.p + 1)]
    slopes += [shock(-lagged(filtered(w, own), orders.season))] * orders.seasonal_p
    slopes += [unfiltered(-lagged(filtered(e, seasonal_below), k), below) for k in range(1, orders.q + 1)]
    slopes += [unfiltered(-lagged(filtered(e, own_below), orders.season), below)] * orders.seasonal_q
    return np.where(inside, e, 0.0), np.where(inside[..., None], np.stack(slopes, axis=-1), 0.0)


def _one_lag(weight: np.ndarray, season: int, sign: float) -> np.ndarray:
    return lag_polynomials(weight[:, :0], weight, season, sign)


def gauss_newton_sums(e: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of squares, slopes' products with the residuals, slopes' products) per machine."""
    return (e * e).sum(axis=1), np.einsum("ntk,nt->nk", slopes, e), np.einsum("ntk,ntl->nkl", slopes, slopes)


def improve(params: np.ndarray, step: np.ndarray, cost: np.ndarray, cost_of) -> tuple[np.ndarray, np.ndarray]:
    """Take the step, or the largest half, quarter, ... of it that lowers a machine's cost."""
    open_ = np.ones(len(params), dtype=bool)
    for halving in range(HALVINGS):
        tried = params + 0.5**halving * step
        with np.errstate(all="ignore"):
            found = cost_of(tried)
        better = open_ & np.isfinite(found) & (found < cost)
        params, cost = np.where(better[:, None], tried, params), np.where(better, found, cost)
        open_ &= ~better
    return params, cost


def start_values(w: np.ndarray, inside: np.ndarray, orders: Orders) -> np.ndarray:
    """Two least-squares stages, as in the order search, without the products of seasonal and plain terms."""
    long_lags = max(orders.reach, orders.shocks, 1) if orders.shocks else 0
    own = [*range(1, orders.p + 1), *[orders.season] * orders.seasonal_p]
    shocks = [*range(1, orders.q + 1), *[orders.season] * orders.seasonal_q]
    e = np.zeros_like(w)
    if long_lags:
        whole = inside.copy()
        whole[:, :long_lags] = False
        xs = [lagged(w, k) for k in range(1, long_lags + 1)]
        e = np.where(whole, w - sum(x * b for x, b in zip(xs, _regressed(w, xs, whole), strict=True)), 0.0)
    whole = inside.copy()
    whole[:, : long_lags + max(shocks, default=0)] = False
    params = np.concatenate(_regressed(w, [*[lagged(w, k) for k in own], *[lagged(e, k) for k in shocks]], whole), axis=1)
    phi, seasonal_phi, theta, seasonal_theta = orders.split(params)
    parts = [damped(phi), np.clip(seasonal_phi, -STATIONARY, STATIONARY)]
    return np.concatenate([*parts, damped(theta), np.clip(seasonal_theta, -STATIONARY, STATIONARY)], axis=1)


def _regressed(y: np.ndarray, xs: list[np.ndarray], whole: np.ndarray) -> list[np.ndarray]:
    """A column (machines, 1) of weights per x."""
    x = np.where(whole[..., None], np.stack(xs, axis=-1), 0.0)
    found = solve_normal(np.einsum("ntk,ntl->nkl", x, x), np.einsum("ntk,nt->nk", x, np.where(whole, y, 0.0)))
    return [found[:, k : k + 1] for k in range(found.shape[1])]


def largest_root(phi: np.ndarray) -> np.ndarray:
    """Size of the largest root of x^p - phi_1 x^(p-1) - ... of every row."""
    n, p = phi.shape
    if not p:
        return np.zeros(n)
    companion = np.zeros((n, p, p))
    companion[:, 0], companion[:, np.arange(1, p), np.arange(p - 1)] = phi, 1.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1)


def damped(phi: np.ndarray) -> np.ndarray:
    """Weights with all roots drawn in to ``STATIONARY`` at most."""
    if not phi.shape[1]:
        return phi
    shrink = np.minimum(1.0, STATIONARY / np.maximum(largest_root(phi), 1e-9))
    return phi * shrink[:, None] ** np.arange(1, phi.shape[1] + 1)


# --- exact likelihood ------------------------------------------------------------------------------


def innovations(w: np.ndarray, inside: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(innovation, its variance in units of the noise's) of every step, by a state-space filter.

    The state has max(p, q + 1) numbers and a covariance per machine, which
    starts at the stationary one; not a number where there is none.
    """
    n, steps = w.shape
    p, q = phi.shape[1], theta.shape[1]
    size = max(p, q + 1)
    move = np.zeros((n, size, size))
    move[:, :p, 0] = phi
    move[:, np.arange(size - 1), np.arange(1, size)] = 1.0
    load = np.zeros((n, size))
    load[:, 0], load[:, 1 : q + 1] = 1.0, theta
    noise = load[:, :, None] * load[:, None, :]
    pairs = np.einsum("nij,nkl->nikjl", move, move).reshape(n, size * size, size * size)
    stationary = largest_root(phi) < 1
    system = np.where(stationary[:, None, None], np.eye(size * size) - pairs, np.eye(size * size))
    spread = np.linalg.solve(system, noise.reshape(n, -1, 1)).reshape(n, size, size)
    spread[~stationary] = np.nan
    state = np.zeros((n, size))
    error, variance = np.zeros((n, steps)), np.ones((n, steps))
    for t in range(steps):
        here = inside[:, t]
        error[:, t] = np.where(here, w[:, t] - state[:, 0], 0.0)
        variance[:, t] = np.where(here, spread[:, 0, 0], 1.0)
        moved = move @ spread
        gain = moved[:, :, 0] / spread[:, :1, 0]
        state = (move @ state[..., None])[..., 0] + gain * error[:, t : t + 1]
        spread = moved @ move.transpose(0, 2, 1) + noise - gain[:, :, None] * gain[:, None, :] * spread[:, :1, :1]
    return error, variance


def log_likelihood(error: np.ndarray, variance: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood, noise variance) with the noise variance at its best."""
    safe = np.maximum(count, 1)
    noise = (error**2 / variance).sum(axis=1) / safe
    with np.errstate(all="ignore"):
        return -0.5 * (count * (np.log(2 * np.pi * noise) + 1) + np.log(variance).sum(axis=1)), noise


def _scaled(w: np.ndarray, inside: np.ndarray, params: np.ndarray, orders: Orders) -> np.ndarray:
    """Innovations scaled so that their sum of squares is lowest where the likelihood is highest."""
    phi, _, theta, _ = orders.split(params)
    error, variance = innovations(w, inside, phi, theta)
    mean_log = np.log(variance).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
    return error / np.sqrt(variance) * np.exp(mean_log / 2)[:, None]


def most_likely(w: np.ndarray, inside: np.ndarray, params: np.ndarray, orders: Orders, iterations: int = ITERATIONS) -> np.ndarray:
    """Gauss-Newton on the scaled innovations, slopes by differences."""
    cost = (_scaled(w, inside, params, orders) ** 2).sum(axis=1)
    for _ in range(iterations):
        base = _scaled(w, inside, params, orders)
        slopes = np.empty((*base.shape, orders.size))
        for k in range(orders.size):
            near = params.copy()
            near[:, k] += 1e-6 * np.where(near[:, k] > 0, -1.0, 1.0)  # inwards, so that it stays stationary
            slopes[..., k] = (_scaled(w, inside, near, orders) - base) / (near - params)[:, k : k + 1]
        _, slope, gram = gauss_newton_sums(base, np.nan_to_num(slopes))
        params, after = improve(params, -solve_normal(gram, slope), cost, lambda p: (_scaled(w, inside, p, orders) ** 2).sum(axis=1))
        if np.allclose(after, cost, rtol=1e-10, atol=0.0):
            break
        cost = after
    return params


# --- fitting -------------------------------------------------------------------------------------


def machine_arrays(series: DataFrame, key: str = "machine_id", order: str = "step", y: str = "y") -> DataFrame:
    """(machine, values): every series in order, without its nulls; as long as the trace at most."""
    rows = series.filter(F.col(y).isNotNull())
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(y).cast("double").alias("v"))))
    return rows.groupBy(key).agg(F.transform(pairs, lambda e: e["v"]).alias("values"))


def matrices(values: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, padded series, lengths) of machines of similar length, a bounded number of cells at a time."""
    lengths = values.map(len).to_numpy()
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= BATCH_CELLS:
            end += 1
        places = order[at:end]
        y = np.zeros((len(places), lengths[places].max()))
        for row, k in enumerate(places):
            y[row, : lengths[k]] = values.iloc[k]
        yield places, y, lengths[places]
        at = end


def differenced(y: np.ndarray, lengths: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray]:
    """(differenced series, which of its steps are there)."""
    weights = orders.differences()
    lost = len(weights) - 1
    steps = max(y.shape[1] - lost, 0)
    w = sum(c * y[:, lost - i : lost - i + steps] for i, c in enumerate(weights)) + np.zeros((len(y), steps))
    inside = np.arange(steps) < (lengths - lost)[:, None]
    return np.where(inside, w, 0.0), inside


def _conditional(inside: np.ndarray, orders: Orders) -> np.ndarray:
    """Steps whose autoregressive lags are all there."""
    out = inside.copy()
    out[:, : orders.reach] = False
    return out


def fitted_params(w: np.ndarray, inside: np.ndarray, orders: Orders, exact: bool, iterations: int = ITERATIONS) -> np.ndarray:
    counted = _conditional(inside, orders)

    def cost_of(params: np.ndarray) -> np.ndarray:
        return gauss_newton_sums(*residuals(w, counted, params, orders))[0]

    params = start_values(w, counted, orders)
    cost = cost_of(params)
    for _ in range(iterations):
        _, slope, gram = gauss_newton_sums(*residuals(w, counted, params, orders))
        params, after = improve(params, -solve_normal(gram, slope), cost, cost_of)
        if np.allclose(after, cost, rtol=1e-10, atol=0.0):
            break
        cost = after
    if exact:
        phi, _, theta, _ = orders.split(params)
        params = most_likely(w, inside, np.concatenate([damped(phi), damped(theta)], axis=1), orders, iterations)
    return params


def _forecast_terms(
    y: np.ndarray, lengths: np.ndarray, w: np.ndarray, inside: np.ndarray, params: np.ndarray, orders: Orders, exact: bool
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(weights on past levels, last levels, what past shocks still add to the next values)."""
    phi, seasonal_phi, theta, seasonal_theta = orders.split(params)
    own = lag_polynomials(phi, seasonal_phi, orders.season, -1.0)
    difference = orders.differences()
    levels = np.zeros((len(params), own.shape[1] + len(difference) - 1))
    for i, c in enumerate(difference):
        levels[:, i : i + own.shape[1]] += c * own
    if exact:
        error, variance = innovations(w, inside, phi, theta)
        e = np.where(variance > 0, error, 0.0)
    else:
        e, _ = residuals(w, _conditional(inside, orders), params, orders)
    below = lag_polynomials(theta, seasonal_theta, orders.season, 1.0)
    reach = orders.shocks
    ends = inside.sum(axis=1)
    last = np.zeros((len(e), reach))  # newest first
    for k in range(reach):
        there = ends - 1 - k >= 0
        last[there, k] = e[there, (ends - 1 - k)[there]]
    shocks = np.zeros((len(e), reach))
    for h in range(1, reach + 1):
        shocks[:, h - 1] = (below[:, h:] * last[:, : reach + 1 - h]).sum(axis=1)
    size = levels.shape[1] - 1
    tails = [row[max(n - size, 0) : n] for row, n in zip(y, lengths, strict=True)]
    return -levels[:, :0:-1], tails, shocks


MODEL = (
    "strategy string, params array<double>, noise double, log_likelihood double, aic double, "
    "weights array<double>, tail array<double>, shocks array<double>, clip_end boolean"
)


def fit_arma(
    series: DataFrame,
    orders: Orders = Orders(),  # noqa: B008
    strategy: str | None = None,
    exact: bool = False,
    min_points: int = Forecasting.min_points,
    iterations: int = ITERATIONS,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """One row per machine: (machine, strategy, params, noise, log_likelihood, aic, weights, tail, shocks, clip_end).

    ``params`` are phi, seasonal phi, theta, seasonal theta.  The sum of
    squared residuals is made least, given the first values, by Gauss-Newton
    steps from a two-stage regression; ``exact`` goes on to the maximum of the
    exact Gaussian likelihood, for models without seasonal terms, whose AIC is
    given then.  Both count the noise variance as a parameter.  Series shorter
    than ``min_points``, or than the lags need, repeat their last value,
    unclipped.
    """
    if exact and (orders.seasonal_p or orders.seasonal_q):
        raise ValueError("the exact likelihood takes plain orders only")
    needed = max(min_points, len(orders.differences()) - 1 + 2 * (orders.reach + orders.shocks) + orders.size + 2)
    name = strategy or ("seasonal_arima" if orders.seasonal_d or orders.seasonal_p or orders.seasonal_q else "arima")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for places, levels, lengths in matrices(batch["values"]):
                rows = [(name, None, None, None, None, [1.0], [float(levels[i, n - 1])], [], False) for i, n in enumerate(lengths)]
                long = np.flatnonzero(lengths >= needed)
                if len(long):
                    for i, row in zip(long, _fitted_rows(levels[long], lengths[long], orders, name, exact, iterations), strict=True):
                        rows[i] = row
                found = pd.DataFrame(rows, columns=[c.split()[0] for c in MODEL.split(", ")])
                found.insert(0, key, batch[key].to_numpy()[places])
                yield found

    arrays = machine_arrays(series, key, order, y)
    return arrays.mapInPandas(fit, f"{key} {dict(arrays.dtypes)[key]}, {MODEL}")


def _fitted_rows(y: np.ndarray, lengths: np.ndarray, orders: Orders, name: str, exact: bool, iterations: int) -> list[tuple]:
    w, inside = differenced(y, lengths, orders)
    params = fitted_params(w, inside, orders, exact, iterations)
    if exact:
        phi, _, theta, _ = orders.split(params)
        likelihood, noise = log_likelihood(*innovations(w, inside, phi, theta), inside.sum(axis=1))
    else:
        counted = _conditional(inside, orders)
        count = counted.sum(axis=1)
        noise = gauss_newton_sums(*residuals(w, counted, params, orders))[0] / np.maximum(count, 1)
        with np.errstate(divide="ignore"):
            likelihood = -0.5 * count * (np.log(2 * np.pi * noise) + 1)
    weights, tails, shocks = _forecast_terms(y, lengths, w, inside, params, orders, exact)
    return [
        (
            name, params[i].tolist(), float(noise[i]),
            *([float(likelihood[i]), float(2 * (orders.size + 1) - 2 * likelihood[i])] if np.isfinite(likelihood[i]) else [None, None]),
            weights[i].tolist(), tails[i].tolist(), shocks[i].tolist(), True,
        )
        for i in range(len(y))
    ]


def fit_seasonal_ma(series: DataFrame, **options) -> DataFrame:
    """(5, 1, 0) with the seasonal (1, 1, 1) over a season of 12."""
    return fit_arma(series, SEASONAL, **options)


def predict_arma(models: DataFrame, steps: int, key: str = "machine_id") -> DataFrame:
    """(machine, strategy, h, y_pred) for h = 1..steps: past levels by their weights, plus the shocks given.

    Models with ``clip_each`` are limited to [0, 1] at every step, before the
    value goes into later ones.
    """
    kinds = dict(models.dtypes)
    each = F.col("clip_each") if "clip_each" in models.columns else F.lit(False)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = max(batch["weights"].map(len), default=1)
            weights, held = np.zeros((len(batch), size)), np.zeros((len(batch), size + steps))
            added = np.zeros((len(batch), steps))
            for i, (w, t, s) in enumerate(zip(batch["weights"], batch["tail"], batch["shocks"], strict=True)):
                weights[i, size - len(w) :], held[i, size - len(t) : size] = w, t
                added[i, : len(s)] = s[:steps]
            each_step = batch["_each"].to_numpy(dtype=bool)
            for h in range(steps):
                following = (weights * held[:, h : size + h]).sum(axis=1) + added[:, h]
                held[:, size + h] = np.where(each_step, np.clip(following, 0.0, 1.0), following)
            ahead = held[:, size:]
            ahead = np.where(batch["clip_end"].to_numpy(dtype=bool)[:, None], np.clip(ahead, 0.0, 1.0), ahead)
            yield pd.DataFrame(
                {
                    key: np.repeat(batch[key].to_numpy(), steps),
                    "strategy": np.repeat(batch["strategy"].to_numpy(), steps),
                    "h": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(batch)),
                    "y_pred": ahead.ravel(),
                }
            )

    used = models.select(key, "strategy", "weights", "tail", "shocks", "clip_end", each.alias("_each"))
    return used.mapInPandas(walk, f"{key} {kinds[key]}, strategy string, h int, y_pred double")


# --- parts of a fit, for checks --------------------------------------------------------------------


def gauss_newton_step(
    series: DataFrame, params: Sequence[float], orders: Orders = SEASONAL, key: str = "machine_id", order: str = "step", y: str = "y"
) -> DataFrame:
    """(machine, n, sum_squares, slope, params): one full Gauss-Newton step from the given parameters.

    Machines too short for one residual per parameter are left out.
    """
    start = np.array(params, dtype=float)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for places, levels, lengths in matrices(batch["values"]):
                w, inside = differenced(levels, lengths, orders)
                counted = _conditional(inside, orders)
                there = np.flatnonzero(counted.sum(axis=1) > orders.size)
                if not len(there):
                    continue
                now = np.tile(start, (len(there), 1))
                squares, slope, gram = gauss_newton_sums(*residuals(w[there], counted[there], now, orders))
                yield pd.DataFrame(
                    {
                        key: batch[key].to_numpy()[places[there]],
                        "n": counted[there].sum(axis=1).astype(np.int64),
                        "sum_squares": squares,
                        "slope": list(slope),
                        "params": list(now - solve_normal(gram, slope)),
                    }
                )

    arrays = machine_arrays(series, key, order, y)
    kind = dict(arrays.dtypes)[key]
    return arrays.mapInPandas(step, f"{key} {kind}, n long, sum_squares double, slope array<double>, params array<double>")


def exact_likelihood(
    series: DataFrame, models: DataFrame, orders: Orders = Orders(p=1, d=1), key: str = "machine_id", order: str = "step", y: str = "y"  # noqa: B008
) -> DataFrame:
    """(machine, log_likelihood, noise, aic) of given models (machine, params) over the series.

    Null where the autoregression is not stationary.
    """
    arrays = machine_arrays(series, key, order, y).join(models.select(key, "params"), key)

    def filter_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for places, levels, lengths in matrices(batch["values"]):
                w, inside = differenced(levels, lengths, orders)
                params = np.stack(batch["params"].iloc[places].to_numpy()).astype(float)
                phi, _, theta, _ = orders.split(params)
                found, noise = log_likelihood(*innovations(w, inside, phi, theta), inside.sum(axis=1))
                there = np.isfinite(found)
                yield pd.DataFrame(
                    {
                        key: batch[key].to_numpy()[places],
                        "log_likelihood": pd.Series(found).where(there, None),
                        "noise": pd.Series(noise).where(there, None),
                        "aic": pd.Series(2 * (orders.size + 1) - 2 * found).where(there, None),
                    }
                )

    kind = dict(arrays.dtypes)[key]
    return arrays.mapInPandas(filter_all, f"{key} {kind}, log_likelihood double, noise double, aic double")


def compared_orders(series: DataFrame, orders: Sequence[Orders], exact: bool = True, key: str = "machine_id", order: str = "step", y: str = "y") -> DataFrame:
    """(machine, at, aic): which of ``orders`` has the lowest AIC, from one written table of series."""
    arrays = stage(series.select(key, order, y), "compared-series")
    every = None
    for at, own in enumerate(orders):
        fitted = fit_arma(arrays, own, exact=exact, key=key, order=order, y=y).select(key, F.lit(at).alias("at"), "aic")
        every = fitted if every is None else every.unionByName(fitted)
    best = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", "at"))).alias("b")
    return every.groupBy(key).agg(best).select(key, "b.at", "b.aic")

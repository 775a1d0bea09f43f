"""Forecasts per machine.

Every method here predicts the next value as a constant plus a weighted sum
of the last values, so a fitted model is one row: intercept, weights and the
last values themselves, oldest first.  Fitting aggregates sums per machine;
only small normal equations are solved in Python, a batch at a time.  Scoring
is one expression over the model table.

The autoregressive methods are least-squares relatives of the maximum
likelihood estimators of statistics packages: no intercept, no moving-average
terms; their numbers differ from those estimators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.operators.windows import lag_sequences
from headroom.params import Forecasting
from headroom.session import stage

SCORED_MACHINES = 2_000  # scored side by side
SCORED_STEPS = 256  # before rows leave a task
MODEL_COLUMNS = ("machine_id", "strategy", "intercept", "weights", "tail", "clip_each", "clip_end")


def _model(
    df: DataFrame,
    strategy: str,
    weights: Column,
    tail: Column,
    intercept: Column | None = None,
    clip_each: bool = False,
    clip_end: Column | bool = False,
    key: str = "machine_id",
) -> DataFrame:
    end = F.lit(clip_end) if isinstance(clip_end, bool) else clip_end
    return df.select(
        key,
        F.lit(strategy).alias("strategy"),
        (F.lit(0.0) if intercept is None else intercept).cast("double").alias("intercept"),
        weights.cast("array<double>").alias("weights"),
        tail.cast("array<double>").alias("tail"),
        F.lit(clip_each).alias("clip_each"),
        end.alias("clip_end"),
    )


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _newest_first(key: str, order: str):
    return Window.partitionBy(key).orderBy(F.desc(order))


def _tail(length: int, order: str, y: str = "y", back: str = "_back") -> Column:
    """Aggregate: the last ``length`` values, oldest first; 0 before the start of the series.

    ``back`` counts the rows of a machine from its newest; only the newest are collected.
    """
    value = F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("v")
    newest = F.collect_list(F.when(F.col(back) <= length, F.struct(F.col(order).alias("o"), value)))
    values = F.transform(F.sort_array(newest), lambda e: e["v"])
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(length) - F.size(values)), values)


def _one() -> Column:
    return _numbers([1.0])


# --- scoring -------------------------------------------------------------------------


def predict(models: DataFrame, steps: int | str, key: str = "machine_id", carry: Sequence[str] = ()) -> DataFrame:
    """(machine, strategy, h, y_pred[, carried columns]) for h = 1..steps; ``steps`` may name a column.

    A batch of machines is one matrix of last values; every step is one numpy
    operation over all of them, so the work is linear in the horizon.
    """
    horizon = F.lit(steps) if isinstance(steps, int) else F.col(steps)
    names = [key, "strategy", *carry]
    kinds = dict(models.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "h int", "y_pred double"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SCORED_MACHINES):
                part = batch.iloc[at : at + SCORED_MACHINES]
                last = part["_horizon"].to_numpy()
                for first, ahead in _ahead(part, int(last.max())):
                    wanted = first + np.arange(ahead.shape[1]) < last[:, None]
                    machine, step = np.nonzero(wanted)
                    found = part[names].iloc[machine].reset_index(drop=True)
                    yield found.assign(h=(first + step + 1).astype(np.int32), y_pred=ahead[machine, step])

    used = [*names, "intercept", "weights", "tail", "clip_each", "clip_end", horizon.cast("int").alias("_horizon")]
    return models.filter(horizon >= 1).select(*used).mapInPandas(walk, schema)


def _ahead(models: pd.DataFrame, steps: int) -> Iterator[tuple[int, np.ndarray]]:
    """(steps before, machines x steps) in slices of the horizon; the last values are a ring."""
    size = max(models["weights"].map(len))
    weights, recent = (np.zeros((len(models), size)) for _ in range(2))
    for i, (w, t) in enumerate(zip(models["weights"], models["tail"], strict=True)):
        weights[i, size - len(w) :], recent[i, size - len(w) :] = w, np.asarray(t, dtype=float)[len(t) - len(w) :]
    # weights twice over, so that a ring read from any position is one slice of them
    weights = np.concatenate([weights, weights], axis=1)
    intercept = models["intercept"].to_numpy(dtype=float)
    each, end = models["clip_each"].to_numpy(dtype=bool), models["clip_end"].to_numpy(dtype=bool)
    for first in range(0, steps, SCORED_STEPS):
        out = np.empty((len(models), min(SCORED_STEPS, steps - first)))
        for k in range(out.shape[1]):
            oldest = (first + k) % size
            following = intercept + np.einsum("ij,ij->i", weights[:, size - oldest : 2 * size - oldest], recent)
            following = np.where(each, np.clip(following, 0.0, 1.0), following)
            recent[:, oldest] = following
            out[:, k] = following
        yield first, np.where(end[:, None], np.clip(out, 0.0, 1.0), out)


def predict_test(models: DataFrame, test: DataFrame, key: str = "machine_id", carry: Sequence[str] = ()) -> DataFrame:
    """Forecasts as far as each machine's test part (machine, h) goes."""
    horizon = test.groupBy(key).agg(F.max("h").alias("n_test"))
    return predict(models.join(horizon, key), "n_test", key, carry)


def predict_machines(
    machines: DataFrame, models: DataFrame, steps: int, key: str = "machine_id"
) -> DataFrame:
    """Forecast for every listed machine; 0.5 for those without a model."""
    known = predict(models, steps, key).select(key, "h", "y_pred")
    wanted = machines.select(key).distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return wanted.join(known, [key, "h"], "left").withColumn(
        "y_pred", F.coalesce("y_pred", F.lit(Forecasting.unknown_machine))
    )


def continue_from(
    models: DataFrame,
    recent: DataFrame,
    strategies: Sequence[str] = ("lstm", "weighted"),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Stored models of the given strategies, set to go on from newer values.

    Weights and scales stay as fitted.  A machine whose newer values are fewer
    than its weights, or that has none, keeps the values it was fitted with.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    # as many of a machine's newest values as its model has weights
    needed = models.groupBy(key).agg(F.max(F.size("weights")).alias("_needed"))
    last = recent.withColumn("_back", back).join(needed, key).filter(F.col("_back") <= F.col("_needed"))
    newest = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(y).alias("v")))), lambda e: e["v"])
    joined = models.join(last.groupBy(key).agg(newest.alias("_newest")), key, "left")
    size = F.size("weights")
    usable = F.col("strategy").isin(*strategies) & (F.coalesce(F.size("_newest"), F.lit(-1)) >= size)
    tail = F.when(usable, F.slice("_newest", F.size("_newest") - size + 1, size)).otherwise(F.col("tail"))
    return joined.withColumn("tail", tail).select(models.columns)


# --- fitting --------------------------------------------------------------------------


def fit_naive(series: DataFrame, key: str = "machine_id", order: str = "step", y: str = "y") -> DataFrame:
    """Repeat the last value."""
    last = series.groupBy(key).agg(F.max_by(y, order).alias("last"))
    return _model(last, "naive", _one(), F.array("last"), key=key)


def fit_conservative(
    series: DataFrame,
    percentile: float = Forecasting.percentile,
    key: str = "machine_id",
    y: str = "y",
) -> DataFrame:
    """A flat upper percentile of the machine's series."""
    level = series.groupBy(key).agg(F.percentile(y, F.lit(percentile)).alias("level"))
    return _model(level, "conservative", _one(), F.array("level"), key=key)


def decay_weights(lookback: int, alpha: float, heaviest: str) -> list[float]:
    """Geometric weights that add up to 1, for values listed oldest first."""
    # fixed numeric definition: alpha * (1 - alpha)^i, divided by their sum
    weights = [alpha * (1 - alpha) ** i for i in range(lookback)]
    weights = [w / sum(weights) for w in weights]
    return weights if heaviest == "oldest" else weights[::-1]


def fit_weighted(
    series: DataFrame,
    lookback: int = Forecasting.lookback,
    alpha: float = Forecasting.alpha,
    heaviest: str = "oldest",
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Weighted mean of the last values with geometric weights, limited to [0, 1].

    The largest weight falls on the oldest value unless ``heaviest`` is
    ``newest``.  Shorter series repeat their last value.
    """
    rows = series.select(key, order, y, F.row_number().over(_newest_first(key, order)).alias("_back"))
    state = rows.groupBy(key).agg(
        _tail(lookback, order, y).alias("t"), F.max_by(y, order).alias("last"), F.count(F.lit(1)).alias("n")
    )
    enough = F.col("n") >= lookback
    weights = F.when(enough, _numbers(decay_weights(lookback, alpha, heaviest))).otherwise(_one())
    tail = F.when(enough, F.col("t")).otherwise(F.array("last"))
    return _model(state, "weighted", weights, tail, clip_each=True, key=key)


def difference_weights(d: int, season: int | None) -> np.ndarray:
    """Weights of y[t], y[t-1], ... in the d-times (and seasonally) differenced value."""
    out = np.array([1.0])
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    if season:
        out = np.convolve(out, np.r_[1.0, np.zeros(season - 1), -1.0])
    return out


def lag_moments(
    series: DataFrame,
    lags: Sequence[int],
    d: int,
    season: int | None = None,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Per machine: sums of products of the differenced value and its lags.

    Columns: n (length), m (complete rows), gram, xty, yty, last, tail.  One
    shuffle by machine serves the lags and the sums.
    """
    machine = _newest_first(key, order)  # in which an earlier value is a lead
    weights = difference_weights(d, season)
    length = max(lags) + len(weights) - 1
    value = F.lit(0.0)
    for i, w in enumerate(weights):
        if w:
            value = value + float(w) * F.lead(y, i).over(machine)
    back, reaches = F.row_number().over(machine), F.lead(F.lit(True), length).over(machine)
    rows = series.select(key, order, y, back.alias("_back"), reaches.alias("_whole"), value.alias("w"))
    rows = rows.withColumns({f"x{i}": F.lead("w", i).over(machine) for i in lags})
    # complete once the longest lag reaches past the differencing
    whole = F.col("_whole").isNotNull()

    def total(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.when(whole, F.col(a) * F.col(b))), F.lit(0.0))

    xs = [f"x{i}" for i in lags]
    gram = {(a, b): total(a, b) for i, a in enumerate(xs) for b in xs[i:]}
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(whole).alias("m"),
        F.array(*[gram.get((a, b), gram.get((b, a))) for a in xs for b in xs]).alias("gram"),
        F.array(*[total(a, "w") for a in xs]).alias("xty"),
        total("w", "w").alias("yty"),
        F.max_by(y, order).alias("last"),
        _tail(length, order, y).alias("tail"),
    )


def solve_normal(gram: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """Least-norm solutions of a batch of normal equations."""
    return (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ xty[..., None])[..., 0]


def level_weights(phi: np.ndarray, lags: Sequence[int], d: int, season: int | None) -> np.ndarray:
    """Weights on past levels, oldest first, for AR weights on differences."""
    difference = difference_weights(d, season)
    longest = max(lags)
    ar = np.zeros((len(phi), longest + 1))
    ar[:, 0] = 1.0
    ar[:, list(lags)] -= phi
    out = np.zeros((len(phi), longest + len(difference)))
    for i, w in enumerate(difference):
        out[:, i : i + longest + 1] += w * ar
    return -out[:, :0:-1]


def fit_ar(
    series: DataFrame,
    lags: Sequence[int] = tuple(range(1, Forecasting.order[0] + 1)),
    d: int = Forecasting.order[1],
    season: int | None = None,
    strategy: str = "arima",
    min_points: int = Forecasting.min_points,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Autoregression on differences by least squares, clipped to [0, 1].

    Series shorter than ``min_points`` repeat their last value, unclipped.
    """
    lags = list(lags)
    moments = lag_moments(series, lags, d, season, key, order, y)

    @F.pandas_udf("array<double>")
    def weights(gram: pd.Series, xty: pd.Series) -> pd.Series:
        p = len(lags)
        g = np.stack(gram.to_numpy()).astype(float).reshape(-1, p, p)
        phi = solve_normal(g, np.stack(xty.to_numpy()).astype(float))
        return pd.Series(list(level_weights(phi, lags, d, season)))

    solved = moments.withColumn("w", weights("gram", "xty"))
    enough = F.col("n") >= min_points
    return _model(
        solved,
        strategy,
        F.when(enough, F.col("w")).otherwise(_one()),
        F.when(enough, F.col("tail")).otherwise(F.array("last")),
        clip_end=enough,
        key=key,
    )


def fit_seasonal_ar(series: DataFrame, season: int = Forecasting.season, **options) -> DataFrame:
    """As ``fit_ar`` after a seasonal difference, with the season as a further lag."""
    p = Forecasting.order[0]
    lags = sorted({*range(1, p + 1), season})
    return fit_ar(series, lags, 1, season, "seasonal_arima", **options)


def fit_ar1(
    series: DataFrame,
    min_points: int = Forecasting.min_points,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """One lag of the first difference; its weight is a ratio of two sums."""
    moments = lag_moments(series, [1], 1, None, key, order, y)
    phi = F.coalesce(F.try_divide(F.col("xty")[0], F.col("gram")[0]), F.lit(0.0))
    enough = F.col("n") >= min_points
    return _model(
        moments,
        "ar1",
        F.when(enough, F.array(-phi, 1 + phi)).otherwise(_one()),
        F.when(enough, F.col("tail")).otherwise(F.array("last")),
        clip_end=enough,
        key=key,
    )


def ar_order_search(
    series: DataFrame,
    max_p: int = 5,
    max_d: int = 2,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """(machine, p, d, aic) with the lowest AIC, without moving-average terms.

    For one d all p share the rows that have ``max_p`` lags, and one matrix of
    sums.  (1, 1) where nothing can be fitted.
    """
    lags = list(range(1, max_p + 1))

    @F.pandas_udf("array<double>")
    def criteria(gram: pd.Series, xty: pd.Series, yty: pd.Series, m: pd.Series) -> pd.Series:
        g = np.stack(gram.to_numpy()).astype(float).reshape(-1, max_p, max_p)
        b = np.stack(xty.to_numpy()).astype(float)
        total, count = yty.to_numpy(dtype=float), m.to_numpy(dtype=float)
        out = np.full((len(g), max_p), np.nan)
        for p in lags:
            part = b[:, :p]
            phi = solve_normal(g[:, :p, :p], part)
            fitted = 2 * (phi * part).sum(1) - np.einsum("ni,nij,nj->n", phi, g[:, :p, :p], phi)
            left = np.maximum(total - fitted, 1e-12 * np.maximum(total, 1e-300))
            usable = (count > p + 1) & (total > 0)
            safe = np.where(usable, count, 1.0)
            out[:, p - 1] = np.where(usable, safe * np.log(left / safe) + 2 * (p + 1), np.nan)
        return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in out])

    tables = []
    for d in range(max_d + 1):
        found = lag_moments(series, lags, d, None, key, order, y)
        tables.append(
            found.select(key, F.lit(d).alias("d"), F.posexplode(criteria("gram", "xty", "yty", "m")).alias("at", "aic"))
        )
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    best = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", (F.col("at") + 1).alias("p"), "d")))
    return (
        every.groupBy(key)
        .agg(best.alias("b"))
        .select(
            key,
            F.coalesce("b.p", F.lit(1)).alias("p"),
            F.coalesce("b.d", F.lit(1)).alias("d"),
            F.col("b.aic").alias("aic"),
        )
    )


def fit_pooled(
    series: DataFrame,
    lookback: int = Forecasting.lookback,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """One regression on the last values, trained over all machines together.

    Each series is scaled to [0, 1] by its own range first.  Takes the place of
    a recurrent network per machine.  Series shorter than lookback + 10 repeat
    their last value and do not train.
    """
    machine = Window.partitionBy(key)
    rows = series.select(
        key,
        order,
        y,
        F.min(y).over(machine).alias("low"),
        F.max(y).over(machine).alias("high"),
        F.count(F.lit(1)).over(machine).alias("n"),
    )
    span = F.col("high") - F.col("low")
    scaled = rows.filter(F.col("n") >= lookback + 10).withColumn(
        "scaled", F.when(span > 0, (F.col(y) - F.col("low")) / F.nullif(span, F.lit(0.0))).otherwise(0.0)
    )
    table = lag_sequences(scaled, lookback, key, order, "scaled")
    table = stage(table.select(array_to_vector("x").alias("features"), F.col("target").alias("label")), "pooled")
    if table.isEmpty():
        return fit_naive(series, key, order, y).withColumn("strategy", F.lit("lstm"))
    model = LinearRegression(solver="normal").fit(table)
    c = [float(v) for v in model.coefficients]
    state = (
        rows.withColumn("_back", F.row_number().over(_newest_first(key, order)))
        .groupBy(key)
        .agg(
            _tail(lookback, order, y).alias("t"),
            F.max_by(y, order).alias("last"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
            F.first("n").alias("n"),
        )
    )
    enough = F.col("n") >= lookback + 10
    base = F.col("low") * (1 - sum(c)) + span * float(model.intercept)
    return _model(
        state,
        "lstm",
        F.when(enough, _numbers(c)).otherwise(_one()),
        F.when(enough, F.col("t")).otherwise(F.array("last")),
        F.when(enough, base).otherwise(0.0),
        clip_end=enough,
        key=key,
    )


# --- routing --------------------------------------------------------------------------


def fit_hybrid(
    series: DataFrame,
    strategies: DataFrame,
    pooled: bool = True,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
    arima: DataFrame | None = None,
) -> DataFrame:
    """Fit each machine with the method of its strategy (machine, strategy).

    Machines without a strategy count as periodic.  ``pooled=False`` takes the
    weighted mean instead of the pooled regression for bursty machines.
    ``arima``: models of ``fit_ar`` for these machines, where they are at hand.
    """
    routed = series.select(key, order, y).join(strategies.select(key, "strategy"), key, "left")
    routed = routed.withColumn("strategy", F.coalesce("strategy", F.lit("seasonal_arima")))
    routed = stage(routed, "routed-series", ("strategy",))

    def part(name: str) -> DataFrame:
        return routed.filter(F.col("strategy") == name).drop("strategy")

    names = {"key": key, "order": order, "y": y}
    bursty = fit_pooled(part("lstm"), **names) if pooled else fit_weighted(part("lstm"), **names)
    if arima is None:
        stable = fit_ar(part("arima"), **names)
    else:
        stable = arima.join(strategies.filter("strategy = 'arima'").select(key), key, "left_semi")
    return (
        stable.unionByName(fit_seasonal_ar(part("seasonal_arima"), **names))
        .unionByName(bursty.withColumn("strategy", F.lit("lstm")))
        .unionByName(fit_conservative(part("conservative"), key=key, y=y))
    )


def evaluate_forecasts(predicted: DataFrame, actual: DataFrame, metrics, by: Sequence[str] = (), key: str = "machine_id") -> DataFrame:
    """Error metrics over the steps that have both a forecast and an actual value."""
    both = actual.select(key, "h", F.col("y").alias("actual")).join(
        predicted.select(key, "h", F.col("y_pred").alias("predicted")), [key, "h"]
    )
    return both.groupBy(*by).agg(*metrics)

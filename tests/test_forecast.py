import numpy as np
import pandas as pd
import pytest
from test_windows import series

from headroom.functions import metrics as M
from headroom.operators import forecast as fc


def forecasts(df):
    out = {}
    for r in df.orderBy("machine_id", "h").collect():
        out.setdefault(r["machine_id"], []).append(r["y_pred"])
    return out


def walk(n, seed):
    rng = np.random.default_rng(seed)
    y = 0.5 + 0.2 * np.sin(np.arange(n) / 3) + rng.normal(0, 0.05, n)
    return np.clip(y, 0.01, 0.99)


def plain_ar(y, steps, lags, season=None):
    """Least squares on the differenced series, integrated back step by step."""
    w = np.diff(y)
    if season:
        w = w[season:] - w[:-season]
    top = max(lags)
    x = np.array([[w[t - i] for i in lags] for t in range(top, len(w))])
    phi = np.linalg.lstsq(x, w[top:], rcond=None)[0]
    levels, w = list(y), list(w)
    for _ in range(steps):
        following = sum(p * w[-i] for p, i in zip(phi, lags))
        w.append(following)
        if season:
            levels.append(following + levels[-1] + levels[-season] - levels[-season - 1])
        else:
            levels.append(levels[-1] + following)
    return np.clip(levels[len(y) :], 0, 1)


@pytest.mark.parametrize("season", [None, 12])
def test_ar_against_least_squares(spark, season):
    values = {"a": walk(60, 1), "b": walk(90, 2), "c": walk(200, 3)}
    fit = fc.fit_seasonal_ar if season else fc.fit_ar
    lags = [1, 2, 3, 4, 5, 12] if season else [1, 2, 3, 4, 5]
    got = forecasts(fc.predict(fit(series(spark, values)), 8))
    for m, y in values.items():
        assert got[m] == pytest.approx(plain_ar(y, 8, lags, season), abs=1e-8)


def test_ar1_is_ar_with_one_lag(spark):
    df = series(spark, {"a": walk(40, 4), "b": [0.5] * 30})
    one = forecasts(fc.predict(fc.fit_ar1(df), 5))
    general = forecasts(fc.predict(fc.fit_ar(df, [1]), 5))
    assert {m: pytest.approx(v, abs=1e-10) for m, v in one.items()} == general
    assert one["b"] == pytest.approx([0.5] * 5)


@pytest.mark.parametrize("n, naive", [(1, True), (11, True), (19, True), (20, False), (22, False)])
def test_short_series_repeat_the_last_value(spark, n, naive):
    y = walk(n, 5)
    y[-1] = 1.4
    for fit in (fc.fit_ar, fc.fit_seasonal_ar, fc.fit_ar1):
        got = forecasts(fc.predict(fit(series(spark, {"a": y})), 3))["a"]
        assert (got == [1.4] * 3) == naive
        assert naive or max(got) <= 1.0


def plain_weighted(y, steps, newest=False):
    w = np.array([0.3 * 0.7**i for i in range(12)])
    w = w / w.sum()
    w = w[::-1] if newest else w
    values = list(y)
    for _ in range(steps):
        values.append(min(1.0, max(0.0, float(np.dot(values[-12:], w)))))
    return values[len(y) :]


def test_weighted(spark):
    values = {"a": walk(12, 6), "b": walk(50, 7), "short": walk(11, 8)}
    df = series(spark, values)
    got = forecasts(fc.predict(fc.fit_weighted(df), 20))
    assert got["a"] == pytest.approx(plain_weighted(values["a"], 20))
    assert got["b"] == pytest.approx(plain_weighted(values["b"], 20))
    assert got["short"] == pytest.approx([values["short"][-1]] * 20)
    newest = forecasts(fc.predict(fc.fit_weighted(df, heaviest="newest"), 3))
    assert newest["b"] == pytest.approx(plain_weighted(values["b"], 3, True))


def test_conservative_and_default(spark):
    values = {"a": walk(30, 9)}
    df = series(spark, values)
    models = fc.fit_conservative(df)
    assert forecasts(fc.predict(models, 2))["a"] == pytest.approx([np.percentile(values["a"], 75)] * 2)
    wanted = spark.createDataFrame([("a",), ("new",)], "machine_id string")
    assert forecasts(fc.predict_machines(wanted, models, 2))["new"] == [0.5, 0.5]


def test_order_search(spark):
    values = {"a": walk(80, 10), "b": np.cumsum(walk(80, 11)) / 100, "tiny": walk(4, 12)}
    got = {r["machine_id"]: r for r in fc.ar_order_search(series(spark, values)).collect()}
    for m in ("a", "b"):
        best = None
        for d in range(3):
            w = np.diff(values[m], d) if d else values[m]
            y = w[5:]
            for p in range(1, 6):
                x = np.array([[w[t - i] for i in range(1, p + 1)] for t in range(5, len(w))])
                rss = float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
                aic = len(y) * np.log(rss / len(y)) + 2 * (p + 1)
                best = min(best or (aic, p, d), (aic, p, d))
        assert got[m]["aic"] == pytest.approx(best[0], abs=1e-5)
        assert (got[m]["p"], got[m]["d"]) == best[1:]
    assert (got["tiny"]["p"], got["tiny"]["d"]) == (1, 1)


def test_pooled(spark):
    values = {"a": walk(60, 13), "b": walk(80, 14), "short": walk(21, 15), "flat": [0.4] * 40}
    got = forecasts(fc.predict(fc.fit_pooled(series(spark, values)), 4))
    xs, ys = [], []
    for m in ("a", "b", "flat"):
        y = np.array(values[m])
        span = y.max() - y.min()
        s = (y - y.min()) / span if span else y * 0
        xs += [np.r_[s[t - 12 : t], 1] for t in range(12, len(s))]
        ys += list(s[12:])
    c = np.linalg.lstsq(np.array(xs), np.array(ys), rcond=None)[0]
    y = values["a"]
    s = list((y - y.min()) / (y.max() - y.min()))
    for _ in range(4):
        s.append(float(np.dot(s[-12:], c[:12]) + c[12]))
    wanted = np.clip(np.array(s[60:]) * (y.max() - y.min()) + y.min(), 0, 1)
    assert got["a"] == pytest.approx(wanted, abs=1e-8)
    assert got["short"] == pytest.approx([values["short"][-1]] * 4)
    assert got["flat"] == pytest.approx([0.4] * 4)


def test_pooled_without_long_series(spark):
    got = fc.predict(fc.fit_pooled(series(spark, {"a": walk(15, 1)})), 2)
    assert got.count() == 2


def test_router(spark):
    values = {m: walk(50, i) for i, m in enumerate("abcde")}
    df = series(spark, values)
    kinds = spark.createDataFrame(
        [("a", "arima"), ("b", "seasonal_arima"), ("c", "lstm"), ("d", "conservative")], "machine_id string, strategy string"
    )
    models = fc.fit_hybrid(df, kinds)
    assert {r["machine_id"]: r["strategy"] for r in models.collect()} == {
        "a": "arima",
        "b": "seasonal_arima",
        "c": "lstm",
        "d": "conservative",
        "e": "seasonal_arima",
    }
    got = forecasts(fc.predict(models, 3))
    assert got["a"] == pytest.approx(plain_ar(values["a"], 3, [1, 2, 3, 4, 5]), abs=1e-8)
    assert got["d"] == pytest.approx([np.percentile(values["d"], 75)] * 3)
    simple = forecasts(fc.predict(fc.fit_hybrid(df, kinds, pooled=False), 3))
    assert simple["c"] == pytest.approx(plain_weighted(values["c"], 3))


def test_models_survive_storage(spark, tmp_path):
    from headroom.sources.sinks import load_models, save_models

    models = fc.fit_ar(series(spark, {"a": walk(40, 3)}))
    save_models(models, str(tmp_path / "models"))
    again = load_models(spark, str(tmp_path / "models"))
    assert forecasts(fc.predict(again, 5)) == forecasts(fc.predict(models, 5))


def test_going_on_from_newer_values(spark):
    values = {"a": walk(60, 1), "b": walk(60, 2), "c": walk(60, 3)}
    start = {m: y[:30] for m, y in values.items()}
    newer = {"a": values["a"], "b": values["b"][:5]}
    models = fc.fit_weighted(series(spark, start))
    got = forecasts(fc.predict(fc.continue_from(models, series(spark, newer)), 3))
    assert got["a"] == pytest.approx(plain_weighted(values["a"], 3))
    for m in "bc":
        assert got[m] == pytest.approx(plain_weighted(start[m], 3))
    kept = fc.continue_from(fc.fit_ar(series(spark, start)), series(spark, newer))
    assert forecasts(fc.predict(kept, 3)) == forecasts(fc.predict(fc.fit_ar(series(spark, start)), 3))


def test_horizon_column(spark):
    models = fc.fit_naive(series(spark, {"a": [0.1, 0.2], "b": [0.3]}))
    wanted = spark.createDataFrame([("a", 2), ("b", 0)], "machine_id string, n int")
    assert forecasts(fc.predict(models.join(wanted, "machine_id"), "n")) == {"a": [0.2, 0.2]}


def test_evaluation_joins_what_both_have(spark):
    predicted = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.1)], "machine_id string, h int, y_pred double")
    actual = spark.createDataFrame([("a", 1, 0.4), ("c", 1, 0.4)], "machine_id string, h int, y double")
    row = fc.evaluate_forecasts(predicted, actual, [M.mae("actual", "predicted").alias("mae")]).first()
    assert row["mae"] == pytest.approx(0.1)


def test_continue_from_long_models(spark):
    # more weights than any fixed number of values would cover
    old = [(f"m{k}", i, 0.1) for k in range(2) for i in range(80)]
    newer = [(f"m{k}", i, 0.4) for k in range(2) for i in range(80, 160)]
    schema = "machine_id string, step long, y double"
    models = fc.fit_weighted(spark.createDataFrame(old, schema), lookback=65)
    moved = fc.continue_from(models, spark.createDataFrame(newer, schema))
    assert {round(r["y_pred"], 9) for r in fc.predict(moved, 3).collect()} == {0.4}


def test_decay_weights_add_up():
    weights = fc.decay_weights(12, 0.3, "oldest")
    assert sum(weights) == pytest.approx(1.0) and weights[1] / weights[0] == pytest.approx(0.7)
    assert fc.decay_weights(12, 0.3, "newest") == weights[::-1]


def test_predict_equals_a_plain_walk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, wanted = [], {}
    for k in range(9):
        size, steps = int(rng.integers(1, 6)), int(rng.integers(0, 40))
        w, t = rng.normal(0, 0.4, size).tolist(), rng.random(size + 2).tolist()
        each, end = bool(rng.integers(2)), bool(rng.integers(2))
        rows.append((f"m{k}", "s", 0.1 * k, w, t, each, end, steps, "x"))
        values = list(t)
        for h in range(1, steps + 1):
            y = 0.1 * k + sum(a * b for a, b in zip(w, values[-size:]))
            values.append(min(1.0, max(0.0, y)) if each else y)
            wanted[f"m{k}", h] = min(1.0, max(0.0, values[-1])) if end else values[-1]
    schema = (
        "machine_id string, strategy string, intercept double, weights array<double>, tail array<double>, "
        "clip_each boolean, clip_end boolean, n int, method string"
    )
    models = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(fc, "SCORED_STEPS", 7)
    monkeypatch.setattr(fc, "SCORED_MACHINES", 4)
    got = fc.predict(models, "n", carry=["method"]).collect()
    assert {(r["machine_id"], r["h"]) for r in got} == set(wanted) and {r["method"] for r in got} == {"x"}
    for r in got:
        assert r["y_pred"] == pytest.approx(wanted[r["machine_id"], r["h"]])


def test_scoring_is_linear_in_the_horizon():
    import time

    models = pd.DataFrame(
        {
            "weights": [[0.1] * 12] * 64,
            "tail": [[0.5] * 12] * 64,
            "intercept": 0.1,
            "clip_each": False,
            "clip_end": True,
        }
    )

    def seconds(steps):
        best = float("inf")
        for _ in range(3):
            begin = time.perf_counter()
            assert sum(a.shape[1] for _, a in fc._ahead(models, steps)) == steps
            best = min(best, time.perf_counter() - begin)
        return best

    assert seconds(8_000) < 6 * seconds(2_000)

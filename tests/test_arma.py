"""Models with moving-average terms against plain recursions and densities."""

import itertools

import numpy as np
import pytest

from headroom.operators import arma
from headroom.operators.arma import Orders


def simulated(rng, n, orders, params):
    """Values of a model, one step at a time."""
    phi, seasonal_phi, theta, seasonal_theta = (p[0] for p in orders.split(np.array([params])))
    own, below = {0: 1.0}, {0: 1.0}
    for out, first, seasonal, sign in ((own, phi, seasonal_phi, -1), (below, theta, seasonal_theta, 1)):
        out |= {k: sign * c for k, c in enumerate(first, 1)}
        for c in seasonal:
            for k, f in list(out.items()):
                out[k + orders.season] = out.get(k + orders.season, 0.0) + sign * c * f
    e, x = rng.normal(size=n + 300), np.zeros(n + 300)
    for t in range(n + 300):
        x[t] = sum(c * e[t - k] for k, c in below.items() if t >= k) - sum(c * x[t - k] for k, c in own.items() if k and t >= k)
    return x[300:]


CASES = [(Orders(2, 0, 1), [0.5, -0.3, 0.6]), (Orders(0, 0, 2), [0.4, 0.3]), (Orders(1, 0, 1, 1, 0, 1, 4), [0.5, 0.3, 0.5, 0.4])]


@pytest.mark.parametrize("orders, params", CASES)
def test_slopes_are_the_slopes(orders, params):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(3, 60))
    inside = np.arange(60) < np.array([60, 50, 31])[:, None]
    inside[:, : orders.reach] = False
    now = np.tile(params, (3, 1))
    e, slopes = arma.residuals(w, inside, now, orders)
    for k in range(orders.size):
        near = now.copy()
        near[:, k] += 1e-6
        assert np.allclose((arma.residuals(w, inside, near, orders)[0] - e) / 1e-6, slopes[..., k], atol=1e-4)


@pytest.mark.parametrize("orders, params", CASES)
def test_parameters_are_found_again(orders, params):
    rng = np.random.default_rng(2)
    y = np.stack([simulated(rng, 1500, orders, params) for _ in range(2)])
    w, inside = arma.differenced(y, np.array([1500, 1500]), orders)
    assert np.abs(arma.fitted_params(w, inside, orders, False) - params).max() < 0.2
    if not orders.seasonal_p:
        assert np.abs(arma.fitted_params(w, inside, orders, True) - params).max() < 0.2


def test_residuals_are_the_plain_recursion():
    orders, params = Orders(5, 1, 0, 1, 1, 1, 12), [0.3, 0.1, -0.1, 0.05, 0.02, 0.2, 0.4]
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=(1, 90)), axis=1)
    w, inside = arma.differenced(y, np.array([90]), orders)
    inside[:, : orders.reach] = False
    e, _ = arma.residuals(w, inside, np.array([params]), orders)
    d = [y[0, t] - y[0, t - 1] - y[0, t - 12] + y[0, t - 13] for t in range(13, 90)]
    plain = [0.0] * len(d)
    for t in range(17, len(d)):
        own = d[t] - sum(params[i] * d[t - i - 1] for i in range(5))
        before = d[t - 12] - sum(params[i] * d[t - 12 - i - 1] for i in range(5))
        plain[t] = own - params[5] * before - params[6] * plain[t - 12]
    assert np.allclose(e[0], plain)


@pytest.mark.parametrize("p, q", [(1, 0), (0, 1), (2, 1), (1, 2)])
def test_likelihood_is_the_density(p, q):
    rng = np.random.default_rng(10 * p + q)
    phi, theta = arma.damped(rng.uniform(-0.8, 0.8, (1, p))), rng.uniform(-0.5, 0.5, (1, q))
    w = rng.normal(size=(1, 12))
    error, variance = arma.innovations(w, np.ones((1, 12), dtype=bool), phi, theta)
    found, noise = arma.log_likelihood(error, variance, np.array([12]))
    # autocovariances by the weights on past shocks
    psi = arma.unfiltered(
        np.pad(np.concatenate([np.ones((1, 1)), theta], axis=1), ((0, 0), (0, 3000))), np.concatenate([np.ones((1, 1)), -phi], axis=1)
    )[0]
    cov = np.array([[psi[: len(psi) - abs(i - j)] @ psi[abs(i - j) :] for j in range(12)] for i in range(12)]) * noise[0]
    density = -0.5 * (12 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + w[0] @ np.linalg.solve(cov, w[0]))
    assert found[0] == pytest.approx(density, abs=1e-8)


def test_no_likelihood_without_stationarity():
    error, variance = arma.innovations(np.ones((2, 5)), np.ones((2, 5), dtype=bool), np.array([[1.2], [0.5]]), np.zeros((2, 0)))
    found, _ = arma.log_likelihood(error, variance, np.array([5, 5]))
    assert np.isnan(found[0]) and np.isfinite(found[1])


def test_exact_fits_are_at_the_top():
    orders = Orders(1, 0, 1)
    rng = np.random.default_rng(4)
    y = np.stack([simulated(rng, 60, orders, [0.6, 0.4]) for _ in range(5)])
    w, inside = arma.differenced(y, np.full(5, 60), orders)
    params = arma.fitted_params(w, inside, orders, True)

    def likelihood(p):
        return arma.log_likelihood(*arma.innovations(w, inside, p[:, :1], p[:, 1:]), np.full(5, 60))[0]

    best = likelihood(params)
    for a, b in itertools.product((-0.02, 0.0, 0.02), repeat=2):
        assert (likelihood(params + [a, b]) <= best + 1e-6).all()


def frame(spark, values):
    rows = [(m, t, None if v is None else float(v)) for m, vs in values.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "machine_id string, step long, y double")


def test_models_and_forecasts(spark):
    rng = np.random.default_rng(5)
    values = {f"m{k}": (0.5 + 0.02 * np.cumsum(rng.normal(size=60 + 7 * k))).tolist() for k in range(4)}
    values |= {"short": [0.2, 0.7, 0.4], "gaps": [None, *values["m0"], None], "flat": [0.3] * 80}
    orders = Orders(2, 1, 1)
    models = arma.fit_arma(frame(spark, values), orders).collect()
    by = {r["machine_id"]: r for r in models}
    assert set(by) == set(values) and by["gaps"]["params"] == by["m0"]["params"]
    assert (by["short"]["weights"], by["short"]["tail"], by["short"]["clip_end"]) == ([1.0], [0.4], False)
    ahead = {(r["machine_id"], r["h"]): r["y_pred"] for r in arma.predict_arma(spark.createDataFrame(models), 5).collect()}
    assert ahead["short", 5] == 0.4 and ahead["flat", 5] == pytest.approx(0.3)
    for name in ("m0", "m3"):
        y, (a, b, c) = values[name], by[name]["params"]
        w, e = list(np.diff(y)), []
        for t in range(len(w)):
            e.append(w[t] - a * w[t - 1] - b * w[t - 2] - c * e[t - 1] if t >= 2 else 0.0)
        level = y[-1]
        for h in range(1, 6):
            w.append(a * w[-1] + b * w[-2] + (c * e[-1] if h == 1 else 0.0))
            level += w[-1]
            assert ahead[name, h] == pytest.approx(min(1, max(0, level)), abs=1e-9)


def test_seasonal_fits_lower_the_squares(spark):
    rng = np.random.default_rng(6)
    values = {f"m{k}": simulated(rng, 200, Orders(1, 0, 0, 1, 0, 1), [0.4, 0.6, -0.5]).cumsum().tolist() for k in range(3)}
    fitted = arma.fit_seasonal_ma(frame(spark, values)).collect()
    for r in fitted:
        y = np.array([values[r["machine_id"]]])
        w, inside = arma.differenced(y, np.array([200]), arma.SEASONAL)
        inside[:, : arma.SEASONAL.reach] = False
        cost, slope, gram = arma.gauss_newton_sums(*arma.residuals(w, inside, np.array([r["params"]]), arma.SEASONAL))
        start = arma.start_values(w, inside, arma.SEASONAL)
        assert cost[0] <= arma.gauss_newton_sums(*arma.residuals(w, inside, start, arma.SEASONAL))[0][0]
        assert (slope @ np.linalg.solve(gram[0], slope[0]))[0] < 1e-4 * cost[0]  # nothing left to gain
        assert r["noise"] == pytest.approx(cost[0] / inside.sum())
    step = arma.gauss_newton_step(frame(spark, values), fitted[0]["params"]).collect()
    own = next(r for r in step if r["machine_id"] == fitted[0]["machine_id"])
    assert np.abs(np.array(own["params"]) - fitted[0]["params"]).max() < 0.05


def test_order_search_is_two_regressions(spark):
    rng = np.random.default_rng(7)
    values = {f"m{k}": simulated(rng, 120, Orders(1, 0, 1), [0.7, 0.5]).tolist() for k in range(3)} | {"tiny": [0.1, 0.2]}
    got = {r["machine_id"]: r for r in arma.order_search(frame(spark, values), 2, 1, 2, 4).collect()}
    assert (got["tiny"]["p"], got["tiny"]["d"], got["tiny"]["q"], got["tiny"]["aic"]) == (1, 1, 0, None)
    for name in ("m0", "m1", "m2"):
        found = []
        for d in (0, 1):
            w = np.diff(values[name], d)
            x = np.stack([w[4 - i : len(w) - i] for i in range(1, 5)], axis=1)
            e = np.concatenate([np.full(4, np.nan), w[4:] - x @ np.linalg.lstsq(x, w[4:], rcond=None)[0]])
            for p, q in itertools.product(range(3), range(3)):
                if p + q:
                    z = np.stack([*[w[6 - i : len(w) - i] for i in range(1, p + 1)], *[e[6 - i : len(w) - i] for i in range(1, q + 1)]], axis=1)
                    left = w[6:] - z @ np.linalg.lstsq(z, w[6:], rcond=None)[0]
                    found.append((len(left) * np.log(left @ left / len(left)) + 2 * (p + q + 1), p, d, q))
        aic, p, d, q = min(found)
        assert (got[name]["p"], got[name]["d"], got[name]["q"]) == (p, d, q) and got[name]["aic"] == pytest.approx(aic)


def test_best_of_several_orders(spark):
    rng = np.random.default_rng(8)
    values = {f"m{k}": simulated(rng, 300, Orders(2, 0, 0), [0.2, 0.6]).tolist() for k in range(3)}
    best = arma.compared_orders(frame(spark, values), [Orders(1, 0, 0), Orders(2, 0, 0), Orders(0, 0, 1)]).collect()
    assert {r["at"] for r in best} == {1}


def test_orders_are_checked():
    for bad in ({"p": 0}, {"seasonal_p": 2}, {"d": -1}):
        with pytest.raises(ValueError):
            Orders(**bad)
    with pytest.raises(ValueError, match="plain"):
        arma.fit_arma(None, arma.SEASONAL, exact=True)

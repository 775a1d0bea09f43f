"""The fixed recurrent network with a pooled readout, and reproducible noise."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.operators import arma, forecast, recurrent
from headroom.operators.recurrent import Network


def frame(spark, values, partitions=None):
    rows = [(m, t, None if v is None else float(v)) for m, vs in values.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "machine_id string, step long, y double")
    return df if partitions is None else df.repartition(partitions)


def chaotic(rng, n):
    """A series no linear forecaster can follow, in a range of its own."""
    x = [rng.uniform(0.1, 0.9)]
    for _ in range(n - 1):
        x.append(3.7 * x[-1] * (1 - x[-1]))
    low, span = rng.uniform(0, 0.3), rng.uniform(0.2, 0.6)
    return [low + span * v for v in x]


def test_beats_the_linear_forecaster_on_held_out_values(spark):
    rng = np.random.default_rng(1)
    whole = {f"m{k}": chaotic(rng, 203) for k in range(30)}
    train = frame(spark, {m: v[:200] for m, v in whole.items()})

    def error(predicted):
        rows = predicted.collect()
        assert len(rows) == 90
        return math.sqrt(np.mean([(r["y_pred"] - whole[r["machine_id"]][199 + r["h"]]) ** 2 for r in rows]))

    ours = error(recurrent.predict_recurrent(recurrent.fit_recurrent(train), 3))
    linear = error(forecast.predict(forecast.fit_pooled(train), 3))
    assert ours < 0.5 * linear


def test_the_same_whatever_the_partitions(spark):
    rng = np.random.default_rng(2)
    values = {f"m{k}": chaotic(rng, 40 + k) for k in range(12)}
    found = [
        {(r["machine_id"], r["h"]): r["y_pred"] for r in recurrent.predict_recurrent(recurrent.fit_recurrent(frame(spark, values, n)), 4).collect()}
        for n in (1, 7)
    ]
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], abs=1e-7) for k in found[0])


def test_short_flat_and_empty_series(spark):
    net = Network(units=3, lags=2)
    rng = np.random.default_rng(3)
    values = {"short": [0.2, 0.9], "flat": [0.4] * 30, "gaps": [None, 0.1, None, 0.6], "one": [0.7], "long": chaotic(rng, 50)}
    ahead = {(r["machine_id"], r["h"]): r["y_pred"] for r in recurrent.predict_recurrent(recurrent.fit_recurrent(frame(spark, values), net), 3, net).collect()}
    assert len(ahead) == 15
    assert ahead["short", 3] == pytest.approx(0.9) and ahead["gaps", 1] == pytest.approx(0.6) and ahead["one", 2] == pytest.approx(0.7)
    assert ahead["flat", 3] == pytest.approx(0.4)
    few = recurrent.predict_recurrent(recurrent.fit_recurrent(frame(spark, {"short": [0.2, 0.9]}), net), 2, net).collect()
    assert [r["y_pred"] for r in few] == pytest.approx([0.9, 0.9])
    assert recurrent.fit_recurrent(frame(spark, {}), net).count() == 0


def test_readout_is_the_ridge_solution(spark):
    rng = np.random.default_rng(4)
    net = Network(units=3, lags=2, ridge=0.01)
    values = {f"m{k}": rng.uniform(size=30 + 5 * k).tolist() for k in range(4)} | {"short": [0.1] * 5}
    inner, into, shift = net.weights()
    rows, targets = [], []
    for v in list(values.values())[:4]:
        x = (np.array(v) - min(v)) / (max(v) - min(v))
        state = np.zeros(3)
        for t in range(len(x) - 1):
            state = np.tanh(inner @ state + into * x[t] + shift)
            if t >= 1:
                rows.append([1, x[t], x[t - 1], *state])
                targets.append(x[t + 1])
    rows = np.array(rows)
    penalty = 0.01 * len(rows) * np.diag([0, 1, 1, 1, 1, 1])
    wanted = np.linalg.solve(rows.T @ rows + penalty, rows.T @ targets)
    assert recurrent.readout(frame(spark, values), net) == pytest.approx(wanted)


def test_noise_is_normal_and_named(spark):
    df = spark.range(20_000).select(recurrent.normal([F.lit(42), F.col("id"), F.lit(3)]).alias("z"), "id")
    z = np.array([r["z"] for r in df.orderBy("id").collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z < 1).mean() - 0.8413) < 0.01
    digest = hashlib.md5(b"42:7:3").hexdigest()
    one, two = int(digest[:13], 16), int(digest[13:26], 16)
    assert z[7] == pytest.approx(math.sqrt(-2 * math.log((one + 1) / 16**13)) * math.cos(2 * math.pi * two / 16**13))


def test_noise_goes_into_later_values(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.uniform(size=40).tolist(), "short": [0.3, 0.6]}
    models = recurrent.fit_weighted_noisy(frame(spark, values), 6, share=0.5, seed=9)
    shocks = {r["machine_id"]: r["shocks"] for r in models.collect()}
    ahead = {(r["machine_id"], r["h"]): r["y_pred"] for r in arma.predict_arma(models, 6).collect()}
    weights, recent = np.array(forecast.decay_weights(12, 0.3, "oldest")), values["a"][-12:]
    for h in range(6):
        following = min(1.0, max(0.0, float(weights @ recent) + shocks["a"][h]))
        assert ahead["a", h + 1] == pytest.approx(following)
        recent = [*recent[1:], following]
    assert shocks["short"] == [0.0] * 6 and ahead["short", 6] == 0.6
    plain = forecast.predict(forecast.fit_weighted(frame(spark, values)), 6).collect()
    assert any(abs(ahead[r["machine_id"], r["h"]] - r["y_pred"]) > 1e-3 for r in plain)
    again = {r["machine_id"]: r["shocks"] for r in recurrent.fit_weighted_noisy(frame(spark, values, 5), 6, share=0.5, seed=9).collect()}
    assert again["a"] == pytest.approx(shocks["a"])

"""Exact quantiles per key by histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.operators import keyed

WANTED = {"low": 0.0, "q1": 0.25, "half": 0.5, "q9": 0.9, "high": 1.0}


def check(got, values, wanted=WANTED):
    assert {r["k"] for r in got} == set(values)
    for r in got:
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values[r["k"]], p), rel=1e-12, abs=1e-12), (r["k"], name)


@pytest.mark.parametrize("rank_rows", [1, 7, 10_000])
def test_quantiles_of_every_key(spark, rank_rows):
    rng = np.random.default_rng(1)
    values = {
        "hot": np.concatenate([rng.lognormal(0, 3, 4000), np.full(2500, 2.5)]),
        "ties": np.repeat([1.0, 1.0, 3.0], 50),
        "one": np.array([-4.5]),
        "two": np.array([1.0, 2.0]),
        "wide": np.array([-1e12, -1.0, 0.0, 1e-9, 2e-9, 5.0, 1e12]),
        None: rng.normal(size=90),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    check(keyed.keyed_quantiles(df, ["k"], "v", WANTED, rank_rows=rank_rows).collect(), values)


def test_weights_count_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 0), ("a", 5.0, 2), ("a", 9.0, 1), ("b", 7.0, 4)], "k string, v double, w int")
    got = keyed.keyed_quantiles(df, ["k"], "v", WANTED, "w", rank_rows=1).collect()
    check(got, {"a": np.array([1, 1, 1, 5, 5, 9.0]), "b": np.full(4, 7.0)})


def test_brackets_are_bounded_whatever_a_key_holds(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 2, 30_000)] + [(f"k{i}", float(v)) for i in range(20) for v in rng.normal(size=50)]
    values = keyed.value_counts(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").cache()
    found = keyed.brackets(values, ["k"], [0.25, 0.5], rank_rows=100)
    inside = values.join(found, "k").filter(F.col("x").between(F.col("low"), F.col("high"))).groupBy("k", "target").count().collect()
    assert len(inside) == 42 and max(r["count"] for r in inside) <= 100
    # tasks see histograms, not values
    bins = keyed.narrowed(values, keyed.first_brackets(values, ["k"], [0.5]).filter("inside > 100"), ["k"])
    assert bins.count() == 1 and bins.first()["inside"] < 30_000


def test_no_rows(spark):
    assert keyed.keyed_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"q": 0.5}).count() == 0

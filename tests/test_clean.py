from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from headroom.operators import clean
from headroom.operators.ordered import order_chunks, range_slices
from headroom.operators.quantiles import exact_quantiles

START = datetime(2024, 1, 1)


def random_trace(seed, rows=400, machines=5):
    rng = np.random.default_rng(seed)
    # one machine and one hour hold most rows; many equal times
    machine = rng.choice(machines, rows, p=[0.6] + [0.4 / (machines - 1)] * (machines - 1))
    hours = np.where(rng.random(rows) < 0.5, 30, rng.integers(0, 24 * 6, rows))
    pdf = pd.DataFrame({"machine_id": [f"m{i}" for i in machine], "id": rng.permutation(rows)})
    pdf["time"] = [START + timedelta(hours=int(h)) for h in hours]
    for c in ("average_usage", "a", "b"):
        pdf[c] = rng.random(rows).round(3)
    pdf.loc[rng.random(rows) < 0.5, "a"] = np.nan
    pdf.loc[rng.random(rows) < 0.95, "b"] = np.nan
    pdf.loc[pdf.machine_id == "m1", "b"] = np.nan
    return pdf


def frame(spark, pdf):
    def plain(v):
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime()
        return None if isinstance(v, float) and np.isnan(v) else v

    rows = [tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(
        rows, "machine_id string, id long, time timestamp_ntz, average_usage double, a double, b double"
    )


@pytest.mark.parametrize("limit", [3, 40, 5_000_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_fill_equals_fill_in_order(spark, seed, limit):
    pdf = random_trace(seed)
    got = clean.fill_missing(frame(spark, pdf), ties=["id"], limit=limit)
    ordered = pdf.sort_values(["machine_id", "time", "id"])
    for c in ("a", "b"):
        ordered[c] = ordered.groupby("machine_id")[c].transform(lambda x: x.ffill().bfill()).fillna(0)
    wanted = {r.id: (r.a, r.b) for r in ordered.itertuples()}
    assert {r["id"]: (r["a"], r["b"]) for r in got.collect()} == wanted


def test_large_machines_are_filled_in_chunks_beside_the_rest(spark, monkeypatch):
    df = frame(spark, random_trace(4))
    whole = sorted(map(tuple, clean.fill_missing(df, ties=["id"]).collect()))
    monkeypatch.setattr(clean, "WHOLE_ROWS", 60)
    assert sorted(map(tuple, clean.fill_missing(df, ties=["id"]).collect())) == whole


def test_small_machines_are_filled_in_one_shuffle(spark, capsys):
    clean.fill_missing(frame(spark, random_trace(5)), ties=["id"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_fill_of_nothing(spark):
    assert clean.fill_missing(frame(spark, random_trace(5)).limit(0), ties=["id"]).count() == 0


def test_fill_drops_rows_without_critical_values(spark):
    df = spark.createDataFrame(
        [("a", START, 1.0, None), (None, START, 1.0, 2.0), ("a", None, 1.0, 2.0), ("a", START, None, 2.0)],
        "machine_id string, time timestamp_ntz, average_usage double, x double",
    )
    assert [tuple(r) for r in clean.fill_missing(df).collect()] == [("a", START, 1.0, 0.0)]


def test_hot_buckets_are_cut_in_order(spark):
    df = frame(spark, random_trace(3))
    chunks = order_chunks(df, "machine_id", "time", ["id"], limit=20).toPandas()
    assert len(chunks) == 400
    sizes = chunks.groupby(["machine_id", "_bucket", "_slice"]).size()
    assert sizes.max() < chunks.groupby(["machine_id", "_bucket"]).size().max()
    ordered = chunks.sort_values(["machine_id", "time", "id"])
    for _, rows in ordered.groupby("machine_id"):
        keys = list(zip(rows["_bucket"], rows["_slice"]))
        assert keys == sorted(keys)


def test_range_slices_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v")
    rows = sorted((r["_slice"], r["v"]) for r in range_slices(df, ["v"], n=5).collect())
    assert [v for _, v in rows] == list(range(1000)) and len({s for s, _ in rows}) > 1


@pytest.mark.parametrize("rank_rows", [10, 1_000_000])
def test_exact_quantiles(spark, rank_rows):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {
            "normal": rng.normal(size=5000),
            "few": rng.integers(0, 4, 5000).astype(float),
            "heavy": np.where(rng.random(5000) < 0.6, 0.25, rng.exponential(size=5000)),
        }
    )
    df = spark.createDataFrame([tuple(map(float, r)) for r in pdf.itertuples(index=False)], "normal double, few double, heavy double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df.repartition(4), list(pdf), probabilities, rank_rows)
    for c in pdf:
        assert got[c] == pytest.approx(list(np.quantile(pdf[c], probabilities)), abs=1e-12)


def test_quantiles_of_a_column_share_a_sketch(spark, monkeypatch):
    from headroom.operators import quantiles

    sketches, real = [], quantiles.F.percentile_approx
    monkeypatch.setattr(
        quantiles.F, "percentile_approx", lambda c, p, a: sketches.append(len(p)) or real(c, p, a)
    )
    df = spark.range(3000).selectExpr("cast(id as double) as v", "cast(-id as double) as w")
    assert exact_quantiles(df, ["v", "w"], [0.25, 0.75], 2000) == {"v": [749.75, 2249.25], "w": [-2249.25, -749.75]}
    assert sketches == [4, 4]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert np.isnan(got["a"][0]) and got["b"] == [1.0]


def test_invalid_rows(spark):
    rows = [
        (0.5, 0.5, 0, 5),
        (-0.1, 0.5, 0, 5),
        (0.5, -0.1, 0, 5),
        (1.5, 0.5, 0, 5),
        (1.51, 0.5, 0, 5),
        (0.5, 0.5, 5, 5),
        (None, None, 0, 5),
    ]
    df = spark.createDataFrame(
        [(i, a, m, START + timedelta(minutes=s), START + timedelta(minutes=e)) for i, (a, m, s, e) in enumerate(rows)],
        "i int, average_usage double, maximum_usage double, start_time timestamp_ntz, end_time timestamp_ntz",
    )
    assert sorted(r["i"] for r in clean.remove_invalid(df).collect()) == [0, 3, 6]


def test_outliers_are_capped_not_dropped(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0]
    df = spark.createDataFrame([(v,) for v in values], "average_usage double")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    low, high = max(0, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)
    got = [r[0] for r in clean.cap_outliers(df).collect()]
    assert got == pytest.approx(list(np.clip(values, low, high)))
    mean, std = np.mean(values), np.std(values, ddof=1)
    got = [r[0] for r in clean.cap_outliers(df, "zscore").collect()]
    assert got == pytest.approx(list(np.clip(values, max(0, mean - 3 * std), mean + 3 * std)))
    with pytest.raises(ValueError):
        clean.cap_outliers(df, "other")


def test_clean_and_report(spark):
    hour = timedelta(hours=1)
    rows = [
        ("a", START, START, START + hour, 0.5, 0.6, None),
        ("a", START + hour, START, START + hour, 0.5, 0.6, 2.0),
        ("a", START + 2 * hour, START, START, 0.5, 0.6, 2.0),
        (None, START, START, START + hour, 0.5, None, 2.0),
    ]
    df = spark.createDataFrame(
        rows,
        "machine_id string, time timestamp_ntz, start_time timestamp_ntz, end_time timestamp_ntz, "
        "average_usage double, maximum_usage double, assigned_memory double",
    )
    got = sorted(clean.clean_trace(df).collect())
    assert len(got) == 2 and got[0]["assigned_memory"] == 2.0
    report = {r["metric"]: r["value"] for r in clean.cleaning_report(df).collect()}
    assert report == {"missing_values_handled": 3, "invalid_rows_removed": 1, "outliers_capped": 0}


def test_text_times_are_read(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1), ("never", 2)], "time string, x int")
    assert [r["time"] for r in clean.normalise_times(df).collect()] == [datetime(2024, 1, 1, 10), None]


def test_fill_does_not_depend_on_the_order_of_rows(spark):
    hour = START
    rows = [
        ("a", hour, 1.0, 5.0, None),
        ("a", hour, 2.0, None, 1.0),
        ("a", hour, 2.0, None, 1.0),
        ("a", hour, 3.0, 7.0, None),
        ("a", hour + timedelta(hours=1), 1.0, None, None),
        ("b", hour, 1.0, None, 2.0),
    ]
    schema = "machine_id string, time timestamp_ntz, average_usage double, x double, y double"
    rng, seen = np.random.default_rng(1), set()
    for limit in (1, 2, 5_000_000):
        for _ in range(3):
            mixed = [rows[i] for i in rng.permutation(len(rows))]
            filled = clean.fill_missing(spark.createDataFrame(mixed, schema), limit=limit).collect()
            seen.add(tuple(sorted(map(tuple, filled), key=repr)))
    assert len(seen) == 1
    wanted = [("a", 1.0, 5.0, 1.0), ("a", 1.0, 7.0, 1.0), ("a", 2.0, 5.0, 1.0), ("a", 2.0, 5.0, 1.0)]
    wanted += [("a", 3.0, 7.0, 1.0), ("b", 1.0, 0.0, 2.0)]
    assert sorted((r[0], r[2], r[3], r[4]) for r in next(iter(seen))) == sorted(wanted)

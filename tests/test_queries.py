"""Every named query against its SQL equivalent."""

import pytest
from checking import connect, differences

import __spark_entry__ as entry
from headroom.plans.oracles import ORACLES
from headroom.plans.queries import QUERIES

# no SQL form: iterative or matrix work, checked by value in the other tests
ROWS_ONLY = {
    "kmeans_clusters",
    "k_sweep",
    "pca_2d",
    "forecast_hybrid",
    "forecast_seasonal_ma",
    "forecast_likeliest",
    "model_comparison",
    "comparison_averages",
    "full_experiment",
}


# the text operators are tested in a folder of their own
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def database(data_folder):
    return connect(data_folder)


def test_registry():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data_folder, database, name):
    df = entry.queries()[name](spark, data_folder)
    if name in ROWS_ONLY:
        assert df.count() > 0
    else:
        assert differences(df, database, entry.oracle_sql()[name]) == []


def test_entry(spark, data_folder):
    rows = entry.entry(spark).collect()
    assert {r["strategy"] for r in rows} == {"static", "threshold", "moving_average"}

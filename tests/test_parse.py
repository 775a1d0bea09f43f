from datetime import datetime

import pytest
from pyspark.sql import functions as F

from headroom.functions.parse import epoch_to_timestamp, micros_between, normalise_timestamp, numeric_or_null, parse_metric


@pytest.mark.parametrize(
    "text, value",
    [
        ("{'cpus': 0.1}", 0.1),
        ("{'cpus': 0.25, 'memory': 0.5}", 0.25),
        ('{"cpus": 3}', 3.0),
        ("{'memory': 1}", 0.0),
        ("{'cpus': None}", 0.0),
        ("[0.1, 0.3]", 0.2),
        ("[]", 0.0),
        ("[0.1 0.3]", 0.0),
        ("0.7", 0.7),
        ("1e-3", 0.001),
        ("xx", 0.0),
        ("", None),
        ("nan", None),
        (None, None),
    ],
)
def test_metric_text(spark, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(parse_metric(F.col("t"))).first()
    assert row[0] == (value if value is None else pytest.approx(value))


def test_plain_number_or_null(spark):
    df = spark.createDataFrame([("0.5",), ("bad",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in df.select(numeric_or_null(F.col("t"))).collect()] == [0.5, None, None, None]


def test_epoch_units(spark):
    df = spark.createDataFrame([("1700000000", "1700000000123456"), ("x", None)], "s string, us string")
    rows = df.select(epoch_to_timestamp(F.col("s"), "s"), epoch_to_timestamp(F.col("us"), "us")).collect()
    assert rows[0] == (datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 20, 123456))
    assert rows[1] == (None, None)


def test_text_times(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("no time",)], "t string")
    got = [r[0] for r in df.select(normalise_timestamp(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), None]


def test_micros(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-02 00:00:00.000001' b")
    assert df.select(micros_between(F.col("a"), F.col("b"))).first()[0] == 86_400_000_001

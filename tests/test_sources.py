from datetime import datetime

import pytest
from pyspark.sql import functions as F

from headroom.sources import sinks, trace

HEADER = "machine_id,time,start_time,end_time,average_usage,maximum_usage,resource_request,assigned_memory\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_with_metric_text(spark, tmp_path):
    write(
        tmp_path / "a.csv",
        HEADER
        + "1,1700000000000000,1700000000000000,1700000300000000,\"{'cpus': 0.1, 'memory': 0.2}\",\"[0.2, 0.4]\",0.5,0.7\n"
        + "1,bad,1,2,0.1,0.1,0.1,0.1\n",
    )
    df = trace.read_trace_csv(spark, str(tmp_path / "*.csv"))
    rows = df.collect()
    assert len(rows) == 1  # the row without a readable time is dropped
    row = rows[0]
    assert row["machine_id"] == "1" and row["time"] == datetime(2023, 11, 14, 22, 13, 20)
    assert row["end_time"] == datetime(2023, 11, 14, 22, 18, 20)
    assert (row["average_usage"], row["assigned_memory"]) == (0.1, 0.7)
    assert row["maximum_usage"] == pytest.approx(0.3)


def test_csv_seconds_and_plain_numbers(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + "m,1700000000,,,0.1,x,0.5,\n")
    row = trace.read_trace_csv(spark, path, text_metrics=()).first()
    assert row["time"] == datetime(2023, 11, 14, 22, 13, 20)
    assert (row["average_usage"], row["maximum_usage"], row["assigned_memory"]) == (0.1, None, None)


def test_files_of_different_units(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER + "m,1700000000000000,,,0.1,0.1,0.5,1\nm,1000,,,0.1,0.1,0.5,1\nm,3700000000000000,,,0.1,0.1,0.5,1\n")
    write(tmp_path / "b.csv", HEADER + "n,1700000000,,,0.1,0.1,0.5,1\n")
    write(tmp_path / "c.csv", HEADER + "o,2023-11-14 22:13:20,,,0.1,0.1,0.5,1\n")
    rows = trace.read_trace_csv(spark, str(tmp_path / "*.csv")).select("machine_id", "time").collect()
    got = sorted((r[0], str(r[1])) for r in rows)
    assert got[:2] == [("m", "1970-01-01 00:00:00.001000"), ("m", "2023-11-14 22:13:20")]
    assert got[3:] == [("n", "2023-11-14 22:13:20"), ("o", "2023-11-14 22:13:20")]


def test_csv_with_text_times(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + "m,2024-01-01 00:05:00,2024-01-01,2024-01-02,0.1,0.1,0.5,1\n")
    row = trace.read_trace_csv(spark, path).first()
    assert row["time"] == datetime(2024, 1, 1, 0, 5) and row["end_time"] == datetime(2024, 1, 2)


def test_groups_with_other_headers(spark, tmp_path):
    one = write(tmp_path / "a.csv", "machine_id,time,average_usage\na,1700000000,0.1\n")
    two = write(tmp_path / "b.csv", "machine_id,time,maximum_usage\nb,1700000000,0.9\n")
    rows = {r["machine_id"]: r for r in trace.read_trace_groups(spark, [one, two]).collect()}
    assert rows["a"]["maximum_usage"] is None and rows["b"]["maximum_usage"] == 0.9


def test_other_header_in_one_group(spark, tmp_path):
    write(tmp_path / "a.csv", "machine_id,time,average_usage\na,1700000000,0.1\n")
    write(tmp_path / "b.csv", "time,machine_id,average_usage\n1700000000,b,0.9\n")
    with pytest.raises(Exception, match="(?i)header"):
        trace.read_trace_csv(spark, str(tmp_path / "*.csv"), time_unit="s").collect()
    rest = trace.read_trace_csv(spark, str(tmp_path / "*.csv"), time_unit="s", skip_bad_files=True)
    assert rest.count() == 1


def test_known_header(spark, tmp_path):
    path = write(tmp_path / "a.csv", "machine_id,time,average_usage\na,1700000000,0.1\n")
    df = trace.read_trace_csv(spark, path, columns=["machine_id", "time", "average_usage"])
    assert df.first()["average_usage"] == 0.1


def test_no_file_matches(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        trace.read_trace_csv(spark, str(tmp_path / "*.csv")).collect()


def test_schema_check(spark):
    df = spark.createDataFrame([("a", 1.0)], "machine_id string, average_usage double")
    with pytest.raises(ValueError, match="time, maximum_usage, resource_request, assigned_memory"):
        trace.validate_schema(df)
    assert trace.validate_schema(df, ["machine_id"]) is df
    assert trace.preview(df).count() == 1 and trace.column_types(df)[1] == ("average_usage", "double")


def test_summary(spark):
    df = spark.sql(
        """select * from values ('a', timestamp_ntz'2024-01-01 00:00:00', 1D), ('a', null, null),
        (null, timestamp_ntz'2024-01-03 00:00:00', null) as t(machine_id, time, average_usage)"""
    )
    row = trace.trace_summary(df).first()
    assert (row["total_rows"], row["unique_machines"], row["nulls_average_usage"], row["nulls_time"]) == (3, 1, 2, 1)
    assert row["time_start"] == datetime(2024, 1, 1) and row["time_end"] == datetime(2024, 1, 3)


def test_sampling_keeps_whole_machines(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("machine_id"), "id")
    got = trace.sample_machines(df, 7)
    assert got.count() == 140 and got.select("machine_id").distinct().count() == 7
    assert sorted(got.collect()) == sorted(trace.sample_machines(df, 7).collect())
    assert trace.sample_machines(df, 50).count() == 1000
    other = trace.sample_machines(df, 7, seed=1)
    assert {r[0] for r in other.collect()} != {r[0] for r in got.collect()}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)], "machine_id string, h int, actual double")
    sinks.write_results({"one": df, "two": df.limit(1)}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/one")).count() == 3
    sinks.write_results({"one": df}, str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet/one")).count() == 3
    sinks.write_forecast_values(df, str(tmp_path / "values"))
    back = spark.read.option("header", True).csv(str(tmp_path / "values"))
    assert {(r["machine_id"], r["h"]) for r in back.collect()} == {("a", "1"), ("a", "2"), ("b", "1")}
    sinks.write_metrics(df, str(tmp_path / "metrics"))
    average = spark.read.option("header", True).csv(str(tmp_path / "metrics/averages")).first()
    assert float(average["actual"]) == pytest.approx(0.6)
    sinks.save_models(df, str(tmp_path / "models"))
    assert sorted(sinks.load_models(spark, str(tmp_path / "models")).collect()) == sorted(df.collect())


def test_forecast_ranges_lead_to_one_machine(spark, tmp_path):
    import pyarrow.parquet as pq

    folder = str(tmp_path / "ranges")
    ids = spark.range(0, 4000, 1, 5).select(F.format_string("m%03d", F.col("id") % 200).alias("machine_id"), F.floor(F.col("id") / 200).cast("int").alias("h"))
    hot = spark.range(2000).select(F.lit("m100x").alias("machine_id"), F.col("id").cast("int").alias("h"))
    sinks.write_forecast_ranges(ids.union(hot).withColumn("y_pred", F.col("h") / 10), folder, files=10)
    files = sorted((tmp_path / "ranges").glob("*.parquet"))
    groups = [g for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    ends = [(g.column(0).statistics.min, g.column(0).statistics.max) for g in groups]
    assert len(ends) > 5 and sum(low <= "m007" <= high for low, high in ends) <= 2
    # a machine with a third of the rows is not one file's work
    assert max(g.num_rows for g in groups) < 2000
    one = sinks.read_forecast(spark, folder, "m007")
    assert sorted(r["h"] for r in one.collect()) == list(range(20))
    assert sinks.read_forecast(spark, folder, "none").count() == 0

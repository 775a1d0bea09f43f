"""The raw trace: schema, readers, validation, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from headroom.functions.parse import (
    MICROSECOND_MEAN,
    epoch_to_timestamp,
    normalise_timestamp,
    numeric_or_null,
    parse_metric,
)
from headroom.params import METRIC_COLUMNS, REQUIRED_COLUMNS

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("machine_id", T.StringType()),
        T.StructField("instance_index", T.LongType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in METRIC_COLUMNS],
        T.StructField("sample_rate", T.DoubleType()),
    ]
)


def type_trace(raw: DataFrame, text_metrics: Sequence[str] = METRIC_COLUMNS, time_unit: str = "auto") -> DataFrame:
    """Give a table of text columns the types of the trace; drop rows without a time.

    ``text_metrics`` names the metrics that come as maps or lists; the others
    are plain numbers, null when unreadable.  ``time_unit`` is ``us``, ``s``,
    ``timestamp`` or ``auto``, which looks at the mean of each file's time column.
    """
    if time_unit == "auto":
        # one row per file; a table that comes from no file is one
        file = F.input_file_name()
        means = raw.select(file.alias("_named"), F.col("time").try_cast("double").alias("_t"))
        means = means.groupBy("_named").agg(F.avg("_t").alias("_mean"))
        columns, raw = raw.columns, raw.withColumn("_file", file)
        raw = raw.join(means, F.col("_file") == F.col("_named"))
        unit = F.when(F.col("_mean").isNull(), "timestamp").when(F.col("_mean") > MICROSECOND_MEAN, "us").otherwise("s")
    else:
        columns, unit = raw.columns, F.lit(time_unit)

    def moment(text: Column) -> Column:
        return F.when(unit == "us", epoch_to_timestamp(text, "us")).when(unit == "s", epoch_to_timestamp(text, "s"))

    out = {}
    for field in TRACE_SCHEMA:
        name = field.name
        if name not in raw.columns:
            continue
        text = F.col(name).cast("string")
        if name in METRIC_COLUMNS:
            out[name] = parse_metric(text) if name in text_metrics else numeric_or_null(text)
        elif name == "time":
            out[name] = F.when(unit == "timestamp", normalise_timestamp(text)).otherwise(moment(text))
        elif isinstance(field.dataType, T.TimestampNTZType):
            # start and end keep the reading of the time column where they are numbers
            out[name] = F.coalesce(moment(text), normalise_timestamp(text))
        else:
            out[name] = text.try_cast(field.dataType)
    return raw.withColumns(out).select(*columns).dropna(subset=["time"])


def read_trace_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    text_metrics: Sequence[str] = METRIC_COLUMNS,
    time_unit: str = "auto",
    columns: Sequence[str] | None = None,
    skip_bad_files: bool = False,
) -> DataFrame:
    """Read CSV files or globs with one header.

    ``columns`` gives the header where it is known, which avoids a look at the
    first file.  Raises if no path matches, or if a file cannot be read or has
    another header: such files belong in a group of their own
    (``read_trace_groups``), or are left out with ``skip_bad_files``.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    reader = reader.option("ignoreCorruptFiles", skip_bad_files)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return type_trace(reader.csv(paths if isinstance(paths, str) else list(paths)), text_metrics, time_unit)


def read_trace_groups(spark: SparkSession, groups: Sequence[str | Sequence[str]], **options) -> DataFrame:
    """Union of file groups whose headers differ; absent columns become null."""
    parts = [read_trace_csv(spark, g, **options) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_report(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What became of every CSV file: (file, bytes, status, n_rows, n_without_time, n_bad).

    ``status`` is ``read`` where a line is the header of ``columns``, else
    ``other header``, or ``unreadable`` where no line could be read.  Files of
    no bytes are left out, as Spark plans no read for them.  Of files that are read, lines that do not
    give the columns are bad, and the others are rows, with or without a time.
    The inventory of files meets what was read of them, so that files that
    left nothing behind are told as well.  A record is a line here.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    name = F.col("_metadata.file_path").alias("file")
    files = spark.read.format("binaryFile").load(paths).select(name, F.col("length").alias("bytes"))
    lines = spark.read.option("ignoreCorruptFiles", True).text(paths).select("value", name)
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_bad"])
    record = F.from_csv("value", schema, {"columnNameOfCorruptRecord": "_bad", "escape": '"'})
    header = F.col("value") == ",".join(columns)
    bad = F.col("_record._bad").isNotNull()
    timed = F.col("_record.time").isNotNull()
    seen = lines.withColumn("_record", record).groupBy("file").agg(
        F.max(header).alias("_header"),
        F.count_if(~header & ~bad & timed).alias("n_rows"),
        F.count_if(~header & ~bad & ~timed).alias("n_without_time"),
        F.count_if(~header & bad).alias("n_bad"),
    )
    status = F.when(F.col("_header").isNull(), "unreadable").when(~F.col("_header"), "other header").otherwise("read")
    counts = [F.when(F.col("_header"), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("n_rows", "n_without_time", "n_bad")]
    return files.join(seen, "file", "left").select("file", "bytes", status.alias("status"), *counts)


def read_trace_parquet(spark: SparkSession, path: str, skip_bad_files: bool = False) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", skip_bad_files).parquet(path).dropna(subset=["time"])


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def validate_schema(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The same DataFrame, or an error that lists the missing columns."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def trace_summary(df: DataFrame) -> DataFrame:
    """Rows, machines, time range and null count of every column, in one pass."""
    nulls: list[Column] = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("machine_id").alias("unique_machines"),
        F.min("time").alias("time_start"),
        F.max("time").alias("time_end"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        *nulls,
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows; ``df.dtypes`` gives the column types."""
    return df.limit(n)


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def sample_machines(df: DataFrame, n: int = 1000, seed: int = 42, key: str = "machine_id") -> DataFrame:
    """All rows of ``n`` machines drawn by a seeded hash; every row if there are no more.

    The drawn ids are ``n`` short strings, the only thing that is broadcast.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(draw, key).limit(n)
    return df.join(F.broadcast(ids) if n <= 100_000 else ids, key, "left_semi")

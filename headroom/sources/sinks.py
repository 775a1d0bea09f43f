"""Writers of results and the store of fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_results(tables: dict[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """One folder per result table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def write_forecast_values(values: DataFrame, folder: str, key: str = "machine_id") -> None:
    """Actual and predicted values as CSV, one folder per machine.

    Rows are first brought together by machine, so that a machine's folder
    holds few files.  The number of tasks is fixed: folders take the time, and
    by bytes adaptive execution would leave them all to a few tasks.  Tasks put
    their files in place themselves, so the driver does not move one folder per
    machine when they are done.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        values.repartition(tasks, key)
        .sortWithinPartitions(key, "h")
        .write.mode("overwrite")
        .option("header", True)
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy(key)
        .csv(folder)
    )


def write_forecast_ranges(values: DataFrame, folder: str, key: str = "machine_id", files: int | None = None) -> None:
    """Actual and predicted values as parquet, sorted by machine and step over all files.

    For any number of machines: files hold ranges of (machine, step), so a
    machine's values lie in one file or in neighbouring ones, and the statistics
    of the row groups lead to them.  A machine with many steps spreads over
    several files.  ``files`` sets their number.
    """
    ranged = values.repartitionByRange(files, key, "h") if files else values.repartitionByRange(key, "h")
    ranged.sortWithinPartitions(key, "h").write.mode("overwrite").parquet(folder)


def read_forecast(spark: SparkSession, folder: str, machine: str, key: str = "machine_id") -> DataFrame:
    """One machine's values out of ``write_forecast_ranges``; other ranges are skipped."""
    return spark.read.parquet(folder).filter(F.col(key) == machine)


def average_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of every numeric column over the machines."""
    numeric = [f.name for f in metrics.schema if isinstance(f.dataType, T.NumericType)]
    return metrics.agg(*[F.avg(c).alias(c) for c in numeric])


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """The metric table and its averages as CSV."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics")
    average_metrics(metrics).write.mode("overwrite").option("header", True).csv(f"{folder}/averages")


def save_models(models: DataFrame, path: str) -> None:
    """Fitted models are rows; scoring needs nothing else."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

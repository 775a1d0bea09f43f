"""The analysis tables derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headroom.operators.windows import window_start


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine-usage trace out of ``events``: one machine per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    usage = F.col("value") / 100.0
    start = F.col("ts")
    return _table(spark, sf_dir, "events").select(
        F.format_string("machine_%04d", "user_id").alias("machine_id"),
        "event_id",
        F.concat(F.lit("cluster_"), (F.col("user_id") % 8).cast("string")).alias("cluster"),
        start.alias("time"),
        start.alias("start_time"),
        F.when(F.col("event_id") % 97 == 0, start)
        .otherwise(start + F.expr("interval 5 minutes"))
        .alias("end_time"),
        usage.alias("average_usage"),
        (usage * (1 + k / F.lit(100.0))).alias("maximum_usage"),
        (k / F.lit(50.0)).alias("resource_request"),
        F.when(F.col("event_type") != "error", 0.5 + k / F.lit(100.0)).alias("assigned_memory"),
    )


def windowed_usage(spark: SparkSession, sf_dir: str, minutes: int = 43_200) -> DataFrame:
    """Mean usage per supplier and thirty-day window out of ``lineitem``."""
    return (
        _table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("machine_id"),
            window_start("l_shipdate", minutes).alias("time"),
        )
        .agg((F.avg("l_quantity") / 50.0).alias("y"))
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors: (id, x, cluster)."""
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").alias("cluster"),
    )

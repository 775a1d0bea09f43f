"""Order-dependent work on raw rows without one task per machine.

A raw trace may hold a third of its rows under one machine, so a window over
``machine_id`` alone would put them all in one task.  The helpers here cut a
machine's rows into consecutive chunks; an operator works inside each chunk
and passes a small summary from chunk to chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from headroom.session import stage

CHUNK = ("_bucket", "_slice")
BROADCAST_ROWS = 500_000


def range_slices(
    df: DataFrame, order: Sequence[str], name: str = "slices", n: int | None = None
) -> DataFrame:
    """Add ``_slice``: consecutive, evenly filled ranges of ``order``, ``n`` of them if given.

    Written as a table, so a slice keeps its rows when executors are lost.
    """
    ranged = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
    return stage(ranged.withColumn("_slice", F.spark_partition_id()), name)


def order_chunks(
    df: DataFrame,
    key: str,
    time: str,
    ties: Sequence[str] = (),
    width: str = "1 day",
    limit: int = 5_000_000,
) -> DataFrame:
    """Add ``_bucket`` and ``_slice``; sorted by both, chunks follow the row order.

    A chunk is one machine in one time bucket.  Buckets above ``limit`` rows
    (there are at most rows/limit of them) are cut further into ranges of
    (key, time, ties), equal rows included, so that no chunk grows with the data.
    """
    df = df.withColumn("_bucket", F.window(F.col(time), width)["start"])
    hot = df.groupBy(key, "_bucket").count().filter(F.col("count") > limit)
    n_hot, hot_rows = hot.agg(F.count(F.lit(1)), F.sum("count")).first()
    if n_hot == 0:
        return df.withColumn("_slice", F.lit(0))
    hot = stage(hot.select(key, "_bucket"), "hot-buckets")
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    slices = 2 * math.ceil(hot_rows / limit)
    # rows alike in all of the order are told apart by their place in a written table
    big = stage(df.join(hot, [key, "_bucket"], "left_semi"), "hot-rows").withColumn("_row", F.monotonically_increasing_id())
    big = range_slices(big, [key, time, *ties, "_row"], n=slices).drop("_row")
    rest = df.join(hot, [key, "_bucket"], "left_anti").withColumn("_slice", F.lit(0))
    return rest.unionByName(big)

"""What the text operators share: tables, column expressions, running totals."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from headroom.session import stage

# fixed values: a word is a run of anything but space, tab, line feed, vertical tab, form feed, return
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # a text without multi-byte characters has the same lower case either way, and lower() is faster
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: how rows are held out."""
    return F.crc32(doc_id.cast("string")) % divisor


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name that none of ``taken`` equals."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def with_row_key(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a key per row, (file, row_index), and the name of that column.

    Ids may be null or repeat, so what is decided about a row is told by its
    place in written files, as numbers made anew could differ.  A table read
    straight from Parquet files has places already; anything else is written
    first, since behind a join or an explode rows share their place.
    """
    row = fresh("row", docs.columns)
    straight = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not straight or "_metadata" in docs.columns:
        docs = stage(docs, name)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    try:
        return docs.select("*", place.alias(row)), row
    except AnalysisException:  # files of another kind have no positions
        return stage(docs, name).select("*", place.alias(row)), row


def without(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose key ``row`` is not in the one column of ``gone``, without the key."""
    return keyed.join(gone.toDF(row), row, "left_anti").drop(row)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object a worker keeps for its next tasks; modules outlive tasks, and one object is kept at a time."""
    held = sys.__dict__.get("_headroom_kept")
    if held is None or held[0] != key:
        sys.__dict__.pop("_headroom_kept", None)  # the former one goes before the next is made
        del held
        held = sys.__dict__["_headroom_kept"] = (key, make())
    return held[1]


def blocks_for(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / block_rows))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    blocks: int,
) -> DataFrame:
    """Per row, the sum of each of ``totals`` over the rows of its key before it.

    A key may hold a third of all rows, so its rows are dealt to ``blocks``
    blocks by a hash of ``order``.  Totals run inside a block, and an offset
    per block, out of a table with one row per key and block, is added.
    The order of rows is (block, order).  ``keys`` must not be null.
    ``df`` is read twice and should be a small written table.
    """
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    at = [*keys, "_block"]
    sums = dealt.groupBy(*at).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *at, *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in totals]
    )
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{k}") for k, v in totals.items()])
    joined = run.join(offsets, at)
    return joined.select(
        *df.columns, "_block", *[(F.col(f"_off_{k}") + F.col(f"_in_{k}")).alias(k) for k in totals]
    )

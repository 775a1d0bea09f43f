"""Exact duplicates: 128-bit hash first, then the bytes themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headroom.llm.common import lower_ascii, with_row_key, without
from headroom.session import stage


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  Of equal texts the smallest id stays, or the largest.  Rows are
    grouped by a 128-bit hash together with the text itself, so a group never
    mixes texts that only share the hash; copies meet in the partial
    aggregation before the shuffle, however many there are.  Only ids and
    hashes are shuffled a second time.

    Defined cases: a null id counts as an id like any other (below all
    others); rows that repeat the id that stays are all kept; an empty table
    gives no rows; other columns are ignored.
    """
    return _told(docs.select("doc_id", "text"), keep)


def _told(docs: DataFrame, keep: str) -> DataFrame:
    """As ``exact_duplicates``, with the columns of ``docs`` other than the text in place of doc_id."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    own = [c for c in docs.columns if c != "text"]
    rows = _with_hash(docs)
    # min and max skip nulls: a group of null ids only has a null keeper
    classes = rows.groupBy("_hash", "_norm").agg(
        pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    by_hash = classes.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_texts"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.max(F.sha2("_norm", 256)).alias("text_sha256"),
    )
    by_hash = stage(by_hash, "copies")
    told = rows.select(*own, "_hash").join(by_hash.filter("_texts = 1"), "_hash").drop("_hash", "_texts")
    shared = by_hash.filter("_texts > 1").select("_hash")
    if not shared.isEmpty():  # different texts under one hash: compare text with text
        apart = classes.join(shared, "_hash", "left_semi")
        told = told.unionByName(
            rows.join(apart, ["_hash", "_norm"]).select(
                *own, "keep_id", "group_size", F.sha2("_norm", 256).alias("text_sha256")
            )
        )
    return told.select(
        *own, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, whole, with the columns they came with; rows that repeat the id that stays, too."""
    keyed, row = with_row_key(docs, "copies-in")
    told = _told(keyed.select("doc_id", F.col(row).alias("_row"), "text"), keep)
    return without(keyed, row, told.filter(~F.col("kept")).select("_row"))


def keep_one_of_each(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of all rows with equal texts, whole: one with the largest (or smallest) id.

    A null id is below all others when the largest stays, and above them when
    the smallest does.
    """
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    keyed, row = with_row_key(docs, "copies-in")
    rows = _with_hash(keyed.select("doc_id", F.col(row).alias("_row"), "text"))
    # a group of null ids only has no row by id
    stays = rows.groupBy("_hash", "_norm").agg(F.coalesce(pick("_row", "doc_id"), F.min("_row")).alias(row))
    return keyed.join(stage(stays.select(row), "stays"), row, "left_semi").drop(row)


def _with_hash(docs: DataFrame) -> DataFrame:
    """The text as compared, and its 128-bit hash, in place of the text."""
    rows = docs.withColumn("_norm", lower_ascii(F.col("text"))).drop("text")
    return rows.withColumn("_hash", F.unhex(F.md5("_norm")))

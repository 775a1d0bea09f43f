"""Shards whose rows have a position, and the slots of a mix."""

from collections import Counter

import numpy as np
import pytest
from llm_cases import ROWS, odd_documents
from pyspark.sql import functions as F
from test_llm_layout import check_shards, size_of

from headroom.llm import sharding


def positioned(spark, rows, path, extra=()):
    """(doc_id, text, file) with a position counted per file, in the order given."""
    seen, out = Counter(), []
    for doc_id, text, file in rows:
        out.append((doc_id, text, file, seen[file], *extra))
        seen[file] += 1
    schema = "doc_id long, text string, file string, at long" + "".join(f", {c} string" for c in extra)
    spark.createDataFrame(out, schema).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("shards", [1, 3, 4, 9])
def test_rows_follow_the_flow_in_order(spark, tmp_path, shards):
    rng = np.random.default_rng(shards)
    rows = [(None if i % 9 == 0 else i % 50, "x" * int(rng.integers(0, 80)), [None, "a", "b", "hot"][k]) for i, k in enumerate(rng.choice(4, 500, p=[0.1, 0.1, 0.2, 0.6]))]
    clashing = ("shard", "slot", "_file", "_place", "row", "_row", "old_shard", "size", "_shard", "_slot", "_at", "_name")
    docs = positioned(spark, rows, str(tmp_path / "in"), clashing)
    got = sharding.reshard_in_order(docs, "file", "at", shards, block_rows=30).collect()
    sizes = check_shards(got, [r[:2] for r in rows], shards)
    total = sum(sizes.values())
    assert all(abs(sizes.get(k, 0) - total / shards) <= 5 * 96 for k in range(shards))
    old = Counter()
    for _, text, file in rows:
        old[file] += size_of(text)
    names = sorted(old, key=lambda f: "" if f is None else "/" + f)
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    least = sum(max(0, old[f] - (total // shards if k < shards else 0)) for k, f in enumerate(names))
    assert abs(moved - least) <= 8 * 96


def test_shards_that_stay_are_not_written(spark, tmp_path):
    rows = [(i, "x" * 10, "a") for i in range(30)] + [(i, "y" * 10, "b") for i in range(20)] + [(i, "z" * 10, "c") for i in range(40)]
    docs = positioned(spark, rows, str(tmp_path / "in"))
    got = sharding.reshard_in_order(docs, "file", "at", 3).collect()
    check_shards(got, [r[:2] for r in rows], 3)
    assert {(r["old_shard"], r["shard"]) for r in got} == {(0, 0), (1, 1), (2, 1), (2, 2)}


def test_positions_must_count_from_zero(spark):
    df = spark.createDataFrame([(1, "a", "f", 0), (2, "b", "f", 2)], "doc_id long, text string, file string, at long")
    with pytest.raises(ValueError, match="positions"):
        sharding.reshard_in_order(df, "file", "at", 2)


def test_odd_and_no_documents(spark, tmp_path):
    docs = odd_documents(spark).coalesce(1).withColumn("at", F.monotonically_increasing_id()).withColumn("file", F.lit("f"))
    got = sharding.reshard_in_order(docs, "file", "at", 3).collect()
    check_shards(got, [r[:2] for r in ROWS], 3)
    assert sharding.reshard_in_order(docs.limit(0), "file", "at", 3).count() == 0

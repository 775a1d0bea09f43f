"""Blocks of points: how many there are, and what a pair of them costs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.operators import blocks, density


def test_blocks_grow_before_there_are_more_of_them(spark):
    assert [blocks.block_rows(n, 64) for n in (10, 2000, 32_000, 10**6)] == [64, 64, 1000, 4096]
    assert blocks.block_rows(10**6, 9000) == 9000
    points = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("x"))
    dealt, n = blocks.spatial_blocks(points, 2, None, 4)
    assert n <= blocks.FEW_BLOCKS and dealt.select("_block").distinct().count() <= blocks.FEW_BLOCKS


def test_pairs_of_blocks_are_not_shuffled(spark):
    points = spark.range(300).select("id", F.array(F.rand(1), F.rand(2)).alias("x"), F.array((F.col("id") % 3).cast("int")).alias("labels"))
    dealt = blocks.packed(blocks.with_block(points, 6), 2)
    assert dealt.count() <= 6
    plan = blocks.met_blocks(dealt, dealt, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan
    assert blocks.distance_totals(points, 1).count() == 900


@pytest.mark.parametrize("dims", [3, 40])
def test_distances_by_product_and_by_differences(dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(50, 1, (700, dims)), rng.normal(50, 1, (1, dims)) + rng.normal(0, 1e-7, (40, dims))])
    x = np.concatenate([x, x[:30]])
    x[5, 1], x[6, 0] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        wanted = np.sqrt(np.square(x[:400, None] - x[None]).sum(-1))
        got = np.concatenate([d.copy() for _, d in blocks.distance_stripes(x[:400], x)])
    assert np.allclose(got, wanted, rtol=1e-9, atol=0, equal_nan=True)


def test_limits_of_squares():
    for eps in (0.9, 0.1, 1 / 3, 7.7):
        limit = blocks.squared_limit(eps)
        assert np.sqrt(limit) <= eps < np.sqrt(np.nextafter(limit, np.inf))


def test_joining_a_full_block_takes_little_memory():
    x = np.random.default_rng(1).normal(0, 1, (blocks.BLOCK_ROWS, 6))
    block = {"_block": 0, "x": x.ravel(), "id": np.arange(len(x)), "low": x.min(0), "high": x.max(0)}
    tracemalloc.start()
    found = density.connect_inside(6, 0.9)(block).iloc[0]
    pair = {"x": block["x"], "number": found["number"], "root": found["root"], "low": x.min(0), "high": x.max(0)}
    pair |= {f"r_{c}": v for c, v in pair.items()}
    links = density.connect_outside(6, 0.9)(pair)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert set(zip(links["id"], links["root"], strict=True)) == {(v, v) for v in found["root"]}


def test_folders_are_written_by_several_tasks(spark, tmp_path):
    from headroom.sources import sinks

    ids = spark.range(80).select(F.concat(F.lit("m"), F.col("id") % 40).alias("machine_id"), F.floor(F.col("id") / 40).cast("int").alias("h"))
    sinks.write_forecast_values(ids.withColumn("actual", F.lit(0.5)), str(tmp_path / "values"))
    files = [p.name.split("-")[1] for p in (tmp_path / "values").glob("machine_id=*/part-*.csv")]
    assert len(files) == 40 and len(set(files)) > 1

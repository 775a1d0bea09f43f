"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headroom.session import stage


def _fingerprint(links: DataFrame) -> tuple:
    """Number and 128 bits of a set of distinct links, in one pass over a written table."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for every id in a link.

    Alternates two steps on a table of directed links until nothing changes:
    every larger neighbour of an id is linked to the id's smallest neighbour,
    then every smaller one.  Each step is an aggregation and a join, its
    result is written, and the number of links never grows.  Rounds grow with
    the logarithm of the longest path.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    links = stage(links, "links")
    seen = _fingerprint(links)
    while True:
        # the larger neighbours of u go to the smallest of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # the smaller neighbours of u, and u, go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        after = moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = stage(after, "links")
        before, seen = seen, _fingerprint(after)
        if seen == before:
            roots = after.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
            return after.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        links = after

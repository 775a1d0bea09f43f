"""Distances between all points, block by block.

Points are dealt into blocks of a few thousand, and a block is packed into one
row.  Blocks meet in a product of two short tables that are written once and
read by the tasks, so no point is shuffled once per block it meets.  Tasks
return sums or the nearest few per point, never the pairs themselves.  Block
sizes do not depend on labels or density, so a cluster that holds a third of
the points is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.operators.ordered import range_slices
from headroom.session import stage

BLOCK_ROWS = 4096
FEW_BLOCKS = 32  # smaller blocks grow before there are more of them
STRIPE_NUMBERS = 1 << 18  # distances computed at a time, few enough for a cache
DIRECT_DIMENSIONS = 8  # beyond, distances come out of a matrix product
CANCELLED = 1e-5  # squares this small beside the norms are computed again from the differences
RIGHT_NUMBERS = 1 << 22  # numbers a task buffers of one side
TASK_PAIRS = 1 << 26  # distances that are worth a task
CELL_DIMENSIONS = 3  # of the grid in which blocks look for their neighbours


def block_rows(count: int, rows: int) -> int:
    """Points of a block: ``rows`` while that makes few blocks, then more, up to ``BLOCK_ROWS``."""
    return max(rows, min(BLOCK_ROWS, math.ceil(count / FEW_BLOCKS)))


def squared_stripes(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of ``left`` to ``right``, some rows at a time; the next stripe overwrites the last."""
    step = max(1, STRIPE_NUMBERS // max(1, len(right)))
    columns = np.ascontiguousarray(right.T)
    total, apart = np.empty((2, min(step, len(left)), len(right)))
    for at in range(0, len(left), step):
        rows = slice(at, at + step)
        part = left[rows]
        sums, off = total[: len(part)], apart[: len(part)]
        sums[:] = 0.0
        for k, column in enumerate(columns):
            np.subtract(part[:, k, None], column, out=off)
            np.multiply(off, off, out=off)
            np.add(sums, off, out=sums)
        yield rows, sums


def product_stripes(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """As ``squared_stripes``, by one matrix product a stripe; where that cancels, from the differences."""
    step = max(1, STRIPE_NUMBERS // max(1, len(right)))
    sound = left[np.isfinite(left).all(axis=1)]
    centre = sound.mean(axis=0) if len(sound) else 0.0
    a, b = left - centre, right - centre
    norms, others = (a * a).sum(1), (b * b).sum(1)
    columns = np.ascontiguousarray(b.T)
    for at in range(0, len(left), step):
        rows = slice(at, at + step)
        size = norms[rows, None] + others
        sums = a[rows] @ columns
        sums *= -2.0
        sums += size
        size *= CANCELLED
        i, j = np.nonzero(~(sums > size))
        for some in range(0, len(i), BLOCK_ROWS):
            u, v = i[some : some + BLOCK_ROWS], j[some : some + BLOCK_ROWS]
            sums[u, v] = np.square(left[at + u] - right[v]).sum(1)
        yield rows, sums


def distance_stripes(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Euclidean distances of ``left`` to ``right``, some rows at a time; the next stripe overwrites the last."""
    stripes = squared_stripes if left.shape[1] <= DIRECT_DIMENSIONS else product_stripes
    for rows, squares in stripes(left, right):
        yield rows, np.sqrt(squares, out=squares)


def squared_limit(eps: float) -> float:
    """The largest square whose root is at most ``eps``."""
    limit = eps * eps
    while np.sqrt(limit) > eps:
        limit = np.nextafter(limit, 0.0)
    while np.sqrt(np.nextafter(limit, np.inf)) <= eps:
        limit = np.nextafter(limit, np.inf)
    return float(limit)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def with_block(points: DataFrame, n: int, key: str = "id") -> DataFrame:
    return points.withColumn("_block", F.pmod(F.hash(key), F.lit(n)))


def spatial_blocks(
    points: DataFrame, dims: int, width: float | None = None, rows: int = BLOCK_ROWS, first: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """Add ``_block`` so that near points tend to share one; even sizes; staged.

    Points are ranged along a grid whose cells are ``width`` wide, or as wide
    as gives about one cell per block.  ``first`` are columns to range by before.
    """
    count = points.count()
    n = max(1, math.ceil(count / block_rows(count, rows)))
    widths = [width] * dims
    if width is None:
        spans = points.agg(*[F.max(F.col("x")[i]) - F.min(F.col("x")[i]) for i in range(dims)]).first()
        parts = math.ceil(n ** (1 / min(dims, 3)))
        widths = [(span or 1.0) / parts for span in spans]
    cells = {f"_c{i}": F.floor(F.col("x")[i] / w) for i, w in enumerate(widths)}
    ranged = points.withColumns(cells).repartitionByRange(n, *first, *cells, *[F.col("x")[i] for i in range(dims)], "id")
    ranged = ranged.withColumn("_block", F.spark_partition_id())
    return stage(ranged.drop(*cells), "blocks"), n


def near_pairs(blocks: DataFrame, n: int, reach: Column, dims: int) -> DataFrame:
    """Pairs of blocks whose bounding boxes are within reach: (_left, _right).

    ``reach`` is a column that is the same for all points of a block; it holds
    for the left block.
    """
    low = F.array(*[F.min(F.col("x")[i]) for i in range(dims)])
    high = F.array(*[F.max(F.col("x")[i]) for i in range(dims)])
    boxes = blocks.groupBy("_block").agg(low.alias("low"), high.alias("high"), F.max(reach).alias("reach"))
    boxes = stage(boxes, "boxes")
    # cells as wide as the widest box and the furthest reach: a box lies in two of them per
    # dimension, and in three with its reach, however many boxes there are
    endless = F.col("reach") == float("inf")
    used = range(min(dims, CELL_DIMENSIONS))
    extents = [F.max(F.col("high")[i] - F.col("low")[i]) for i in used]
    *widths, furthest = boxes.agg(*extents, F.max(F.when(~endless, F.col("reach")))).first()
    widths = [(w + (furthest or 0.0)) or 1.0 for w in widths]

    def cells(margin: Column) -> Column:
        cell = F.array(F.array().cast("array<bigint>"))
        for i, w in zip(used, widths, strict=True):
            a, b = F.floor((F.col("low")[i] - margin) / w), F.floor((F.col("high")[i] + margin) / w)
            along = F.sequence(a, b)
            cell = F.flatten(F.transform(cell, lambda c: F.transform(along, lambda k: F.concat(c, F.array(k)))))
        return cell

    left = boxes.withColumnsRenamed({"_block": "_left"})
    right = boxes.drop("reach").withColumn("_cell", F.explode(cells(F.lit(0.0))))
    right = right.withColumnsRenamed({"_block": "_right", "low": "rlow", "high": "rhigh"})
    finite = left.filter(~endless).withColumn("_cell", F.explode(cells(F.col("reach"))))
    met = finite.join(right, "_cell").drop("_cell").dropDuplicates(["_left", "_right"])
    # a block with fewer points than neighbours asked for looks everywhere; only the last blocks are that small
    everywhere = left.filter(endless).withColumn("_right", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    everywhere = everywhere.join(right.drop("_cell").dropDuplicates(["_right"]), "_right")
    gap2 = F.lit(0.0)
    for i in range(dims):
        gap = F.greatest(
            F.col("rlow")[i] - F.col("high")[i], F.col("low")[i] - F.col("rhigh")[i], F.lit(0.0)
        )
        gap2 = gap2 + gap * gap
    # a little slack: the exact test is done on the points
    near = gap2 <= F.col("reach") * F.col("reach") * (1 + 1e-9)
    return met.unionByName(everywhere).filter(near).select("_left", "_right")


def packed(blocks: DataFrame, dims: int, columns: Sequence[str] = ("id",), keys: Sequence[str] = ("_block",)) -> DataFrame:
    """One row per block, staged: x and ``columns`` of its points as arrays, in the order of ``columns``.

    With the box of its first ``dims`` dimensions, if any.
    """
    box = {"low": F.min, "high": F.max} if dims else {}
    box = [F.array(*[edge(F.col("x")[i]) for i in range(dims)]).alias(c) for c, edge in box.items()]
    table = blocks.groupBy(*keys).agg(*box, F.sort_array(F.collect_list(F.struct(*columns, "x"))).alias("_rows"))
    listed = [F.col(f"_rows.{c}").alias(c) for c in columns]
    return stage(table.withColumns({"x": F.flatten("_rows.x")}).select("*", *listed).drop("_rows"), "packed")


def unflattened(flat: np.ndarray, dims: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, dims)


def met_blocks(left: DataFrame, right: DataFrame, dims: int, met: Column | None = None) -> DataFrame:
    """Every packed block of ``left`` beside every one of ``right`` (columns r_...), where ``met``.

    The product reads both tables again and again instead of shuffling copies
    of them; a task holds some of the left blocks and buffers a bounded part of
    the right ones, which follow one another for each left block.
    """
    (n, some), (_, all_) = (t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("x")), F.lit(0))).first() for t in (left, right))
    most = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n, most, math.ceil((some / dims) * (all_ / dims) / TASK_PAIRS)))
    buffered = max(1, math.ceil(all_ / dims * (dims + 4) / RIGHT_NUMBERS))
    other = right.select(*[F.col(c).alias(f"r_{c.lstrip('_')}") for c in right.columns]).repartition(buffered)
    other = other.hint("shuffle_replicate_nl")
    one = left.repartition(parts)
    return one.crossJoin(other) if met is None else one.join(other, met)


def boxes_near(dims: int, reach: Column) -> Column:
    """Whether the boxes of two met blocks are within reach; with a little slack, as points are tested exactly."""
    gap2 = F.lit(0.0)
    for i in range(dims):
        gap = F.greatest(F.col("r_low")[i] - F.col("high")[i], F.col("low")[i] - F.col("r_high")[i], F.lit(0.0))
        gap2 = gap2 + gap * gap
    return gap2 <= reach * reach * (1 + 1e-9)


def near_box(x: np.ndarray, low: np.ndarray, high: np.ndarray, reach2: np.ndarray | float) -> np.ndarray:
    """Row numbers of the points within reach of a box, with the slack of ``boxes_near``."""
    gap = np.maximum(np.maximum(low - x, x - high), 0.0)
    return np.flatnonzero((gap * gap).sum(1) <= reach2 * (1 + 1e-9))


def over_rows(table: DataFrame, kernel: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` of every row, a dict, of a table of packed blocks or of pairs of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out = kernel(row)
                if len(out):
                    yield out

    return table.mapInPandas(run, schema)


# --- silhouette ------------------------------------------------------------------


def distance_totals(points: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of distances of each point to each cluster, for several labelings at once.

    ``points`` is (id, x, labels array<int>); gives (id, m, own, cluster, total).
    """
    count = points.count()
    kind = dict(points.dtypes)["id"]
    schema = f"id {kind}, m int, own int, cluster array<int>, total array<double>"
    first = points.select(F.size("x").alias("dims"), F.size("labels").alias("m")).first()
    dims, labelings = (first["dims"], first["m"]) if first else (0, 0)
    dealt = with_block(points.select("id", "x", "labels"), max(1, math.ceil(count / block_rows(count, rows))))
    blocks = packed(dealt, 0, ("id", "labels")).withColumn("labels", F.flatten("labels"))
    pairs = met_blocks(blocks, blocks.drop("id"), max(1, dims))

    def emitted(block: dict, sums: list[dict]) -> Iterator[pd.DataFrame]:
        mine = np.asarray(block["labels"], dtype=float).reshape(-1, labelings)
        for m, found in enumerate(sums):
            if found:
                names, totals = list(found), np.stack(list(found.values()), axis=1)
                yield pd.DataFrame(
                    {
                        "id": block["id"],
                        "m": m,
                        "own": mine[:, m],
                        "cluster": [names] * len(mine),
                        "total": list(totals),
                    }
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the right blocks of one left block follow one another: a sum leaves the task once for all of them
        block, sums = None, []
        for batch in batches:
            for row in batch.to_dict("records"):
                if block is None or row["_block"] != block["_block"]:
                    if block is not None:
                        yield from emitted(block, sums)
                    block, sums = row, [{} for _ in range(labelings)]
                    left = unflattened(row["x"], dims)
                right = unflattened(row["r_x"], dims)
                theirs = np.asarray(row["r_labels"], dtype=float).reshape(-1, labelings)
                groups = [np.unique(theirs[:, m], return_inverse=True) for m in range(labelings)]
                ends = np.cumsum([len(names) for names, _ in groups])
                member = np.zeros((len(right), ends[-1]))
                for end, (names, code) in zip(ends, groups, strict=True):
                    member[np.arange(len(right)), end - len(names) + code] = 1.0
                added = np.concatenate([d @ member for _, d in distance_stripes(left, right)])
                for m, (end, (names, _)) in enumerate(zip(ends, groups, strict=True)):
                    for name, total in zip(names, added[:, end - len(names) : end].T, strict=True):
                        if not np.isnan(name):
                            sums[m][int(name)] = sums[m].get(int(name), 0.0) + total
        if block is not None:
            yield from emitted(block, sums)

    totals = pairs.mapInPandas(run, schema).select("id", "m", "own", F.explode(F.arrays_zip("cluster", "total")).alias("t"))
    return totals.groupBy("id", "m", "own", F.col("t.cluster").alias("cluster")).agg(F.sum("t.total").alias("total"))


def silhouettes(points: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of each point per labeling: (id, m, cluster, silhouette)."""
    points = stage(points.select("id", "x", "labels"), "labelled")
    sizes = (
        points.select(F.posexplode("labels").alias("m", "cluster")).groupBy("m", "cluster").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = distance_totals(points, rows).join(sizes, ["m", "cluster"])
    is_own = F.col("cluster") == F.col("own")
    near = totals.groupBy("id", "m", "own").agg(
        F.max(F.when(is_own, F.col("n"))).alias("size"),
        F.max(F.when(is_own & (F.col("n") > 1), F.col("total") / (F.col("n") - F.when(F.col("n") > 1, 1).otherwise(0)))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    value = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return near.select("id", "m", F.col("own").alias("cluster"), value.alias("silhouette"))


# --- neighbours ------------------------------------------------------------------


def kth_distances(points: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Distance of each point to its k-th nearest point, itself included: (id, distance).

    The k-th distance inside a point's own block is an upper bound, so only
    blocks closer than the largest bound of a block are compared with it.
    """
    points = stage(points.select("id", "x"), "points")
    dims = points.select(F.size("x")).first()
    kind = dict(points.dtypes)["id"]
    if dims is None:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    dims = dims[0]
    blocks, _ = spatial_blocks(points, dims, None, rows)

    def nearest(squares: np.ndarray) -> np.ndarray:
        keep = min(k, squares.shape[1])
        return np.sort(np.partition(squares, keep - 1, axis=1)[:, :keep], axis=1)

    def inside(block: dict) -> pd.DataFrame:
        x = unflattened(block["x"], dims)
        found = np.concatenate([nearest(squares) for _, squares in squared_stripes(x, x)])
        bound = found[:, k - 1] if found.shape[1] == k else np.full(len(x), np.inf)
        one = {"_block": block["_block"], "low": block["low"], "high": block["high"], "x": block["x"], "id": block["id"]}
        return pd.DataFrame([one | {"bound": bound, "near": list(found)}])

    def outside(pair: dict) -> pd.DataFrame:
        # only distances up to a point's own bound can still count
        x, bound = unflattened(pair["x"], dims), np.asarray(pair["bound"], dtype=float)
        at = near_box(x, pair["r_low"], pair["r_high"], bound)
        ids, found = [], []
        for rows, squares in squared_stripes(x[at], unflattened(pair["r_x"], dims)):
            for row, line, limit in zip(at[rows], nearest(squares), bound[at[rows]], strict=True):
                if line[0] <= limit:
                    ids.append(pair["id"][row])
                    found.append(line[line <= limit])
        return pd.DataFrame({"id": ids, "near": found}, dtype=object)

    box = "_block int, low array<double>, high array<double>, x array<double>"
    own = over_rows(packed(blocks, dims), inside, f"{box}, id array<{kind}>, bound array<double>, near array<array<double>>")
    own = stage(own, "bounded-blocks")
    # a block with fewer than k points has no bound and looks everywhere
    met = (F.col("_block") != F.col("r_block")) & boxes_near(dims, F.sqrt(F.array_max("bound")))
    pairs = met_blocks(own.drop("near"), own.select("_block", "low", "high", "x"), dims, met)
    others = over_rows(pairs, outside, f"id {kind}, near array<double>")
    each = own.select(F.inline(F.arrays_zip("id", "near")))
    lists = each.unionByName(others).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return lists.filter(F.size("near") >= k).select("id", F.sqrt(F.col("near")[k - 1]).alias("distance"))


def elbow(distances: DataFrame, column: str = "distance", key: str = "id") -> DataFrame:
    """The value at the sharpest bend of the sorted distances: one row ``eps``.

    Second differences are taken inside ranges of the sorted values; the last
    two values of the ranges before are carried in.
    """
    sliced = range_slices(distances.select(key, column), [column, key], "elbow")
    within = Window.partitionBy("_slice").orderBy(column, key)
    back = Window.partitionBy("_slice").orderBy(F.desc(column), F.desc(key))
    # the last two values of each slice, oldest first; one row per slice from here on
    tails = (
        sliced.withColumn("_r", F.row_number().over(back))
        .filter(F.col("_r") <= 2)
        .groupBy("_slice")
        .agg(F.sort_array(F.collect_list(column)).alias("tail"))
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("_slice", F.flatten(F.collect_list("tail").over(before)).alias("before"))
    rows = sliced.withColumns(
        {
            "_r": F.row_number().over(within),
            "_one": F.lag(column, 1).over(within),
            "_two": F.lag(column, 2).over(within),
        }
    ).join(carried, "_slice")
    last, second_last = F.try_element_at("before", F.lit(-1)), F.try_element_at("before", F.lit(-2))
    rows = rows.select(
        column,
        "_slice",
        "_r",
        F.coalesce("_one", last).alias("one"),
        F.coalesce("_two", F.when(F.col("_r") == 2, last).otherwise(second_last)).alias("two"),
    )
    bend = F.col(column) - 2 * F.col("one") + F.col("two")
    return rows.filter(F.col("two").isNotNull()).agg(
        F.max_by(column, F.struct(bend, -F.col("_slice"), -F.col("_r"))).alias("eps")
    )

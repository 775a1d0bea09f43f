"""Exact quantiles of whole columns at any size.

The built-in exact percentile keeps every distinct value in one reducer.
Here a sketch first brackets each wanted rank, a count proves that the rank
lies inside its bracket, and only the few rows inside are ranked.  The driver
sees bounds and counts, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 10_000


@dataclass
class _Target:
    column: str
    p: float
    low: float | None = None  # bracket, inclusive; None = open
    high: float | None = None
    below: int = 0  # rows under the bracket
    inside: int = 0
    heavy: int = 0  # rows equal to one of the two bounds
    rank: float = 0.0  # 0-based position among all non-null rows

    def within(self):
        x = F.col(self.column)
        ok = x.isNotNull()
        if self.low is not None:
            ok = ok & (x >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (x <= F.lit(self.high))
        return ok

    def open_rows(self) -> int:
        return self.inside - self.heavy

    def holds(self, below: int, inside: int) -> bool:
        return below <= math.floor(self.rank) and math.ceil(self.rank) < below + inside


def _narrow(df: DataFrame, targets: list[_Target], slack: float) -> bool:
    """One sketch pass and one counting pass; True if every bracket got smaller."""
    # targets of one column and bracket read one sketch
    shared: dict[tuple, list[int]] = {}
    for i, t in enumerate(targets):
        shared.setdefault((t.column, t.low, t.high), []).append(i)

    def around(t: _Target) -> list[float]:
        at = (t.rank - t.below) / max(1, t.inside - 1)
        return [min(1.0, max(0.0, at + d)) for d in (-slack, slack)]

    found = df.agg(
        *[
            F.percentile_approx(
                F.when(targets[same[0]].within(), F.col(targets[same[0]].column)),
                [p for i in same for p in around(targets[i])],
                ACCURACY,
            )
            for same in shared.values()
        ]
    ).first()
    sketch = [None] * len(targets)
    for bounds, same in zip(found, shared.values(), strict=True):
        for at, i in enumerate(same):
            sketch[i] = bounds[2 * at : 2 * at + 2]
    counts = []
    for i, t in enumerate(targets):
        x, (low, high) = F.col(t.column), sketch[i]
        counts += [
            F.count_if(x < low).alias(f"below{i}"),
            F.count_if(x.between(low, high)).alias(f"inside{i}"),
            F.count_if(x.isin(low, high)).alias(f"heavy{i}"),
        ]
    seen = df.agg(*counts).first()
    shrunk = True
    for i, t in enumerate(targets):
        below, inside, heavy = seen[3 * i : 3 * i + 3]
        if t.holds(below, inside) and inside - heavy < t.open_rows():
            (t.low, t.high), t.below, t.inside, t.heavy = sketch[i], below, inside, heavy
        else:
            shrunk = False
    return shrunk


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    rank_rows: int = 1_000_000,
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of each column, ignoring nulls.

    Brackets are narrowed until fewer than ``rank_rows`` values per wanted
    rank are left to sort.
    """
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    targets = [_Target(c, p) for c in columns if sizes[c] for p in probabilities]
    for t in targets:
        t.inside = sizes[t.column]
        t.rank = t.p * (t.inside - 1)

    slack = 5 / ACCURACY
    while wide := [t for t in targets if t.open_rows() > rank_rows]:
        if not _narrow(df, wide, slack):
            if slack == 1.0:
                raise RuntimeError("the sketch does not narrow a quantile down to rows that can be ranked")
            slack = min(1.0, slack * 4)

    values = _rank(df, targets) if targets else {}
    out: dict[str, list[float]] = {}
    for c in columns:
        out[c] = [values.get((c, p), float("nan")) for p in probabilities]
    return out


def _rank(df: DataFrame, targets: list[_Target]) -> dict[tuple[str, float], float]:
    candidates = F.array(
        *[
            F.when(
                t.within(),
                F.struct(F.lit(i).alias("target"), F.col(t.column).cast("double").alias("x")),
            )
            for i, t in enumerate(targets)
        ]
    )
    counted = (
        df.select(F.explode(candidates).alias("c"))
        .filter(F.col("c").isNotNull())
        .groupBy("c.target", "c.x")
        .count()
    )
    upto = F.sum("count").over(
        Window.partitionBy("target").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    )
    low_rank = F.lit(None).cast("long")
    high_rank = F.lit(None).cast("long")
    for i, t in enumerate(targets):
        here = F.col("target") == i
        low_rank = F.when(here, math.floor(t.rank) - t.below).otherwise(low_rank)
        high_rank = F.when(here, math.ceil(t.rank) - t.below).otherwise(high_rank)
    # at most two rows per target: the values at the two neighbouring ranks
    picked = (
        counted.withColumn("upto", upto)
        .withColumns({"lo": low_rank, "hi": high_rank, "start": F.col("upto") - F.col("count")})
        .filter((F.col("start") <= F.col("hi")) & (F.col("lo") < F.col("upto")))
        .collect()
    )
    out = {}
    for i, t in enumerate(targets):
        rows = sorted((r for r in picked if r["target"] == i), key=lambda r: r["x"])
        a, b = rows[0]["x"], rows[-1]["x"]
        out[(t.column, t.p)] = a + (b - a) * (t.rank - math.floor(t.rank))
    return out

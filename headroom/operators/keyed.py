"""Exact quantiles per key, without a map of values per key.

The built-in exact percentile keeps every distinct value of a key in one
buffer.  Here equal values are counted first; a histogram of a fixed number of
bins per key, which adds up across partitions, tells in which bin a wanted
rank lies, and only that bin is looked at again.  Once few enough values are
left they are ranked.  Counts are exact at every step, so the brackets are
proved and never guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from headroom.session import stage

BINS = 256
RANK_ROWS = 100_000
MOST_ROUNDS = 64


def value_counts(df: DataFrame, keys: Sequence[str], column: str, weight: str | None = None) -> DataFrame:
    """(keys, x, n): how often every value occurs; null and not-a-number are left out."""
    x = F.col(column).cast("double")
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = df.select(*keys, (x + 0.0).alias("x"), n.alias("n")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("n") > 0))
    return rows.groupBy(*keys, "x").agg(F.sum("n").alias("n"))


def first_brackets(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys, target, rank, low, high, below, inside): the whole range of every key."""
    whole = values.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("inside"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    wanted = F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("target", "_p")
    return whole.select(*keys, wanted, "_n", "low", "high", "inside").select(
        *keys, "target", (F.col("_p") * (F.col("_n") - 1)).alias("rank"), "low", "high",
        F.lit(0).cast("long").alias("below"), "inside",
    )


def narrowed(values: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The brackets of ``wide``, each cut to the bin its rank lies in."""
    own = [*keys, "target"]
    part = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))
    met = values.join(wide, list(keys)).filter(F.col("x").between(F.col("low"), F.col("high")))
    bins = met.groupBy(*own, F.least(F.lit(BINS - 1), F.floor(part * BINS)).alias("bin")).agg(
        F.first("rank").alias("rank"),
        F.first("below").alias("_before"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("inside"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    # at most BINS rows a target
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy("bin"))
    bins = bins.withColumn("below", F.col("_before") + upto - F.col("n"))
    bins = bins.filter((F.col("below") <= F.ceil("rank")) & (F.floor("rank") < F.col("below") + F.col("n")))
    both = bins.groupBy(*own).agg(
        F.first("rank").alias("rank"),
        F.count(F.lit(1)).alias("_bins"),
        F.min(F.struct("bin", "low", "high", "below", "n", "inside")).alias("a"),
        F.max(F.struct("bin", "low", "high", "below", "n", "inside")).alias("b"),
    )
    # the two ranks of an interpolation may lie in two bins: the end of one and the begin of the other
    one = F.col("_bins") == 1
    return both.select(
        *own,
        "rank",
        F.when(one, F.col("a.low")).otherwise(F.col("a.high")).alias("low"),
        F.when(one, F.col("a.high")).otherwise(F.col("b.low")).alias("high"),
        F.when(one, F.col("a.below")).alias("below"),
        F.when(one, F.col("a.inside")).otherwise(2).cast("long").alias("inside"),
    )


def brackets(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float], rank_rows: int = RANK_ROWS) -> DataFrame:
    """Brackets of at most ``rank_rows`` distinct values for every key and probability.

    A bracket whose ``below`` is null holds two values: those at the two
    neighbouring ranks.  The rounds follow the widest key; the others wait.
    """
    open_ = first_brackets(values, keys, probabilities)
    done = None
    for _ in range(MOST_ROUNDS):
        held = stage(open_, "brackets")
        narrow = held.filter(F.col("inside") <= max(2, rank_rows))
        done = narrow if done is None else done.unionByName(narrow)
        wide = held.filter(F.col("inside") > max(2, rank_rows))
        if wide.isEmpty():
            return done
        open_ = narrowed(values, wide, keys)
    raise RuntimeError("values are too unevenly spread for their brackets to get narrow")


def keyed_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: dict[str, float],
    weight: str | None = None,
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """(keys, one column per name of ``probabilities``): linearly interpolated quantiles of every key.

    ``weight`` counts a row several times.  A key may hold any share of the
    rows: no task sees more than ``BINS`` rows or ``rank_rows`` values of a
    key at once.  Null, not-a-number and rows of weight 0 are left out, and
    keys without a value with them; null keys are a key.
    """
    names = list(probabilities)
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    # keys as null-safe text, so that joins meet null keys
    safe = [F.to_json(F.struct(F.col(k))).alias(v) for k, v in named.items()]
    shown = stage(value_counts(df.select("*", *safe), [*named.values()], column, weight), "values")
    found = brackets(shown, [*named.values()], [probabilities[n] for n in names], rank_rows)
    own = [*named.values(), "target"]
    inside = shown.join(found, [*named.values()]).filter(F.col("x").between(F.col("low"), F.col("high")))
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto", F.col("below") + upto).withColumn("start", F.col("upto") - F.col("n"))
    pair = F.col("below").isNull()
    lower = pair | ((F.col("start") <= F.floor("rank")) & (F.floor("rank") < F.col("upto")))
    upper = pair | ((F.col("start") <= F.ceil("rank")) & (F.ceil("rank") < F.col("upto")))
    picked = ranked.groupBy(*own).agg(
        F.min(F.when(lower, F.col("x"))).alias("a"), F.max(F.when(upper, F.col("x"))).alias("b"), F.first("rank").alias("rank")
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    wide = picked.groupBy(*named.values()).agg(*[F.max(F.when(F.col("target") == i, value)).alias(n) for i, n in enumerate(names)])
    kinds = dict(df.dtypes)
    back = [F.from_json(v, f"`{k}` {kinds[k]}")[k].alias(k) for k, v in named.items()]
    return wide.select(*back, *names)

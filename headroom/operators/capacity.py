"""Capacity policies over a machine's series.

Stateless policies are window expressions.  A policy whose next capacity
depends on the last one is a fold in time order: Spark brings machines' rows
together and sorts them by position, and one pass walks all machines of a
partition side by side, one array operation per step, with a state of a few
numbers per machine; no machine is ever held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from headroom.params import (
    BACKTEST_LIMIT,
    CAPACITY_FLOOR,
    EPS,
    MOVING_AVERAGE_WINDOW,
    ORACLE_BUFFER,
    STATIC_BUFFER,
    Autoscaler,
    Policy,
)

# --- one step of each policy, shared by batch and stream ---------------------


def policy_step(capacity, predicted, p: Policy = Policy(), up=None, down=None):
    """Next capacity, action and confidence; numbers or arrays of machines."""
    ratio = predicted / (capacity + EPS)
    distance = np.abs(ratio - 0.5) / 0.5
    rises = ratio > (p.up if up is None else up)
    falls = np.logical_not(rises) & (ratio < (p.down if down is None else down))
    higher = np.minimum(capacity * p.factor, p.ceiling)
    lower = np.maximum(np.maximum(capacity / p.factor, p.floor), predicted * p.guard)
    after = np.where(rises, higher, np.where(falls, lower, capacity))
    action = np.where(rises, "scale_up", np.where(falls, "scale_down", "keep"))
    return after, action, np.minimum(np.where(rises | falls, distance, 1 - distance), 1.0)


def autoscaler_step(capacity, wait, usage, a: Autoscaler = Autoscaler()):
    """Next capacity and remaining cooldown; numbers or arrays of machines."""
    ratio = usage / (capacity + EPS)
    rises, falls = ratio > a.up, ratio < a.down
    higher = np.minimum(capacity * a.factor, a.ceiling)
    lower = np.maximum(np.maximum(capacity / a.factor, usage * a.guard), a.floor)
    moved = np.where(rises, higher, np.where(falls, lower, capacity))
    waits = wait > 0
    return np.where(waits, capacity, moved), np.where(waits, wait - 1, np.where(rises | falls, a.cooldown, 0))


# --- folds ---------------------------------------------------------------------


def fold_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    inputs: Sequence[str],
    outputs: Sequence[tuple[str, str]],
    start: Callable,
    step: Callable,
) -> DataFrame:
    """Walk each key's rows in order, adding the output columns.

    A partition holds whole keys and is sorted by position in the key first,
    so that all of its keys take their n-th step together: ``start(rows)``
    makes the state, a tuple of arrays, out of the input columns of first
    rows, and ``step(state, rows)`` returns (state, output arrays).  The state
    is a few numbers per key of the partition.  Positions come from Spark,
    which brings the rows of a key together whatever adaptive execution does
    to the plan; the walk checks that none is missing.
    """
    keys, inputs = list(keys), list(inputs)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    one = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    numbered = df.withColumns({"_position": position, "_key": one}).sortWithinPartitions("_position", "_key")
    schema = T.StructType(df.schema.fields)
    for name, kind in outputs:
        schema = schema.add(name, kind)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, state, last = pd.Index([]), None, np.zeros(0, dtype=np.int64)
        run, place = None, None
        for batch in batches:
            if batch.empty:
                continue
            at, names = batch["_position"].to_numpy(), batch["_key"].to_numpy(dtype=object)
            values = [batch[c].to_numpy(dtype=float) for c in inputs]
            produced: list[list[np.ndarray]] = [[] for _ in outputs]
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = [v[a:b] for v in values]
                if at[a] == 1:
                    place = np.arange(len(places), len(places) + b - a)
                    places = places.append(pd.Index(names[a:b], dtype=object))
                    begun = start(rows)
                    state = begun if state is None else tuple(map(np.append, state, begun))
                    last = np.append(last, np.zeros(b - a, dtype=np.int64))
                elif run != (b - a, names[a], names[b - 1]):
                    # keys only ever drop out, so a run of the same length and ends is the same
                    place = places.get_indexer(names[a:b])
                run = (b - a, names[a], names[b - 1])
                if (place < 0).any() or (last[place] != at[a] - 1).any():
                    raise RuntimeError("rows of one key arrived apart")
                last[place] = at[a]
                after, out = step(tuple(s[place] for s in state), rows)
                for held, new in zip(state, after, strict=True):
                    held[place] = new
                for column, new in zip(produced, out, strict=True):
                    column.append(new)
            added = {name: np.concatenate(column) for (name, _), column in zip(outputs, produced, strict=True)}
            yield batch.drop(columns=["_position", "_key"]).assign(**added)

    return numbered.mapInPandas(walk, schema)


def threshold_fold(
    df: DataFrame,
    start: str,
    out: str,
    settings: Autoscaler = Autoscaler(),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Add ``out``: the capacity after each change; ``start`` holds the first capacity."""

    def begin(rows):
        return rows[1].copy(), np.zeros(len(rows[1]), dtype=np.int64)

    def step(state, rows):
        state = autoscaler_step(state[0], state[1], rows[0], settings)
        return state, (state[0],)

    return fold_by_key(df, [key], order, [y, start], [(out, "double")], begin, step)


def machine_median(y: str = "y", key: str = "machine_id") -> Column:
    return F.percentile(y, F.lit(0.5)).over(Window.partitionBy(key))


def first_value(column: str, key: str = "machine_id", order: str = "step") -> Column:
    return F.first(column).over(Window.partitionBy(key).orderBy(order))


def threshold_capacity(
    series: DataFrame,
    settings: Autoscaler = Autoscaler(),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Reactive scaling with cooldown, starting at 1.5 times the machine's median."""
    begun = series.withColumn("_start", machine_median(y, key) * settings.start)
    return threshold_fold(begun, "_start", "capacity", settings, key, order, y).drop("_start")


SIMPLE = Autoscaler(cooldown=0, guard=0.0)


def threshold_simple(
    series: DataFrame,
    settings: Autoscaler = SIMPLE,
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """Reactive scaling without cooldown or usage guard, starting at 1.5 times the first value."""
    begun = series.withColumn("_start", first_value(y, key, order) * settings.start)
    return threshold_fold(begun, "_start", "capacity", settings, key, order, y).drop("_start")


def policy_fold(
    df: DataFrame,
    start: str,
    predicted: str,
    settings: Policy = Policy(),
    keys: Sequence[str] = ("machine_id",),
    order: str = "step",
    thresholds: tuple[str, str] | None = None,
) -> DataFrame:
    """Apply the prediction-driven policy step by step.

    Adds current_capacity, action, recommended_capacity (``capacity``) and
    confidence.  ``thresholds`` names columns with the up and down limits,
    for sweeps.
    """
    inputs = [predicted, start, *(thresholds or ())]

    def begin(rows):
        return (rows[1].copy(),)

    def step(state, rows):
        after, action, confidence = policy_step(state[0], rows[0], settings, *rows[2:])
        return (after,), (state[0], action, after, confidence)

    outputs = [
        ("current_capacity", "double"),
        ("action", "string"),
        ("capacity", "double"),
        ("confidence", "double"),
    ]
    return fold_by_key(df, keys, order, inputs, outputs, begin, step)


def policy_capacity(
    series: DataFrame,
    predicted: str = "predicted",
    settings: Policy = Policy(),
    key: str = "machine_id",
    order: str = "step",
) -> DataFrame:
    """The policy over a predicted series, starting at 1.3 times its first value."""
    begun = series.withColumn(
        "_start", first_value(predicted, key, order) * settings.start
    )
    return policy_fold(begun, "_start", predicted, settings, [key], order).drop("_start")


def policy_replay(
    forecast: DataFrame,
    last_train: DataFrame | None = None,
    settings: Policy = Policy(),
    key: str = "machine_id",
) -> DataFrame:
    """The policy over a forecast (machine, h, y_pred), starting at 1.3 times the last known value.

    ``last_train`` is not needed where the forecast has ``last_value`` in each row.
    """
    known = forecast if last_train is None else forecast.join(last_train, key)
    begun = known.withColumn("_start", F.col("last_value") * settings.start)
    return policy_fold(begun, "_start", "y_pred", settings, [key], "h").drop("_start", "last_value")


def policy_backtest(
    df: DataFrame,
    start: str,
    predicted: str = "predicted",
    actual: str = "y",
    settings: Policy = Policy(),
    limit: float = BACKTEST_LIMIT,
    key: str = "machine_id",
    order: str = "step",
) -> DataFrame:
    """Per machine: cost, violations and utilisation of the policy against the actual usage."""
    walked = policy_fold(df, start, predicted, settings, [key], order)
    late = F.col(actual) > F.col("capacity") * limit
    return walked.groupBy(key).agg(
        F.sum("capacity").alias("total_cost"),
        F.count_if(late).alias("sla_violations"),
        (F.avg(late.cast("double")) * 100).alias("sla_violation_rate"),
        F.avg("capacity").alias("avg_capacity"),
        (F.avg(actual) / F.avg("capacity")).alias("avg_utilization"),
    )


# --- stateless ------------------------------------------------------------------


def decide(capacity: Column, predicted: Column, p: Policy = Policy()) -> dict[str, Column]:
    """One decision per row, as column expressions."""
    ratio = predicted / (capacity + EPS)
    distance = F.abs(ratio - 0.5) / 0.5
    up, down = ratio > p.up, ratio < p.down
    return {
        "action": F.when(up, "scale_up").when(down, "scale_down").otherwise("keep"),
        "recommended_capacity": F.when(up, F.least(capacity * p.factor, F.lit(p.ceiling)))
        .when(down, F.greatest(capacity / p.factor, F.lit(p.floor), predicted * p.guard))
        .otherwise(capacity),
        "confidence": F.least(F.when(up | down, distance).otherwise(1 - distance), F.lit(1.0)),
    }


def scaling_decisions(
    capacities: DataFrame, usages: DataFrame, settings: Policy = Policy(), key: str = "machine_id"
) -> DataFrame:
    """Decision table for the machines with both a capacity and a predicted usage."""
    both = capacities.select(key, "current_capacity").join(usages.select(key, "predicted_usage"), key)
    return both.withColumns(decide(F.col("current_capacity"), F.col("predicted_usage"), settings))


def action_distribution(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def static_level(y: str = "y", key: str = "machine_id", buffer: float = STATIC_BUFFER) -> Column:
    return F.max(y).over(Window.partitionBy(key)) * buffer


def moving_average(
    y: str = "y", key: str = "machine_id", order: str = "step", window: int = MOVING_AVERAGE_WINDOW
) -> Column:
    """Mean of the ``window`` values before; of all values up to now while there are fewer."""
    machine = Window.partitionBy(key).orderBy(order)
    early = F.avg(y).over(machine.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    trailing = F.avg(y).over(machine.rowsBetween(-window, -1))
    return F.when(F.row_number().over(machine) <= window, early).otherwise(trailing)


def moving_average_level(
    y: str = "y",
    key: str = "machine_id",
    order: str = "step",
    window: int = MOVING_AVERAGE_WINDOW,
    buffer: float = STATIC_BUFFER,
) -> Column:
    return F.greatest(moving_average(y, key, order, window) * buffer, F.lit(CAPACITY_FLOOR))


def oracle_level(y: str = "y", buffer: float = ORACLE_BUFFER) -> Column:
    return F.greatest(F.col(y) * buffer, F.lit(CAPACITY_FLOOR))


def static_capacity(series: DataFrame, **options) -> DataFrame:
    """Flat capacity at the machine's peak plus a buffer."""
    return series.withColumn("capacity", static_level(**options))


def moving_average_capacity(series: DataFrame, **options) -> DataFrame:
    return series.withColumn("capacity", moving_average_level(**options))


def oracle_capacity(series: DataFrame, **options) -> DataFrame:
    """Capacity with perfect knowledge: usage plus a buffer."""
    return series.withColumn("capacity", oracle_level(**options))


# --- several strategies in one pass ---------------------------------------------


def _long(wide: DataFrame, names: Sequence[str], key: str, order: str, y: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(n).alias("strategy"), F.col(f"_{n}").alias("capacity")) for n in names]
    )
    return wide.select(key, order, F.col(y).alias("usage"), F.explode(pairs).alias("s")).select(
        key, order, "s.strategy", "s.capacity", "usage"
    )


def baseline_capacities(
    series: DataFrame,
    settings: Autoscaler = Autoscaler(),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """static, threshold and moving_average for every machine: one shuffle, one pass.

    Gives (machine, step, strategy, capacity, usage).
    """
    wide = series.select(key, order, y)
    wide = wide.withColumns(
        {
            "_static": static_level(y, key),
            "_moving_average": moving_average_level(y, key, order),
            "_start": machine_median(y, key) * settings.start,
        }
    )
    wide = threshold_fold(wide, "_start", "_threshold", settings, key, order, y)
    return _long(wide, ["static", "threshold", "moving_average"], key, order, y)


def strategy_capacities(
    series: DataFrame,
    predicted: str = "predicted",
    settings: Policy = Policy(),
    key: str = "machine_id",
    order: str = "step",
    y: str = "y",
) -> DataFrame:
    """static, threshold, proposed and oracle from usage and predicted usage, in one pass."""
    wide = series.select(key, order, y, predicted)
    wide = wide.withColumns(
        {
            "_static": static_level(y, key),
            "_oracle": oracle_level(y),
            "_first": first_value(y, key, order) * SIMPLE.start,
            "_begin": first_value(predicted, key, order) * settings.start,
        }
    )

    def begin(rows):
        return rows[2].copy(), np.zeros(len(rows[2]), dtype=np.int64), rows[3].copy()

    def step(state, rows):
        threshold, wait = autoscaler_step(state[0], state[1], rows[0], SIMPLE)
        proposed, _, _ = policy_step(state[2], rows[1], settings)
        return (threshold, wait, proposed), (threshold, proposed)

    wide = fold_by_key(
        wide,
        [key],
        order,
        [y, predicted, "_first", "_begin"],
        [("_threshold", "double"), ("_proposed", "double")],
        begin,
        step,
    )
    return _long(wide, ["static", "threshold", "proposed", "oracle"], key, order, y)

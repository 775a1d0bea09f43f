"""Cost, utilisation and SLA comparison of capacity strategies.

Input is the long table (machine, step, strategy, capacity, usage); every
comparison is one aggregation with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.functions import metrics as M
from headroom.params import Pricing


# The lines of the cost report.
REPORT_LINES = {
    "strategy_name": "Strategy: %s",
    "total_cost": "  Total Cost:        $%.4f",
    "wasted_cost": "  Wasted Cost:       $%.4f",
    "utilization_pct": "  Utilization:       %.1f%%",
    "sla_violations": "  SLA Violations:    %d",
    "cost_reduction_pct": "  Cost Reduction:    %.1f%%",
}


def reduction_against(
    table: DataFrame, by: Sequence[str] = (), name: str = "strategy", baseline: str = "static"
) -> DataFrame:
    """Add ``cost_reduction_pct`` against the baseline row, within ``by``.

    ``table`` has one row per strategy (and ``by``), so the window is as small
    as the number of strategies.
    """
    base = F.max(F.when(F.col(name) == baseline, F.col("total_cost"))).over(Window.partitionBy(*by))
    return table.withColumn("cost_reduction_pct", M.cost_reduction(base, F.col("total_cost")))


def cost_breakdown(
    capacities: DataFrame,
    by: Sequence[str] = ("strategy",),
    price: Pricing = Pricing(),
    memory: str | None = None,
) -> DataFrame:
    """Total, compute and wasted cost, utilisation and SLA violations per group."""
    return capacities.groupBy(*by).agg(
        M.total_cost("capacity", price, memory).alias("total_cost"),
        M.total_cost("capacity", price).alias("compute_cost"),
        M.wasted_cost("usage", "capacity", price).alias("wasted_cost"),
        M.average_utilisation("usage", "capacity").alias("utilization"),
        M.sla_violations("usage", "capacity").alias("sla_violations"),
    )


def compare_strategies(
    capacities: DataFrame, by: Sequence[str] = (), price: Pricing = Pricing()
) -> DataFrame:
    """Breakdown per strategy with the saving against ``static``."""
    return reduction_against(cost_breakdown(capacities, [*by, "strategy"], price), by)


def baseline_results(
    capacities: DataFrame, key: str = "machine_id", price: Pricing = Pricing()
) -> DataFrame:
    """Cost, utilisation and violations of each baseline over all machines.

    Static utilisation is a machine's mean usage over its flat capacity, the
    others are means of the ratio; machines weigh by their number of steps.
    """
    per_machine = capacities.groupBy(key, "strategy").agg(
        M.total_cost("capacity", price).alias("total_cost"),
        M.average_utilisation("usage", "capacity").alias("ratio_mean"),
        F.try_divide(F.avg("usage"), F.max("capacity")).alias("mean_ratio"),
        M.sla_violations("usage", "capacity").alias("violations"),
        F.count(F.lit(1)).alias("n"),
    )
    used = F.when(F.col("strategy") == "static", F.col("mean_ratio")).otherwise(F.col("ratio_mean"))
    n = F.sum("n")
    return per_machine.groupBy("strategy").agg(
        F.sum("total_cost").alias("total_cost"),
        (F.sum(used * F.col("n")) / n).alias("utilization"),
        F.sum("violations").alias("sla_violations"),
        (F.sum("violations") / n * 100).alias("sla_violation_rate"),
    )


def compare_baselines(
    baselines: DataFrame, proposed: DataFrame, key: str = "machine_id", price: Pricing = Pricing()
) -> DataFrame:
    """Baselines and the proposed capacities as methods, utilisation in percent."""
    both = baselines.unionByName(proposed.withColumn("strategy", F.lit("proposed")).select(baselines.columns))
    table = (
        baseline_results(both, key, price)
        .withColumnRenamed("strategy", "method")
        .withColumn("utilization", F.col("utilization") * 100)
    )
    return reduction_against(table, name="method")


def results_table(results: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of several methods under each other."""
    out = None
    for method, row in results.items():
        row = row.select(F.lit(method).alias("method"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def cost_report(comparison: DataFrame) -> DataFrame:
    """One formatted text per strategy."""
    shown = comparison.withColumns(
        {"strategy_name": F.upper("strategy"), "utilization_pct": F.col("utilization") * 100}
    )
    lines = [F.format_string(template, column) for column, template in REPORT_LINES.items()]
    return shown.select("strategy", F.concat_ws("\n", *lines).alias("report"))


# --- extras: sizing rules described with the method, not part of its pipeline ------


def penalised_cost(capacity: str, usage: str, price: float, waste_price: float) -> Column:
    """Aggregate: price of the capacity plus a penalty on what is not used."""
    spare = F.greatest(F.lit(0.0), F.col(capacity) - F.col(usage))
    return F.sum(F.col(capacity) * price) + F.sum(spare * waste_price)


def buffered_capacity(
    predicted: Column, error_std: Column, z: float, unit: float, current: Column, slack: float
) -> dict[str, Column]:
    """Capacity for a prediction plus z deviations, in whole units, with a lazy scale-down."""
    wanted = F.ceil((predicted + z * error_std) / unit) * unit
    change = (
        F.when(wanted > current, "scale_up")
        .when(current - wanted > slack, "scale_down")
        .otherwise("keep")
    )
    return {
        "allocated": wanted,
        "action": change,
        "capacity": F.when(change == "keep", current).otherwise(wanted),
    }


def margin_capacity(predicted: Column, margin: Column) -> Column:
    return predicted * (1 + margin)


def peak_to_mean(y: str = "y") -> Column:
    return F.try_divide(F.max(y), F.avg(y))


def autocorrelation(series: DataFrame, key: str = "machine_id", order: str = "step", y: str = "y") -> DataFrame:
    """Correlation of each value with the one before it, per machine."""
    before = F.lag(y).over(Window.partitionBy(key).orderBy(order))
    return (
        series.select(key, y, before.alias("before"))
        .filter(F.col("before").isNotNull())
        .groupBy(key)
        .agg(F.corr(y, "before").alias("autocorrelation"))
    )

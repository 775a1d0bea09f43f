"""Aggregate expressions for prediction, cost, utilisation and SLA metrics.

Each function returns an aggregate Column, so any set of them can share one
``groupBy(...).agg(...)`` pass over (actual, predicted) or (usage, capacity).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from headroom.params import EPS, SLA_LIMIT, Pricing

INF = float("inf")


def _d(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- prediction -----------------------------------------------------------


def rmse(actual, predicted) -> Column:
    e = _d(actual) - _d(predicted)
    return F.sqrt(F.avg(e * e))


def mae(actual, predicted) -> Column:
    return F.avg(F.abs(_d(actual) - _d(predicted)))


def mape(actual, predicted) -> Column:
    """Percent error over the non-zero actuals; infinite if there are none."""
    a, p = _d(actual), _d(predicted)
    return F.coalesce(F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100, F.lit(INF))


def mape_epsilon(actual, predicted) -> Column:
    """Percent error with a tiny constant in the denominator, over all rows."""
    a, p = _d(actual), _d(predicted)
    return F.avg(F.abs((a - p) / (a + EPS))) * 100


def smape(actual, predicted) -> Column:
    a, p = _d(actual), _d(predicted)
    size = F.abs(a) + F.abs(p)
    return F.coalesce(F.avg(F.when(size != 0, 2 * F.abs(a - p) / size)) * 100, F.lit(0.0))


# --- cost -----------------------------------------------------------------


def total_cost(capacity, price: Pricing = Pricing(), memory=None) -> Column:
    cost = F.sum(_d(capacity)) * price.hours * price.cpu_hour
    if memory is None:
        return cost
    return cost + F.sum(_d(memory)) * price.hours * price.memory_gb_hour


def wasted_cost(usage, capacity, price: Pricing = Pricing()) -> Column:
    spare = F.greatest(F.lit(0.0), _d(capacity) - _d(usage))
    return F.sum(spare) * price.hours * price.cpu_hour


def cost_efficiency(usage, capacity) -> Column:
    return F.sum(_d(usage)) / (F.sum(_d(capacity)) + EPS)


def cost_reduction(baseline, proposed) -> Column:
    """Percent saved against the baseline; 0 where the baseline costs nothing."""
    b, p = _d(baseline), _d(proposed)
    return F.when(b == 0, 0.0).otherwise((b - p) / F.nullif(b, F.lit(0.0)) * 100)


# --- utilisation ----------------------------------------------------------


def utilisation(usage, capacity) -> Column:
    """Row-level ratio of usage to capacity."""
    return _d(usage) / (_d(capacity) + EPS)


def average_utilisation(usage, capacity) -> Column:
    return F.avg(utilisation(usage, capacity))


def utilisation_variance(usage, capacity) -> Column:
    return F.var_pop(utilisation(usage, capacity))


def over_provisioning(usage, capacity) -> Column:
    return F.avg(_d(capacity) / (_d(usage) + EPS))


# --- service level --------------------------------------------------------


def violates(usage, capacity, limit: float = SLA_LIMIT) -> Column:
    return _d(usage) > _d(capacity) * limit


def sla_violations(usage, capacity, limit: float = SLA_LIMIT) -> Column:
    return F.count_if(violates(usage, capacity, limit))


def sla_violation_rate(usage, capacity, limit: float = SLA_LIMIT) -> Column:
    return F.avg(violates(usage, capacity, limit).cast("double")) * 100


def sla_compliance(usage, capacity, limit: float = SLA_LIMIT) -> Column:
    return 100 - sla_violation_rate(usage, capacity, limit)


# --- sets -----------------------------------------------------------------


def prediction_metrics(actual, predicted) -> list[Column]:
    return [
        rmse(actual, predicted).alias("rmse"),
        mae(actual, predicted).alias("mae"),
        mape(actual, predicted).alias("mape"),
    ]


def all_metrics(actual, predicted, usage, capacity, baseline_cost=None) -> list[Column]:
    """One row with every headline metric; all four inputs share the rows."""
    out = prediction_metrics(actual, predicted) + [
        total_cost(capacity).alias("total_cost"),
        wasted_cost(usage, capacity).alias("wasted_cost"),
        average_utilisation(usage, capacity).alias("avg_utilization"),
        over_provisioning(usage, capacity).alias("over_provision_ratio"),
        sla_violations(usage, capacity).alias("sla_violation_count"),
        sla_violation_rate(usage, capacity).alias("sla_violation_rate"),
    ]
    if baseline_cost is not None:
        out.append(cost_reduction(_d(baseline_cost), total_cost(capacity)).alias("cost_reduction_pct"))
    return out

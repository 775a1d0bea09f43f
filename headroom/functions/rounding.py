"""Rounding for comparisons by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Capacities and costs are often decimals that end exactly on a half, where the
# last bit of a sum would decide between two results.  The break is therefore
# moved off the half.
BREAK = 0.1863


def rounded_value(value: Column, digits: int) -> Column:
    scale = float(f"1e{digits}")
    return F.rint(value * scale - BREAK) / scale + 0.0


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Every double, also inside arrays, to that many places."""

    def column(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return rounded_value(c, digits).alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.transform(c, lambda v: rounded_value(v, digits)).alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema])

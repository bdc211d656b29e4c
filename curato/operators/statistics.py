"""Exact order statistics that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.operators.graph import materialise

#: How finely quantiles are sketched, and from how many values on they are narrowed further.
ACCURACY, FEW = 10_000, 100_000


def median_of(rows: DataFrame, value: Column, few: int = FEW) -> float | None:
    """The middle value, or the mean of the two middle ones; None without values. ``rows`` should be cheap to read again.

    While more than ``few`` values remain, a sketch of them brackets the middle and the values outside are counted, which
    leaves some ten-thousandths each time. Of the rest equal values are one row.
    """
    own = rows.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    n = own.count()
    if not n:
        return None
    first, last = (n - 1) // 2, n // 2
    part, below, inside = own, 0, n
    while inside > few:
        ends = [max(0.0, (first - below) / inside - 3 / ACCURACY), min(1.0, (last - below) / inside + 3 / ACCURACY)]
        low, high = part.agg(F.percentile_approx("v", ends, ACCURACY)).first()[0]
        part = own.where(F.col("v").between(low, high))
        below, narrowed = own.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if low == high or narrowed == inside:
            break
        inside = narrowed
    counted = part.groupBy("v").agg(F.count("*").alias("c"))
    upto = counted.select("v", (F.lit(below) + F.sum("c").over(Window.orderBy("v"))).alias("upto"))
    reach = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    return upto.agg((reach(first) + reach(last)) / 2).first()[0]


def exact_median(rows: DataFrame, value: Column) -> DataFrame:
    """One row: ``median`` of values that are written once and read from there; null without values."""
    written = materialise(rows.select(value.cast("double").alias("v")), "values")
    return rows.sparkSession.createDataFrame([(median_of(written, F.col("v")),)], "median double")
